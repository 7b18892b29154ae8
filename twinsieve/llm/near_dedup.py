"""Operator 8: near-duplicate documents by DartMinHash signatures.

A document is its shingles, each weighted by how often it occurs. Darts are thrown, by hashing, into the plane of weight
and rank of each shingle: every unit of weight has a Poisson process of ranks. Those in a document's own region, under a
rank bound that gives about k ln k + 2k darts, are dealt to k coordinates, of which each keeps the earliest; two
documents agree in a coordinate with the probability of their weighted Jaccard similarity. Bands of coordinates give
candidates. Then, without any cap:

1. documents of equal weighted shingles are one representative;
2. in each bucket of a band, sketches link members that may be similar enough; only a spanning forest is kept;
3. within the components of these links, weighted shingles are compared exactly, until what is connected is known to be:
   members of a large component with one of them first, what is left with the others, block against block;
4. the components of the exact links are the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .common import Bounded, free_name, in_batches, kept, numbered, table, text_tag, told_apart, with_facts, without, word_runs
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: A pair of similarity 0.8 shares no band once in 330,000 times, and agrees in fewer than this share of coordinates once
#: in some 10^17 times, less often than digests collide (binomial distributions over 32 bands and 160 coordinates).
SKETCH_SHARE = 0.5
#: Members of a bucket, and bytes of the sets of a component, that are compared in one go; larger ones are cut into blocks.
BUCKET_BLOCK, EXACT_BYTES = 2048, 4 << 20
PART = 1 << 20
#: near(values, a, rest): which of the places `rest` are near the place a
Near = Callable[[list[bytes], int, np.ndarray], np.ndarray]
_GOLDEN, _A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_B)
    return x ^ (x >> np.uint64(31))


def word_hashes() -> Bounded:
    return Bounded(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of the text cut where no word is divided."""
    start = 0
    while start < len(text):
        end = start + size
        while end < len(text) and (text[end].isalnum() or text[end] == "_" or text[end - 1].isalnum() or text[end - 1] == "_"):
            end += 1
        yield text[start:end]
        start = end


def shingles(text: str | None, hashes: Bounded, n: int = WORDS) -> np.ndarray:
    """Hashes of all runs of n words (lower case), with repetitions; of a text with fewer words, of the one run it is.

    A text without a word has none.
    """
    found, carry = [], np.zeros(0, "u8")
    for part in parts(text or ""):
        words = word_runs(part)
        got = np.concatenate([carry, np.fromiter(map(hashes.__getitem__, words), "u8", len(words))])
        if len(got) >= n:
            h = np.zeros(len(got) - n + 1, "u8")
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + got[j : len(got) - n + 1 + j]
            found.append(mix(h))
        carry = got[-(n - 1) :] if n > 1 else got[:0]
    if found:
        return np.concatenate(found)
    return np.array([xxhash.xxh3_64_intdigest(carry.tobytes())], "u8") if len(carry) else np.zeros(0, "u8")


def weighted(text: str | None, hashes: Bounded) -> bytes:
    """Distinct shingles in order, their counts if any is over 1, and whether there are counts; empty without a word."""
    found, counts = np.unique(shingles(text, hashes), return_counts=True)
    if not len(found):
        return b""
    several = bool(counts.max() > 1)
    return found.tobytes() + (counts.astype("u4").tobytes() if several else b"") + bytes([several])


def opened(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and counts of weighted()."""
    n = len(value) // (12 if value[-1] else 8)
    found = np.frombuffer(value, "u8", n)
    return found, np.frombuffer(value, "u4", n, 8 * n).astype("i8") if value[-1] else np.ones(n, "i8")


def _throw(cells: np.ndarray, limit: np.ndarray | None, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranks under the bound, and the darts' own hashes, of each unit cell; limit: how much of a cell's weight counts.

    Some ranks of each cell are drawn at a time, until its ranks have passed the bound: at first about as many as most
    cells need, then, of the few that are left, more.
    """
    ranks, darts, drawn_before, last = [np.zeros(0)], [np.zeros(0, "u8")], 0, np.zeros(len(cells))
    while len(cells):
        ahead = max(0.0, bound - float(last.min()))
        many = max(1, min(int(ahead + 2 + 2.5 * ahead**0.5), 50_000 // len(cells)))
        drawn = mix(cells + np.arange(drawn_before + 1, drawn_before + many + 1, dtype="u8")[:, None] * np.uint64(_GOLDEN))
        rank = last + np.cumsum(-np.log(((drawn >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53), 0)
        inside = rank < bound
        more = inside[-1]
        if limit is not None:
            inside &= (mix(drawn ^ np.uint64(_A)) >> np.uint64(11)).astype("f8") * 2.0**-53 < limit
            limit = limit[more]
        ranks.append(rank[inside])
        darts.append(mix(drawn[inside] ^ np.uint64(_B)))
        cells, last = cells[more], rank[-1, more]
        drawn_before += many
    return np.concatenate(ranks), np.concatenate(darts)


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each of k coordinates, for distinct elements with positive weights (1 if none are given)."""
    if weights is None:
        cells, limit, total = mix(elements), None, float(len(elements))
    else:
        units = np.ceil(weights).astype("i8")
        owner = np.repeat(np.arange(len(elements)), units)
        unit = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
        cells = np.where(unit == 0, mix(elements[owner]), mix(mix(elements[owner]) + unit.astype("u8")))
        limit, total = None if (units == weights).all() else np.minimum(1.0, weights[owner] - unit), float(weights.sum())
    bound = (k * np.log(k) + 2 * k) / total
    while True:
        ranks, darts = _throw(cells, limit, bound)
        order = np.argsort(-ranks)  # the earliest is written last
        to = (darts[order] >> np.uint64(20)) % np.uint64(k)
        out, full = np.zeros(k, "u8"), np.zeros(k, bool)
        out[to], full[to] = darts[order], True
        if full.all():
            return out
        bound *= 2


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys of the bands of one signature, or, by row, of several."""
    keys, parts_ = np.arange(1, bands + 1, dtype="u8"), sig.reshape(*sig.shape[:-1], bands, rows)
    for k in range(rows):
        keys = mix(keys * np.uint64(0x100000001B3) + parts_[..., k])
    return keys.astype("i8")


def sign(docs: DataFrame) -> DataFrame:
    """docs (doc bigint, bytes binary) -> id, same (digest of the weighted shingles; null without a word), w, bands, sketch.

    w: the bytes of weighted(). A sketch has a byte of each coordinate.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("word hashes", word_hashes)
        for batch in batches:
            same, size, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                value = weighted(text, hashes)
                size.append(len(value))
                same.append(xxhash.xxh3_128_digest(value) if value else None)
                if value:
                    found, counts = opened(value)
                    sigs.append(signature(found, counts if value[-1] else None))
            table_ = np.array(sigs, "u8").reshape(-1, COORDINATES)
            made = zip(band_keys(table_), (table_ >> np.uint64(56)).astype("u1"), strict=True)
            keys, sketches = [None] * len(same), [None] * len(same)
            for k, (own, sketch) in zip((k for k, x in enumerate(same) if x is not None), made, strict=True):
                keys[k], sketches[k] = own, sketch.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "same", "w", "bands", "sketch"])

    return docs.select("doc", F.col("bytes").cast("string")).transform(in_batches, run, "id bigint, same binary, w bigint, bands array<bigint>, sketch binary")


def _total(facts: DataFrame, times: str) -> int:
    return facts.agg(F.sum(times)).first()[0] or 0


def to_sets(df: DataFrame) -> DataFrame:
    """df, whose last column is a text, with weighted() of it instead, as `set`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("word hashes", word_hashes)
        for batch in batches:
            sets = [weighted(t, hashes) for t in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "set"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields[:-1])
    return df.transform(in_batches, run, f"{kinds}set binary")


def _linked(rows: DataFrame, values: DataFrame, key: str, value: str, size: int, near: Near, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """a, b: links of ids that connect all members (rows: key, id, w) of a key that are near, directly or by others.

    Members of a key whose weights w sum up to `size` or less are compared in one task. Of a larger key all are compared
    with its least id first, which links the copies of one text in linear work, and what is far from that one is
    compared, in blocks, with its like and with all the others. values: id and what near() compares, or, if `made` is
    given, what it makes `value` of, as the last column: long values then travel as they are once, and only those of
    larger keys are stored as made. No task gets all rows of a hot key: keys are told their sizes by with_facts(), and
    the centre by a join on parts of a key.
    """
    totals = rows.groupBy(key).agg(F.count("*").alias("_n"), F.sum("w").alias("_w")).filter("_n > 1")
    totals = materialise(totals.select(key, "_n", F.ceil(F.col("_w") / size).cast("int").alias("_k")), "totals")
    whole, flags = with_facts(rows, totals, key, "_n", _total(totals, "_n")).drop("_n"), ("left", "right", "tied")
    yes, no = F.lit(True), F.lit(False)
    met = whole.filter("_k = 1").select(key, F.lit(0).cast("bigint").alias("pair"), "id", *(x.alias(n) for x, n in zip((yes, yes, no), flags, strict=True)))
    if made is not None:
        met = met.join(values, "id").select(key, "pair", "id", *flags, values.columns[-1]).transform(made)
    else:
        met = met.join(values, "id")
    if totals.filter("_k > 1").limit(1).count() == 0:
        return _by_group(met, key, value, near)
    large = materialise(whole.filter("_k > 1").select(key, "id", "w", "_k"), "large")
    if made is not None:
        ids = large.select("id").distinct()
        values = materialise(told_apart(values, large.select("id"), "id")[0].join(ids, "id").select("id", values.columns[-1]).transform(made), "values")
    centres = large.groupBy(key, "_k").agg(F.min("id").alias("c")).join(values.select(F.col("id").alias("c"), F.col(value).alias("_centre")), "c")
    centres = centres.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    parted = large.withColumn("_part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("_k")).cast("int")).drop("_k")

    def to_centre(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [near([centre, mine], 0, np.array([1]))[0] for mine, centre in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ok, pa.bool_())], names=[key, "id", "w", "c", "ok"])

    kind = rows.schema[key].dataType.simpleString()
    star = parted.join(centres, [key, "_part"]).join(values, "id").select(key, "id", "w", "c", value, "_centre").transform(in_batches, to_centre, f"{key} {kind}, id bigint, w bigint, c bigint, ok boolean")
    star = materialise(star, "star")

    def dealt(of: DataFrame, many: str) -> DataFrame:
        return of.withColumn("_b", F.pmod(F.xxhash64("id", F.lit("block")), F.col(many)).cast("bigint"))

    def blocks(of: str) -> Column:
        return F.ceil(F.sum(F.when(F.col("ok") if of == "ok" else ~F.col("ok"), F.col("w"))) / size).cast("int")

    counts = materialise(star.groupBy(key).agg(F.count("*").alias("_n"), blocks("not").alias("_r"), blocks("ok").alias("_d")).filter("_r IS NOT NULL"), "counts")
    told = with_facts(star, counts, key, "_n", _total(counts, "_n"))
    rest, tied = dealt(told.filter("NOT ok"), "_r"), dealt(told.filter("ok"), "_d")

    def turned(of: DataFrame, times: str) -> DataFrame:
        return of.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times).cast("bigint") - 1)))

    base, b, o = F.col("_r").cast("bigint") * F.col("_r"), F.col("_b"), F.col("_o")
    among = turned(rest, "_r").select(key, (F.least(b, o) * F.col("_r") + F.greatest(b, o)).alias("pair"), "id", (b <= o).alias("left"), (b >= o).alias("right"), no.alias("tied"))
    against = turned(rest, "_d").select(key, (base + b * F.col("_d") + o).alias("pair"), "id", yes.alias("left"), no.alias("right"), no.alias("tied"))
    others = turned(tied, "_r").select(key, (base + o * F.col("_d") + b).alias("pair"), "id", no.alias("left"), yes.alias("right"), yes.alias("tied"))
    met = met.unionByName(among.union(against).union(others).join(values, "id"))
    return _by_group(met, key, value, near).union(star.filter("ok AND id <> c").select(F.col("id").alias("a"), F.col("c").alias("b")))


def _by_group(df: DataFrame, key: str, value: str, near: Near) -> DataFrame:
    """Links of ids from each (key, pair), whose rows a task reads one group after another: a spanning forest of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> None:
            if len(rows) > 1:
                ids, left, right, tied, values = zip(*rows, strict=True)
                for a, b in spanning(values, np.array(left), np.array(right), np.array(tied), near):
                    out.append((ids[a], ids[b]))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        out: list[tuple[int, int]] = []
        held, now = [], None
        for batch in batches:
            for k, pair, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, pair) != now:
                    flush(held)
                    held, now = [], (k, pair)
                held.append(row)
            if len(out) > 10_000:
                yield made()
                out = []
        flush(held)
        yield made()

    return df.select(key, "pair", "id", "left", "right", "tied", value).repartition(key, "pair").sortWithinPartitions(key, "pair", "id").transform(in_batches, run, "a bigint, b bigint")


def spanning(values: list[bytes], left: np.ndarray, right: np.ndarray, tied: np.ndarray, near: Near) -> Iterator[tuple[int, int]]:
    """Pairs of a left and a right member that are near, as many as connect what is connected; tied ones are already."""
    part = np.arange(len(values))
    part[tied] = np.flatnonzero(tied)[0] if tied.any() else 0
    opposite = np.flatnonzero(right)
    for a in np.flatnonzero(left):
        rest = opposite[opposite > a] if right[a] else opposite
        rest = rest[part[rest] != part[a]]
        if len(rest):
            for b in rest[near(values, int(a), rest)]:
                if part[b] != part[a]:
                    yield int(a), int(b)
                    part[part == part[b]] = part[a]


def near_sketches(sketches: list[bytes], a: int, rest: np.ndarray) -> np.ndarray:
    """Which of `rest` agree with a in enough coordinates."""
    s = np.frombuffer(b"".join([sketches[b] for b in rest]), "u1").reshape(len(rest), -1)
    return (s == np.frombuffer(sketches[a], "u1")).sum(1) >= np.ceil(SKETCH_SHARE * s.shape[1])


def near_sets(sets: list[bytes], a: int, rest: np.ndarray) -> np.ndarray:
    """Which of `rest` have a weighted Jaccard similarity of SIMILARITY or more with a; values as of weighted()."""
    own, times = opened(sets[a])
    others = [opened(sets[b]) for b in rest]
    total, totals = int(times.sum()), np.array([int(n.sum()) for _, n in others])
    out = (totals >= SIMILARITY * total - 1e-9) & (total >= SIMILARITY * totals - 1e-9)
    possible = np.flatnonzero(out)
    for start in range(0, len(possible), 64):
        some = possible[start : start + 64]
        found, counts = (np.concatenate([others[k][j] for k in some]) for j in (0, 1))
        sizes = np.array([len(others[k][0]) for k in some])
        at = np.minimum(np.searchsorted(own, found), len(own) - 1)
        common = np.add.reduceat(np.where(own[at] == found, np.minimum(times[at], counts), 0), np.cumsum(sizes) - sizes)
        out[some] = common >= SIMILARITY * (total + totals[some] - common) - 1e-9
    return out


def _classes(docs: DataFrame) -> DataFrame:
    """doc, class (the least doc of its class) of docs (doc bigint, bytes binary) with a word."""
    signed = materialise(sign(docs), "signed").filter("same IS NOT NULL")
    groups = materialise(signed.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "groups")
    copies = with_facts(signed.select("same", "id"), groups, "same", "n", _total(groups, "n"), "left")
    members = materialise(copies.select("id", F.coalesce("rep", "id").alias("rep")), "members")
    reps = without(signed.select("id", "w", "bands", "sketch"), materialise(members.filter("id <> rep").select("id"), "copies"), "id")
    rows = reps.select(F.explode("bands").alias("bucket"), "id", F.lit(1).cast("bigint").alias("w"))
    maybe = _linked(rows, reps.select("id", "sketch"), "bucket", "sketch", BUCKET_BLOCK, near_sketches)
    near = materialise(components(maybe), "near")
    texts = docs.select(F.col("doc").alias("id"), F.col("bytes").cast("string").alias("text"))
    texts = told_apart(texts, near.select("id"), "id")[0]  # so that the texts of others are not shuffled
    links = _linked(near.join(signed.select("id", "w"), "id"), texts, "root", "set", EXACT_BYTES, near_sets, to_sets)
    sizes = members.groupBy("rep").agg(F.count("*").alias("n")).join(components(links).select(F.col("id").alias("rep"), "root"), "rep")
    sizes = materialise(sizes, "classes")
    found = with_facts(members, sizes, "rep", "n", _total(sizes, "n"), "left")
    return found.select(F.col("id").alias("doc"), F.coalesce("root", "rep").alias("class"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, class_id, keep: the least id of each document's class, and whether the document is that one.

    Two documents are linked if their five-word shingles (words: runs of letters, digits and underscores, in lower case;
    a text of fewer words is one shingle), weighted by how often they occur, have a Jaccard similarity of 0.8 or more: the
    sum of the lesser weights over that of the greater. A class is a component of links. A null or empty text, or one
    without words, is a class of its own. Ids are of any type that orders; a null one has no class and is kept. Rows
    repeated whole are one document and get the same result; rows that share an id but not the text are documents of
    their own, the one with the lesser SHA-256 first. Other columns are neither read nor returned.
    """
    docs, names = numbered(df.filter(F.col(id_col).isNotNull()), id_col, text_col)
    found = _classes(docs)
    if names is None:
        rows, found = df.select(F.col(id_col).alias("id")), found.withColumn("class_id", F.col("class").cast(df.schema[id_col].dataType))
        out = rows.join(found, F.col("id") == F.col("doc"), "left")
    else:
        least = names.select(F.col("doc").alias("class"), F.col("id").alias("class_id"))
        told = names.join(found, "doc").join(least, "class").select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), "doc", "class", "class_id")
        rows = df.select(F.col(id_col).alias("id"), text_tag(text_col).alias("tag"))
        out = rows.join(told, (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce(F.col("class") == F.col("doc"), F.lit(True)).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document is the first of its class, with all their columns.

    Documents are read as by classes(). Rows with a null id or without a word stay, those with both an id and a text that
    another row has too just once: the first by their columns as JSON.
    """
    rows, names = numbered(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    gone = materialise(_classes(rows).filter("doc <> class").select("doc"), "gone")
    own, tag, turn = (free_name(docs, x) for x in ("id", "tag", "turn"))
    if names is None:
        return without(docs, gone, id_col)
    gone = names.join(gone, "doc", "left_semi").select(F.col("id").alias(own), F.col("tag").alias(tag))
    left = docs.join(gone, (F.col(id_col) == F.col(own)) & (text_tag(text_col) == F.col(tag)), "left_anti")
    once = left.filter(F.col(id_col).isNotNull()).withColumn(tag, text_tag(text_col))
    first = F.row_number().over(W.partitionBy(id_col, tag).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    once = once.withColumn(turn, first).filter(F.col(turn) == 1).select(*docs.columns)
    return once.union(left.filter(F.col(id_col).isNull()))


#: The same by all pairs that share a shingle, and a closure over their links.
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS s FROM w),
s AS (SELECT doc_id, s, count(*) AS c FROM u GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS c FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 10 * c >= {round(10 * SIMILARITY)} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b, c FROM r JOIN both_ways ON doc_id = a)
SELECT doc_id, min(c) AS class_id, min(c) = doc_id AS keep FROM r GROUP BY doc_id
"""
