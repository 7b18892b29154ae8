"""Operator 2: removal of byte strings that occurred earlier, by sorting suffixes.

A suffix (a document from one byte on) is removed over its first 100 bytes if one that starts earlier has the same
100. In the order of suffixes, ties by document and place, that is one whose predecessor begins alike. Not every
suffix needs to travel:

1. Neighbouring suffixes whose first 100 bytes share their least 32-byte gram (by a mixed hash) form a fragment, of 69
   suffixes at most; equal 100 bytes have the same least gram, their anchor. Fragments are dealt to partitions by
   sampled splitters over (anchor, digest, document, place), so that a hot one is divided, too, and sorted there. One
   that follows its like is removed as a whole; one whose anchor stands in other fragments, too, goes on.
2. The bytes of those are dealt and sorted in the same way. A task sorts their suffixes by multikey quicksort, eight
   bytes at a step, and removes all but the first of each tie.
3. Ties are compared across boundaries: for fragments by each partition's last key, for suffixes of an anchor that
   lies in several partitions by the digest of each distinct suffix of each partition.

No step depends on the other copies of a document being near, and no group of copies is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import free_name, in_batches, numbered, table, text_tag

LENGTH, GRAM = 100, 32
_SPAN = LENGTH - GRAM + 1
#: Bytes handled at once: the low bits of a key hold a place in them.
PART, _PLACE = 1 << 19, 20
#: Bytes of fragments whose suffixes are sorted at once, and how many of one anchor before it is divided.
SORTED_BYTES, MOST_OF_ANCHOR = 1 << 20, 1 << 13
#: Documents that are sampled for splitters, for each partition, and at least; one in so many of their fragments counts.
SAMPLED, SAMPLED_LEAST, THINNED = 32, 3000, 16
_PACK = 128
_COPY, _GO_ON, _HEAD, _TAIL = 0, 1, 2, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fragments(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents data[start:end], one after another: document number, place in data, suffixes, anchor, digest.

    A fragment of c suffixes from p on covers data[p : p + c + LENGTH - 1].
    """
    none = (np.zeros(0, "i8"),) * 5
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none
    gram = _mix(np.arange(1, 257, dtype="u8"))[np.frombuffer(data, "u1")]
    size = 1
    while size < GRAM:
        gram = gram[:-size] * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + gram[size:]
        size *= 2
    gram = _mix(gram)
    low = np.uint64((1 << _PLACE) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype="u8")
    size = 1
    while 2 * size <= _SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < _SPAN:
        least = np.minimum(least[: n], least[_SPAN - size : _SPAN - size + n])
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    whole = np.flatnonzero(ends - starts >= LENGTH)
    change[starts[whole]] = True
    after = ends[whole] - LENGTH + 1
    change[after[after < n]] = True
    bounds = np.append(np.flatnonzero(change), n)
    doc = np.searchsorted(starts, bounds[:-1], "right") - 1
    inside = bounds[:-1] + LENGTH <= ends[doc]
    at, count, doc = bounds[:-1][inside], np.diff(bounds)[inside], doc[inside]
    anchor = gram[(least[at] & low).astype("i8")].astype("i8")
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(view[a:b]) for a, b in zip(at.tolist(), (at + count + LENGTH - 1).tolist(), strict=True)), "u8", len(at)).astype("i8")
    return doc, at, count, anchor, digests


def _cut(docs: Iterable[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    """doc, place, suffixes, anchor, digest of the fragments of whole documents, some documents or a part at a time."""

    def done() -> tuple[np.ndarray, ...]:
        starts = np.array(offsets, "i8")
        doc, at, *rest = fragments(b"".join(held), starts, np.append(starts[1:], size))
        return np.array(ids, "i8")[doc], at - starts[doc], *rest

    ids, held, offsets, size = [], [], [], 0
    for i, text in docs:
        if len(text) > PART:
            for begin in range(0, len(text) - LENGTH + 1, PART):
                part = text[begin : begin + PART + LENGTH - 1]
                doc, at, *rest = fragments(part, np.zeros(1, "i8"), np.array([len(part)]))
                yield np.full(len(doc), i, "i8"), at + begin, *rest
        elif len(text) >= LENGTH:
            if size + len(text) > PART:
                yield done()
                ids, held, offsets, size = [], [], [], 0
            ids.append(i)
            held.append(text)
            offsets.append(size)
            size += len(text)
    if held:
        yield done()


def _fragment_rows(docs: DataFrame, splitters: list[np.ndarray] | None, thinned: int = 1) -> DataFrame:
    """docs (doc bigint, bytes binary) -> part, m (anchor), h (digest), doc, pc (place * 128 + suffixes).

    Of `thinned` rows one is given, chosen by a hash of document and place.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, at, count, m, h in _cut(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                pc = at * _PACK + count
                if thinned > 1:
                    chosen = _mix((doc * 0x9E3779B1 + pc).astype("u8")) % np.uint64(thinned) == 0
                    m, h, doc, pc = (x[chosen] for x in (m, h, doc, pc))
                part = _part_of(splitters, m, h, doc, pc) if splitters else np.zeros(len(m), "i4")
                yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), pa.array(m), pa.array(h), pa.array(doc), pa.array(pc)], names=["part", "m", "h", "doc", "pc"])

    return docs.select("doc", "bytes").transform(in_batches, run, "part int, m bigint, h bigint, doc bigint, pc bigint")


def _part_of(splitters: list[np.ndarray], *keys: np.ndarray) -> np.ndarray:
    """How many splitters are <= each key, all columns counting in their order."""
    low = np.searchsorted(splitters[0], keys[0], "left")
    tied = np.flatnonzero(low < np.searchsorted(splitters[0], keys[0], "right"))
    part, tied_keys = low.astype("i4"), [x[tied] for x in keys]
    if len(tied):
        for splitter in zip(*splitters, strict=True):
            reached, equal = np.zeros(len(tied), bool), tied_keys[0] == splitter[0]
            if not equal.any():
                continue
            for x, s in zip(tied_keys[1:], splitter[1:], strict=True):
                reached |= equal & (x > s)
                equal &= x == s
            part[tied] += reached | equal
    return part


def _splitters(docs: DataFrame, parts: int) -> list[np.ndarray] | None:
    """parts - 1 keys that divide the fragments of sampled documents evenly; None if one partition will do.

    Some 32 documents a partition are sampled by a hash of their numbers. They only balance the partitions.
    """
    n = docs.count()
    if parts < 2 or n < 2:
        return None
    share = min(1.0, max(SAMPLED_LEAST, SAMPLED * parts) / n)
    chosen = docs.filter(F.pmod(F.xxhash64("doc", F.lit("splitters")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    got = _fragment_rows(chosen, None, THINNED).drop("part").toArrow()
    keys = [got.column(c).to_numpy() for c in ("m", "h", "doc", "pc")]
    order = np.lexsort(keys[::-1])
    if not len(order):
        return None
    picks = order[len(order) * np.arange(1, parts) // parts]
    return [k[picks] for k in keys]


class _Runs:
    """Reads fragments in their order; tells copies, and those whose anchor other fragments have, too."""

    def __init__(self) -> None:
        self.first = True
        self.key: tuple[int, int] | None = None
        self.held: tuple | None = None  # the last fragment that is no copy, and whether it has been told

    def read(self, m: np.ndarray, h: np.ndarray, doc: np.ndarray, pc: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (h[1:] != h[:-1])
        if self.key is not None:
            new[0] = (int(m[0]), int(h[0])) != self.key
        self.key = int(m[-1]), int(h[-1])
        yield _COPY, tuple(x[~new] for x in (m, h, doc, pc))
        cols = [x[new] for x in (m, h, doc, pc)]
        told = np.zeros(len(cols[0]), bool)
        if self.first:
            yield _HEAD, tuple(x[:1] for x in cols)
            told[0], self.first = True, False
        if self.held is not None:
            cols = [np.concatenate([[x], c]) for x, c in zip(self.held[0], cols, strict=True)]
            told = np.concatenate([[self.held[1]], told])
        if not len(told):
            return
        same = cols[0][1:] == cols[0][:-1]
        go_on = np.append(same, False) | np.append(False, same)
        yield _GO_ON, tuple(x[go_on & ~told] for x in cols)
        self.held = tuple(int(x[-1]) for x in cols), bool(told[-1] or go_on[-1])

    def end(self) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        if self.held is not None:
            row = tuple(np.array([x], "i8") for x in self.held[0])
            if not self.held[1]:  # the next partition may go on with this anchor
                yield _GO_ON, row
            yield _TAIL, (*(np.array([x], "i8") for x in self.key), row[2], row[3])


def _compared(rows: DataFrame, parts: int) -> DataFrame:
    """kind, part, m, h, doc, pc: fragments that are copies or go on, and each partition's head and tail."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, part = _Runs(), TaskContext.get().partitionId()

        def made(found: Iterator[tuple[int, tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
            for kind, cols in found:
                if k := len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, "i4")), pa.array(np.full(k, part, "i4")), *map(pa.array, cols)], names=["kind", "part", "m", "h", "doc", "pc"])

        for batch in batches:
            if batch.num_rows:
                yield from made(runs.read(*(c.to_numpy() for c in batch.columns)))
        yield from made(runs.end())

    dealt = rows.repartitionById(parts, F.col("part")).select("m", "h", "doc", "pc").sortWithinPartitions("m", "h", "doc", "pc")
    return dealt.transform(in_batches, run, "kind int, part int, m bigint, h bigint, doc bigint, pc bigint")


def _packed(docs: DataFrame) -> DataFrame:
    """docs with their bytes compressed, for a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc", "packed"])

    return docs.select("doc", "bytes").transform(in_batches, run, "doc bigint, packed binary")


def _with_bytes(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """m, doc, pc, bytes of the chosen fragments (m, doc, pc), from the documents' texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, packed, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = open_.decompress(packed)
                m, pc = [r["m"] for r in rows], [r["pc"] for r in rows]
                got = [text[x // _PACK : x // _PACK + x % _PACK + LENGTH - 1] for x in pc]
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array([doc] * len(m), pa.int64()), pa.array(pc, pa.int64()), pa.array(got, pa.binary())], names=["m", "doc", "pc", "bytes"])

    by_doc = chosen.groupBy("doc").agg(F.collect_list(F.struct("m", "pc")).alias("rows"))
    return _packed(docs).join(by_doc, "doc").select("doc", "packed", "rows").transform(in_batches, run, "m bigint, doc bigint, pc bigint, bytes binary")


def multikey_ties(data: bytes, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings data[at : at + length] of each group by multikey quicksort over words of eight bytes.

    Each step divides the ties that are left by their next word; what stands alone is done. Strings must be given in
    the order that breaks ties. Returns the places (in `at`) of strings equal to an earlier one of their group, and
    those of the first of such ties.
    """
    buffer = np.frombuffer(data + bytes(8), "u1")
    words = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    left, tie = np.arange(len(at)), np.unique(group, return_inverse=True)[1].astype("i8")
    for k in range(-1, -(-length // 8)):
        if k >= 0:
            word = words[at[left] + 8 * k].astype("u8")
            if (rest := length - 8 * k) < 8:
                word &= np.uint64(((1 << 8 * rest) - 1) << 8 * (8 - rest))
            order = np.lexsort((word, tie))
        else:
            word, order = np.zeros(len(left), "u8"), np.argsort(tie, kind="stable")
        left, tie, word = left[order], tie[order], word[order]
        new = np.ones(len(left), bool)
        new[1:] = (tie[1:] != tie[:-1]) | (word[1:] != word[:-1])
        alone = new & np.append(new[1:], True)
        left, new = left[~alone], new[~alone]
        tie = np.cumsum(new)
    return left[~new], left[new]


def _merged(doc: np.ndarray, place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, end of the unions of [place, place + length)."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + length)
    return doc[new], place[new], place[np.append(new[1:], True)[: len(new)]] + length


def _suffixes_compared(rows: DataFrame) -> DataFrame:
    """rows (m, doc, pc, bytes) -> doc, start, end to be removed; or bucket, packed.

    packed holds, for a range of digests, the digest, document and place of suffixes that are the first of their like in
    their task and whose anchor other tasks may have, too.
    """
    buckets = _parts(rows.sparkSession)

    def settle(held: list[tuple], divided: set[int]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        m, doc, pc, bytes_ = zip(*held, strict=True)
        m, doc, pc = np.array(m, "i8"), np.array(doc, "i8"), np.array(pc, "i8")
        count, sizes = pc % _PACK, np.array([len(x) for x in bytes_])
        owner = np.repeat(np.arange(len(m)), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        place = (pc // _PACK)[owner] + within
        order = np.lexsort((place, doc[owner]))
        owner, within, place = owner[order], within[order], place[order]
        at = (np.cumsum(sizes) - sizes)[owner] + within
        data = b"".join(bytes_)
        later, _ = multikey_ties(data, at, m[owner])
        d, a, b = _merged(doc[owner[later]], place[later])
        yield _spans(d, a, b)
        if divided:
            mask = np.isin(m[owner], np.array(sorted(divided), "i8"))
            mask[later] = False
            rest = np.flatnonzero(mask)
            if len(rest):
                view = memoryview(data)
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[x : x + LENGTH]) for x in at[rest].tolist()), "<i8").reshape(-1, 2)
                packed = np.concatenate([keys, doc[owner[rest]][:, None], place[rest][:, None]], 1)
                to = (keys[:, 0] % buckets).astype("i4")
                packed, to = packed[by := np.argsort(to, kind="stable")], to[by]
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                blobs = [x.tobytes() for x in np.split(packed, cuts[1:])]
                none = pa.nulls(len(cuts), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(to[cuts]), pa.array(blobs, pa.binary())], names=["doc", "start", "end", "bucket", "packed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, of_now = [], 0, None, 0
        divided: set[int] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if size >= SORTED_BYTES:
                        yield from settle(held, divided)
                        held, size, divided = [], 0, set()
                    if now is None:
                        divided.add(row[0])  # may have begun in the partition before
                    now, of_now = row[0], 0
                elif of_now >= MOST_OF_ANCHOR:
                    divided.add(now)
                    yield from settle(held, divided)
                    held, size, of_now, divided = [], 0, 0, {now}
                held.append(row)
                size += len(row[3])
                of_now += 1
        if now is not None:
            divided.add(now)  # may go on in the next partition
        yield from settle(held, divided)

    dealt = rows.repartitionByRange(_parts(rows.sparkSession), "m", "doc", "pc").sortWithinPartitions("m", "doc", "pc")
    return dealt.transform(in_batches, run, "doc bigint, start bigint, end bigint, bucket int, packed binary")


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "start", "end", "bucket", "packed"])


def _across(packed: DataFrame) -> DataFrame:
    """doc, start, end of suffixes (bucket, packed) that another task has earlier.

    A task has each suffix at most once, so what one digest gathers is bounded by the number of tasks.
    """

    def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if blobs:
            k1, k2, doc, place = np.frombuffer(b"".join(blobs), "i8").reshape(-1, 4).T
            order = np.lexsort((place, doc, k2, k1))
            later = order[1:][(k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])]
            doc, start, end = _merged(doc[later], place[later])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc", "start", "end"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from settle(held)
                    now, held = bucket, []
                held.append(blob)
        yield from settle(held)

    dealt = packed.repartition(_parts(packed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.transform(in_batches, run, "doc bigint, start bigint, end bigint")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def removed(docs: DataFrame) -> DataFrame:
    """doc, spans array<struct<start, end>> of documents (doc unique bigint, bytes binary) that lose bytes.

    Spans may overlap; their union is what is covered by a 100-byte string that also starts earlier.
    """
    spark = docs.sparkSession
    parts = _parts(spark)
    splitters = _splitters(docs, parts)
    found = materialise(_compared(_fragment_rows(docs, splitters), len(splitters[0]) + 1 if splitters else 1), "fragments")
    copies, go_on, tail = [], [], None  # heads, at most one for each partition, against the tail before
    for r in sorted(found.filter(F.col("kind").isin(_HEAD, _TAIL)).collect(), key=lambda r: (r.part, r.kind)):
        if r.kind == _TAIL:
            tail = (r.m, r.h)
        else:
            (copies if (r.m, r.h) == tail else go_on).append((r.m, r.doc, r.pc))
    plain = found.filter(F.col("kind") == _COPY).select("m", "doc", "pc").union(spark.createDataFrame(copies, "m bigint, doc bigint, pc bigint"))
    chosen = found.filter(F.col("kind") == _GO_ON).select("m", "doc", "pc").union(spark.createDataFrame(go_on, "m bigint, doc bigint, pc bigint"))
    suffixes = materialise(_suffixes_compared(materialise(_with_bytes(docs, chosen), "candidates")), "suffixes")
    across = _across(suffixes.filter("packed IS NOT NULL").select("bucket", "packed"))
    place = F.floor(F.col("pc") / _PACK).cast("bigint")
    spans = (
        plain.select("doc", place.alias("start"), (place + F.col("pc") % _PACK + LENGTH - 1).alias("end"))
        .union(suffixes.filter("packed IS NULL").select("doc", "start", "end"))
        .union(across.select("doc", "start", "end"))
    )
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def cover(size: int, spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the spans cover in a text of `size` bytes."""
    if not spans:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    edge = np.zeros(size + 1, "i4")
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["end"] for s in spans], -1)
    inside = np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype("i1"), [0]]))
    return np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)


def keep(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """What is left of a text without its removed runs."""
    return b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True))


def strip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, kept binary: one row for each row of df.

    A null text is an empty one; a text of under 100 bytes loses nothing. Rows repeated whole are one document and
    get the same result; of rows that share an id, those with the lesser SHA-256 of their text come first; a null id
    comes before all others. Other columns are neither read nor returned. Everything is exact up to collisions of
    128 bits of digest.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = open_.decompress(packed)
                starts, ends = cover(len(text), spans)
                kept = keep(text, starts, ends)
                rows.append((len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    docs, names = numbered(df, id_col, text_col)
    found = _packed(docs).join(removed(docs), "doc", "left").select("doc", "packed", "spans")
    found = found.transform(in_batches, run, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    kind = df.schema[id_col].dataType
    if names is None:
        return found.withColumnRenamed("doc", id_col).withColumn(id_col, F.col(f"`{id_col}`").cast(kind))
    rows = df.select(F.col(id_col).alias("id"), text_tag(text_col).alias("tag"))
    by_row = names.join(found, "doc").drop("doc").withColumnsRenamed({"id": "_id", "tag": "_tag"})
    out = rows.join(by_row, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(table(spark, sf_dir, "documents")).drop("kept")


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its texts stripped and all its columns; n_chars, where there is such a column, counts the new text.

    Bytes of a character that lost another of its bytes go with it. A null text stays null; ids are read as by strip().
    """
    names, extra = docs.columns, free_name(docs, "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            out = []
            for text, found in zip(texts, batch.column(len(names)).to_pylist(), strict=True):
                if found:
                    data = text.encode()
                    text = keep(data, *cover(len(data), found)).decode(errors="ignore")
                out.append(text)
            columns = [pa.array(out, pa.string()) if c == text_col else batch.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows, shared = numbered(docs, id_col, text_col)
    spans = removed(rows).select("doc", F.col("spans").alias(extra))
    if shared is None:
        number = free_name(docs, "doc")
        spans = spans.withColumnRenamed("doc", number)
        met = docs.join(spans, F.col(id_col).cast("bigint") == F.col(number), "left")
    else:
        own, tag = free_name(docs, "id"), free_name(docs, "tag")
        spans = shared.join(spans, "doc").select(F.col("id").alias(own), F.col("tag").alias(tag), extra)
        met = docs.join(spans, F.col(id_col).eqNullSafe(F.col(own)) & (text_tag(text_col) == F.col(tag)), "left")
    out = met.select(*names, extra).transform(in_batches, run, docs.schema)
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out



#: The same by one window over all 100-byte strings; kept bytes are joined as hexadecimal text.
SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, b[p + 1:p + {LENGTH}] AS s FROM d, unnest(range(0, octet_length(b) - {LENGTH - 1})) AS t(p)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
m AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH}, true) AS new FROM r),
g AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
x AS (SELECT doc_id, run, min(p) AS a, max(p) + {LENGTH} AS e FROM g GROUP BY ALL),
k AS (SELECT d.doc_id, coalesce(run, 0) AS run, coalesce(a, octet_length(b)) AS a, coalesce(lag(e) OVER o, 0) AS before, e, hex(b) AS h, octet_length(b) AS n,
  lead(run) OVER o IS NULL AS last FROM d LEFT JOIN x USING (doc_id) WINDOW o AS (PARTITION BY d.doc_id ORDER BY run))
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_bytes, CAST(coalesce(sum(e - a), 0) AS BIGINT) AS n_removed, count(e) AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN last AND e IS NOT NULL THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY run))) AS kept_sha256
FROM k GROUP BY doc_id
"""
