"""Vectors in pages, for exact search (operator 3); reading vectors is shared with approximate search (operator 6).

The largest inner product is the least distance after one more component: with M the largest norm, x becomes
(x, sqrt(M^2 - |x|^2)) and a query (q, 0), so that their squared distance is |q|^2 + M^2 - 2 q.x. Vectors are dealt to
pivots, a bounded sample, and of each pivot's vectors a hash makes pages of bounded size; a page has a pivot and a
covering radius. Queries travel in blocks, to the pages that can hold one of their best.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .common import in_batches

#: Vectors in a page, about; pivots at most; vectors whose scores give each query a first bound.
PAGE, PIVOTS, SEEDS = 8192, 2048, 2048
#: Queries in a block; queries, about, that one copy of a page answers: more bytes of queries than a page has.
BLOCK, PER_COPY = 128, 1 << 16
#: Relative slack of squared distances, and of distances, which near nought lose half of their digits.
SLACK, ROUNDING = 1e-9, 1e-7


def valid(id_col: str, vec_col: str, zero: bool) -> Column:
    """Rows that take part: an id, and a vector without null or non-finite components (and not zero, if asked)."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))
    return good & F.exists(v, lambda x: x != 0) if zero else good


@dataclass
class Space:
    """What all tasks know: vectors, width, the largest squared norm, the type that components are stored and counted in."""

    n: int
    width: int
    most: float
    stored: str
    counted: str

    def matrix(self, rows: list) -> np.ndarray:
        """Lists of components as rows; shorter ones end in zeros."""
        if all(len(r) == self.width for r in rows):
            return np.array(rows, "f8").reshape(len(rows), self.width)
        out = np.zeros((len(rows), self.width))
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
        return out

    def rest(self, x: np.ndarray) -> np.ndarray:
        """The component that is added to each row."""
        return np.sqrt(np.maximum(0.0, self.most - (x.astype("f8") ** 2).sum(1)))


def space(rows: DataFrame, integers: bool) -> Space:
    """rows: id, v array<double>."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    got = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w"), F.max(square).alias("most"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    width, most, top = max(1, got.w or 0), got.most or 0.0, got.top or 0.0
    if not integers:
        return Space(got.n, width, most * (1 + SLACK), "f8", "f8")
    if width * top * top >= 2**63:
        raise ValueError("an inner product of these vectors does not fit a long")
    stored = next(t for t, bits in (("i1", 7), ("i2", 15), ("i4", 31), ("i8", 63)) if top < 2**bits)
    return Space(got.n, width, most, stored, "f8" if width * top * top < 2**53 else "i8")


def sampled(rows: DataFrame, most: int, seed: str) -> tuple[np.ndarray, list]:
    """Ids and vectors of at most `most` rows, by a hash of the id and vector."""
    got = rows.orderBy(F.xxhash64("id", "v", F.lit(seed)), "id").limit(most).collect()
    return np.array([r.id for r in got], "i8"), [r.v for r in got]


@dataclass
class Pages:
    """rows: page, no, id, x (stored components); of each pivot, PIVOTS at most, its vector, radius (-1 if it has no row), first page and number of pages."""

    space: Space
    rows: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    first: list[int]
    parts: list[int]


def deal(rows: DataFrame, sp: Space, page: int | None = None) -> Pages:
    """Deal vectors to the nearest of n / page pivots (at most PIVOTS), and those of each pivot evenly to pages.

    Hot pivots, as of many copies of one vector, have many pages, and so have all pivots of a very large table: what the
    tasks know of pages is bounded by PIVOTS.
    """
    page = page or PAGE
    _, picked = sampled(rows, max(1, min(PIVOTS, math.ceil(sp.n / page))), "pivots")
    pivots = sp.matrix(picked) if picked else np.zeros((1, sp.width))
    rest = sp.rest(pivots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = sp.matrix(batch.column(1).to_pylist())
            near = x @ pivots.T + np.outer(sp.rest(x), rest)
            best = near.argmax(1) if len(x) else np.zeros(0, "i8")
            distance = np.sqrt(np.maximum(0.0, 2 * sp.most - 2 * near[np.arange(len(x)), best]))
            stored = [r.tobytes() for r in x.astype(sp.stored)]
            yield pa.RecordBatch.from_arrays([pa.array(best.astype("i4")), batch.column(0), pa.array(distance), pa.array(stored, pa.binary())], names=["pivot", "id", "distance", "x"])

    dealt = materialise(rows.transform(in_batches, run, "pivot int, id bigint, distance double, x binary").withColumn("no", F.monotonically_increasing_id()), "vectors")
    told = {r.pivot: (r.n, r.r) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect()}
    parts = [max(1, math.ceil(told.get(k, (0, 0))[0] / page)) for k in range(len(pivots))]
    first = [0, *np.cumsum(parts)[:-1].tolist()]
    number = F.element_at(F.lit(first), F.col("pivot") + 1) + F.pmod(F.xxhash64("no"), F.element_at(F.lit(parts), F.col("pivot") + 1)).cast("int")
    radii = np.array([told.get(k, (0, -1.0))[1] for k in range(len(pivots))])
    return Pages(sp, dealt.select(number.cast("int").alias("page"), "no", "id", "x"), pivots, radii, first, parts)


def search(
    queries: DataFrame,
    rows: DataFrame,
    pages: Pages,
    payloads: DataFrame,
    load: Callable[[bytes], object],
    k: int,
    score: str,
) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of the candidates that the pages' searchers return.

    queries: id, v; payloads: page, payload. load(payload) makes a searcher, called with ids, vectors and least scores
    of a block; it returns (place in the block, vec_id, score) arrays. Repeated rows of one query are one query.
    """
    sp = pages.space
    seed_ids, seeds = sampled(rows, SEEDS, "seeds")
    seeds = sp.matrix(seeds).astype(sp.counted) if len(seed_ids) else np.zeros((0, sp.width), sp.counted)
    distinct = queries.dropDuplicates(["id", "v"])
    copies = max(1, math.ceil(distinct.count() / PER_COPY))
    centre, radii, first, many = pages.pivots, pages.radii, pages.first, pages.parts

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids, no = part.column(0).to_numpy(), part.column(1).to_numpy()
                q = sp.matrix(part.column(2).to_pylist())
                least = np.full(len(q), -np.inf)
                if len(seeds) > k:
                    s = (q.astype(sp.counted) @ seeds.T).astype("f8")
                    s[ids[:, None] == seed_ids[None, :]] = -np.inf
                    least = np.partition(s, -k, 1)[:, -k]
                    least -= SLACK * np.abs(least)
                square = (q**2).sum(1)[:, None] + sp.most
                low = np.maximum(0.0, np.sqrt(np.maximum(0.0, square - 2 * q @ centre.T)) - radii[None, :] - ROUNDING * np.sqrt(square))
                open_ = (low**2 <= square * (1 + SLACK) - 2 * least[:, None]) & (radii >= 0)[None, :]
                to, blobs = [], []
                for pivot in np.flatnonzero(open_.any(0)).tolist():
                    on = open_[:, pivot]
                    to += range(first[pivot], first[pivot] + many[pivot])
                    blobs += [pickle.dumps((ids[on], no[on], q[on].astype(sp.stored), least[on]))] * many[pivot]
                salt = [int(no[0]) % copies] * len(to)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(salt, pa.int32()), pa.array([1] * len(to), pa.int32()), pa.array(blobs, pa.binary())], names=["page", "salt", "kind", "payload"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = now = None
        for batch in batches:
            for page, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    searcher, now = load(payload), page
                    continue
                if page != now:
                    continue  # no vector was dealt to this page
                ids, no, q, least = pickle.loads(payload)
                at, found, scores = searcher(ids, q, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(no[at]), pa.array(found), pa.array(scores.astype("i8" if score == "bigint" else "f8"))], names=["query_id", "no", "vec_id", "score"])

    numbered = distinct.select("id", F.xxhash64("id", "v").alias("no"), "v")
    blocks = numbered.select("id", F.pmod("no", F.lit(1 << 62)).alias("no"), "v").transform(in_batches, route, "page int, salt int, kind int, payload binary")
    stored = payloads.select("page", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("salt"), F.lit(0).alias("kind"), "payload")
    met = stored.union(blocks).repartition(parts(rows.sparkSession), "page", "salt").sortWithinPartitions("page", "salt", "kind").select("page", "kind", "payload")
    found = met.transform(in_batches, work, f"query_id bigint, no bigint, vec_id bigint, score {score}")
    order = W.partitionBy("query_id", "no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
