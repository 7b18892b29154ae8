"""Operator 3: exact top-k by inner product with M-trees.

Each page of vectors becomes an M-tree: nodes with a routing vector, a covering radius and the distance to the parent's
routing vector; leaves with their vectors in order of their distance to the leaf's routing vector. A query opens nodes
best first. From stored distances alone the triangle inequality tells that a node, or a stretch of a leaf, holds nothing
near enough, and what is left is computed. Bounds of distances only skip work, with some slack for their rounding;
scores are computed without rounding.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import in_batches, table
from .vectors import ROUNDING, SLACK, Space, deal, parts, search, space, valid

LEAF, FAN = 256, 16
K, EVERY, SCALE = 20, 20, 64


class Tree:
    """An M-tree of one page."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, sp: Space, seed: int = 5):
        self.sp, self.rng = sp, np.random.default_rng(seed)
        self.full = np.concatenate([x.astype("f8"), sp.rest(x)[:, None]], 1)
        self.order: list[np.ndarray] = []
        self.entry: list[np.ndarray] = []
        self.placed = 0
        #: of each node: routing row, distance to the parent's routing row, radius, first and last child or row, leaf
        self.nodes: list[list] = [[0, 0.0, 0.0, 0, 0, True]]
        if len(ids):
            self._fill(0, np.arange(len(ids)), int(self.rng.integers(len(ids))))
        order = np.concatenate([np.zeros(0, "i8"), *self.order]).astype("i8")
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        self.ids, self.x = ids[order], x[order]
        self.entry = np.concatenate([np.zeros(0), *self.entry])
        for node in self.nodes:
            node[0] = int(place[node[0]]) if len(order) else 0

    def payload(self) -> bytes:
        return pickle.dumps({"ids": self.ids, "x": self.x, "entry": self.entry, "nodes": self.nodes})

    def _far(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.full[rows] - self.full[to]) ** 2).sum(1))

    def _fill(self, node: int, rows: np.ndarray, routing: int) -> None:
        far = self._far(rows, routing)
        self.nodes[node][0], self.nodes[node][2] = routing, float(far.max())
        if len(rows) <= LEAF:
            by = np.argsort(far, kind="stable")
            self.order.append(rows[by])
            self.entry.append(far[by])
            self.nodes[node][3:] = [self.placed, self.placed + len(rows), True]
            self.placed += len(rows)
            return
        many = min(FAN, math.ceil(len(rows) / LEAF))
        chosen = rows[self.rng.choice(len(rows), many, replace=False)]
        nearest = np.stack([self._far(rows, int(c)) for c in chosen], 1).argmin(1)
        if np.bincount(nearest, minlength=many).max() == len(rows):  # copies of one vector
            nearest = np.arange(len(rows)) % many
        groups = [(int(chosen[c]), rows[nearest == c]) for c in range(many) if (nearest == c).any()]
        first = len(self.nodes)
        self.nodes[node][3:] = [first, first + len(groups), False]
        for c, _ in groups:
            self.nodes.append([c, float(self._far(np.array([c]), routing)[0]), 0.0, 0, 0, True])
        for k, (c, mine) in enumerate(groups):
            self._fill(first + k, mine, c)


class Searcher:
    """Answers blocks of queries from one tree; computed counts the inner products with stored vectors."""

    def __init__(self, payload: bytes, sp: Space, k: int = K):
        tree = pickle.loads(payload)
        self.sp, self.k, self.ids = sp, k, tree["ids"]
        self.x, self.entry = tree["x"].astype(sp.counted), tree["entry"]
        columns = list(zip(*tree["nodes"], strict=True))
        self.routing, self.parent, self.radius = np.array(columns[0]), np.array(columns[1]), np.array(columns[2])
        self.first, self.last, self.leaf = columns[3], columns[4], columns[5]
        self.computed = 0

    def __call__(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, found, scores = [], [], []
        for n, (own, v, low) in enumerate(zip(ids.tolist(), q.astype(self.sp.counted), least.tolist(), strict=True)):
            i, s = self.one(own, v, low)
            at.append(np.full(len(i), n))
            found.append(i)
            scores.append(s)
        return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

    def one(self, own: int, q: np.ndarray, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The best k ids and scores that reach `least`, without the query's own id."""
        best_i, best_s = np.zeros(0, "i8"), np.zeros(0, self.sp.counted)
        if not len(self.ids):
            return best_i, best_s
        square = float((q.astype("f8") ** 2).sum()) + self.sp.most
        wide = math.sqrt(max(0.0, square * (1 + SLACK) - 2 * least))
        slack = ROUNDING * math.sqrt(square)
        root = math.sqrt(max(0.0, square - 2 * float(self.x[self.routing[0]] @ q)))
        self.computed += 1
        heap = [(max(0.0, root - self.radius[0]), 0, root)]
        while heap:
            low, node, far = heapq.heappop(heap)
            if low > wide + slack:
                break
            a, b = self.first[node], self.last[node]
            if self.leaf[node]:
                # entries lie in order of their distance e to the routing vector; |far - e| bounds their distance
                a, b = a + int(np.searchsorted(self.entry[a:b], far - wide - slack)), a + int(np.searchsorted(self.entry[a:b], far + wide + slack, "right"))
                s = self.x[a:b] @ q
                self.computed += b - a
                keep = np.flatnonzero((s >= least) & (self.ids[a:b] != own))
                if not len(keep):
                    continue
                best_i, best_s = np.concatenate([best_i, self.ids[a:b][keep]]), np.concatenate([best_s, s[keep]])
                if len(best_s) > self.k:
                    order = np.lexsort((best_i, -best_s))[: self.k]
                    best_i, best_s = best_i[order], best_s[order]
                if len(best_s) == self.k:
                    least = max(least, float(best_s.min()))
                    wide = math.sqrt(max(0.0, square * (1 + SLACK) - 2 * least))
            else:
                bound = np.abs(far - self.parent[a:b]) - self.radius[a:b]
                for c in (np.flatnonzero(bound <= wide + slack) + a).tolist():
                    away = math.sqrt(max(0.0, square - 2 * float(self.x[self.routing[c]] @ q)))
                    self.computed += 1
                    low = max(0.0, away - self.radius[c])
                    if low <= wide + slack:
                        heapq.heappush(heap, (low, c, away))
        return best_i, best_s


def trees(pages: DataFrame, sp: Space) -> DataFrame:
    """page, payload: the tree of each page (rows: page, no, id, x)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(held), sp.stored).reshape(len(ids), sp.width)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([Tree(np.array(ids, "i8"), x, sp).payload()], pa.binary())], names=["page", "payload"])

        now, ids, held = None, [], []
        for batch in batches:
            for page, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page != now:
                    if now is not None:
                        yield made()
                    now, ids, held = page, [], []
                ids.append(i)
                held.append(x)
        if now is not None:
            yield made()

    return pages.repartition(parts(pages.sparkSession), "page").sortWithinPartitions("page", "no").select("page", "id", "x").transform(in_batches, run, "page int, payload binary")


def top_k(df: DataFrame, chosen: str, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of df that meets the condition `chosen`, its k best among all others.

    A component x counts as floor(scale * x); the score is the inner product, ties go to the smaller id. Rows with a
    null id, or a vector that is null or holds null or non-finite components, take no part; a shorter vector ends in
    zeros; an empty one scores 0. Candidates are all rows but those with the query's id, repeated ones each for itself;
    repeated query rows are one query. Other columns are neither read nor returned.
    """
    ints = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = df.filter(valid(id_col, vec_col, False)).select(F.col(id_col).cast("bigint").alias("id"), ints.alias("v"))
    queries = df.filter(valid(id_col, vec_col, False)).filter(chosen).select(F.col(id_col).cast("bigint").alias("id"), ints.alias("v"))
    sp = space(rows, True)
    pages = deal(rows, sp)
    payloads = materialise(trees(pages.rows, sp), "trees")
    return search(queries, rows, pages, payloads, lambda payload: Searcher(payload, sp, k), k, "bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), f"vec_id % {EVERY} = 0")


#: The same by all products; components are whole numbers, so that double precision is exact.
SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= {K}
"""
