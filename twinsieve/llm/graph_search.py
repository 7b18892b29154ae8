"""Operator 6: approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node of one graph over the whole table. Each round of NN-descent joins the links of the graph with
themselves: at every node some of its neighbours, either way, meet, and each learns of the others that are nearer than
what it has. Links keep their scores, pairs that have met don't meet again, and rounds end when hardly any link is new.

Queries search the graph greedily, all at once in steps: of the best nodes that a query knows, those not yet opened are
opened, what they link to is scored where it is stored, and what is good enough comes back with its own links. Nodes
are stored in pages by number, so that no page is hot; a step sends a query only to pages that hold what it asks for,
and each page once, whatever the number of queries. A search ends when the best nodes that it holds have all been opened.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import drop_path, materialise
from .common import in_batches, table, with_facts
from .vectors import Space, parts, sampled, space, valid

#: Neighbours of a node; new and old links of it that a round follows, each way; links of a node in a search.
NEIGHBOURS, FOLLOWED, LINKS = 24, 14, 56
#: Of what a node could learn at one meeting, the nearest that it does learn.
LEARNT = 8
#: At the start nodes meet in groups of about so many, by so many hashes.
GROUP, GROUPINGS = 128, 4
#: Rounds end when less than this share of all links has not met.
DONE = 0.05
#: Nodes that a search holds, opens at a step, and begins with; nodes among which each query finds those.
HELD, OPENED, ENTRIES, SEEDS = 128, 40, 16, 1024
#: Queries in a block, nodes in a page.
BLOCK, PAGE = 64, 8192
K, EVERY = 20, 20
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def _replaced(df: DataFrame, old: DataFrame | None, what: str) -> DataFrame:
    """materialise(), after which the files of `old`, which df was made from, are deleted."""
    out = materialise(df, what)
    files = old.inputFiles() if old is not None else []
    if files:
        drop_path(df.sparkSession, files[0].rpartition("/")[0])
    return out


def _grouped(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Tables of whole runs of equal values in a sorted column, some runs at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left")) if key[0] != key[-1] else 0
        if held and held[-1].column(column)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def nodes_of(rows: DataFrame, sp: Space, k: int = K) -> DataFrame:
    """u, ids (the k + 1 least), x (stored components), unit (half-precision, for the graph), asked: a row for each vector.

    rows: id, v, asked (boolean). A vector's other ids can't be among k results: more than k lesser ones tie with them.
    """
    rank = F.row_number().over(W.partitionBy("v").orderBy("id"))
    distinct = rows.groupBy("id", "v").agg(F.max("asked").alias("asked"))
    few = distinct.select("id", "v").withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = distinct.filter("asked").groupBy("v").agg(F.count("*").alias("asked"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = sp.matrix(batch.column(0).to_pylist())
            unit = np.concatenate([x, sp.rest(x)[:, None]], 1) / max(1e-300, sp.most) ** 0.5
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x.astype(sp.stored)], pa.binary()), pa.array([r.tobytes() for r in unit.astype("f2")], pa.binary()), batch.column(2)], names=["ids", "x", "unit", "asked"])

    made = few.join(asked, "v", "left").select("v", "ids", F.coalesce("asked", F.lit(0)).alias("asked"))
    made = made.transform(in_batches, run, "ids array<bigint>, x binary, unit binary, asked bigint")
    return materialise(made.withColumn("u", F.monotonically_increasing_id()), "nodes")


def meetings(members: DataFrame, width: int) -> DataFrame:
    """u, v, d (negative score): what members (place, u, new, worst, unit) of a place learn of each other.

    Of two old members nothing new is learnt; of others what is nearer than the member's worst neighbour.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches):
            place, u, new, worst = (part.column(c).to_numpy() for c in ("place", "u", "new", "worst"))
            unit = np.frombuffer(b"".join(part.column("unit").to_pylist()), "f2").reshape(len(u), width + 1).astype("f4")
            ends = np.append(np.flatnonzero(np.diff(place, prepend=place[0] - 1)), len(u))
            out = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                d = -(unit[a:b] @ unit[a:b].T)
                d[~((d < worst[a:b, None]) & (new[a:b, None] | new[None, a:b]) & (u[a:b, None] != u[None, a:b]))] = np.inf
                if len(d) > LEARNT:
                    j = np.argpartition(d, LEARNT - 1, 1)[:, :LEARNT]
                    i = np.repeat(np.arange(b - a), LEARNT)
                    j = j.ravel()
                    ok = d[i, j] < np.inf
                    i, j = i[ok], j[ok]
                else:
                    i, j = np.nonzero(d < np.inf)
                out.append((u[a:b][i], u[a:b][j], d[i, j]))
            if out:
                some = [np.concatenate([o[k] for o in out]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(*some, np.zeros(len(some[0]), "u1"), NEIGHBOURS)[:3]], names=["u", "v", "d"])

    n = parts(members.sparkSession)
    dealt = members.select("place", "u", "new", "worst", "unit").repartition(n, "place").sortWithinPartitions("place")
    return dealt.transform(in_batches, run, "u bigint, v bigint, d float")


def _best(u: np.ndarray, v: np.ndarray, d: np.ndarray, rest: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """u, v, d, rest of each u's nearest `most` distinct v; of repeated pairs the first by rest."""
    order = np.lexsort((rest, v, u))
    u, v, d, rest = (x[order] for x in (u, v, d, rest))
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, d, rest = (x[new] for x in (u, v, d, rest))
    order = np.lexsort((v, d, u))
    u, v, d, rest = (x[order] for x in (u, v, d, rest))
    near = np.arange(len(u)) - np.searchsorted(u, u) < most
    return u[near], v[near], d[near], rest[near]


#: unit, then the neighbours' numbers, distances, and whether each is new, as bytes.
_STATE = "u bigint, unit binary, v binary, d binary, new binary"


def _flat(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """owner (row), v, d, new of the neighbours of state rows."""
    v, d, new = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("v", "i8"), ("d", "f4"), ("new", "u1")))
    return np.repeat(np.arange(part.num_rows), [len(x) for x in part.column("new").to_pylist()]), v, d, new


def _followed(u: np.ndarray, v: np.ndarray, new: np.ndarray, turn: int) -> np.ndarray:
    """Which links (u, v) this round follows: of each u FOLLOWED new and FOLLOWED old ones, by a hash."""
    hashed = (v.astype("u8") * np.uint64(0x9E3779B97F4A7C15) ^ u.astype("u8")) * np.uint64(0xBF58476D1CE4E5B9 + 2 * turn)
    order = np.lexsort((hashed >> np.uint64(20), new, u))
    key = u[order] * 2 + new[order]
    out = np.zeros(len(u), bool)
    out[order] = np.arange(len(u)) - np.searchsorted(key, key) < FOLLOWED
    return out


def _links(state: DataFrame, turn: int) -> DataFrame:
    """place, u, new: links that this round follows: u is a neighbour of place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, v, _, new = _flat(batch)
            u = batch.column("u").to_numpy()[owner]
            on = _followed(u, v, new, turn)
            yield pa.RecordBatch.from_arrays([pa.array(u[on]), pa.array(v[on]), pa.array(new[on] > 0)], names=["place", "u", "new"])

    return state.transform(in_batches, run, "place bigint, u bigint, new boolean")


def _merged(state: DataFrame, learnt: DataFrame, turn: int) -> DataFrame:
    """The state after a round: new links that were followed are old, the nearest of known and learnt ones stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches):
            kind = part.column("kind").to_numpy()
            rows, more = part.filter(pa.array(kind == 0)), part.filter(pa.array(kind == 1))
            ids = rows.column("u").to_numpy()
            owner, v, d, new = _flat(rows)
            fresh = new.astype(bool)
            fresh[_followed(ids[owner], v, new, turn)] = False
            # rest: 0 for an old link, 1 for a new one, 2 for one that is learnt now
            got = _best(*(np.concatenate(x) for x in ((ids[owner], more.column("u").to_numpy()), (v, more.column("w").to_numpy()), (d, more.column("e").to_numpy()), (fresh.astype("u1"), np.full(more.num_rows, 2, "u1")))), NEIGHBOURS)
            cuts = np.searchsorted(got[0], np.append(ids, ids[-1:] + 1)) if len(ids) else np.zeros(1, "i8")
            blobs = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (got[1], got[2].astype("f4"), (got[3] > 0).astype("u1"))]
            columns = [pa.array(ids, pa.int64()), pa.array(rows.column("unit").to_pylist(), pa.binary()), *(pa.array(x, pa.binary()) for x in blobs)]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "unit", "v", "d", "new"])

    none = [F.lit(None).cast(t).alias(c) for c, t in (("unit", "binary"), ("v", "binary"), ("d", "binary"), ("new", "binary"))]
    both = state.select("u", F.lit(0).alias("kind"), "unit", "v", "d", "new", F.lit(None).cast("bigint").alias("w"), F.lit(None).cast("float").alias("e"))
    both = both.union(learnt.select("u", F.lit(1).alias("kind"), *none, F.col("v").alias("w"), F.col("d").alias("e")))
    return both.repartition(parts(state.sparkSession), "u").sortWithinPartitions("u", "kind").transform(in_batches, run, _STATE)


def descend(nodes: DataFrame, sp: Space, n: int) -> DataFrame:
    """u, unit, v, d, new: the neighbour graph of nodes (u, unit), nearest first."""
    empty = F.lit(b"")
    state = nodes.select("u", "unit", empty.alias("v"), empty.alias("d"), empty.alias("new"))
    groups = max(1, n // GROUP)
    places = F.array(*[F.pmod(F.xxhash64("u", F.lit(j)), F.lit(groups)) * GROUPINGS + j for j in range(GROUPINGS)])
    first = nodes.select(F.explode(places).alias("place"), "u", F.lit(True).alias("new"), F.lit(3.0).cast("float").alias("worst"), "unit")
    state, turn = materialise(_merged(state, meetings(first, sp.width), 0), "graph"), 0
    while (state.agg(F.sum(F.octet_length(F.regexp_replace(F.hex("new"), "00", "")))).first()[0] or 0) // 2 > DONE * n * min(NEIGHBOURS, n):
        turn += 1
        forward = materialise(_links(state, turn), "links")
        drawn = F.row_number().over(W.partitionBy("place", "new").orderBy(F.xxhash64("place", "u", F.lit(turn)), "u"))
        back = forward.select(F.col("u").alias("place"), F.col("place").alias("u"), "new").withColumn("r", drawn).filter(F.col("r") <= FOLLOWED).drop("r")
        members = forward.union(back)
        lively = members.groupBy("place").agg(F.max("new").alias("any")).filter("any")
        members = members.join(lively.select("place"), "place", "left_semi")
        full = F.octet_length("new") >= NEIGHBOURS
        worst = _worst(state.select("u", "unit", F.when(full, F.substring("d", 4 * NEIGHBOURS - 3, 4)).alias("last")))
        members = members.join(worst, "u").select("place", "u", "new", "worst", "unit")
        old, state = state, _replaced(_merged(state, meetings(members, sp.width), turn), state, "graph")
        drop_path(old.sparkSession, forward.inputFiles()[0].rpartition("/")[0]) if forward.inputFiles() else None
    return state


def _worst(rows: DataFrame) -> DataFrame:
    """u, unit, worst: the distance in `last`, or more than any if a node has not all neighbours."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst = np.array([np.frombuffer(x, "f4")[0] if x else 3.0 for x in batch.column(2).to_pylist()], "f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(worst)], names=["u", "unit", "worst"])

    return rows.transform(in_batches, run, "u bigint, unit binary, worst float")


def _exploded(state: DataFrame) -> DataFrame:
    """u, v, d of all links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, v, d, _ = _flat(batch)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("u").to_numpy()[owner]), pa.array(v), pa.array(d)], names=["u", "v", "d"])

    return state.transform(in_batches, run, "u bigint, v bigint, d float")


def graph_pages(nodes: DataFrame, state: DataFrame, sp: Space, pages: int) -> DataFrame:
    """page, payload: numbers, vectors and links of a page's nodes: their neighbours, and the nearest nodes they are neighbours of."""
    links = _exploded(state)
    order = W.partitionBy("u").orderBy("d", "v")
    back = links.select(F.col("v").alias("u"), F.col("u").alias("v"), "d").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= LINKS - NEIGHBOURS)
    back = back.groupBy("u").agg(F.collect_list("v").alias("back"))
    linked = state.select("u", "v").join(back, "u", "left")
    rows = nodes.select("u", "x").join(linked, "u").withColumn("page", F.pmod("u", F.lit(pages)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches):
            page, u = part.column("page").to_numpy(), part.column("u").to_numpy()
            x = np.frombuffer(b"".join(part.column("x").to_pylist()), sp.stored).reshape(len(u), sp.width)
            own = np.full((len(u), LINKS), -1, "i8")
            for k, (near, back) in enumerate(zip(part.column("v").to_pylist(), part.column("back").to_pylist(), strict=True)):
                vs = np.frombuffer(near, "i8")
                vs = np.concatenate([vs, np.setdiff1d(np.array(back or [], "i8"), vs)])
                own[k, : len(vs)] = vs
            ends = np.append(np.flatnonzero(np.diff(page, prepend=page[0] - 1)), len(u))
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(page[a])], pa.int64()), pa.array([pickle.dumps((u[a:b], x[a:b], own[a:b]))], pa.binary())], names=["page", "payload"])

    dealt = rows.select("page", "u", "x", "v", "back").repartition(parts(nodes.sparkSession), "page").sortWithinPartitions("page", "u")
    return dealt.transform(in_batches, run, "page bigint, payload binary")


class Block:
    """Some queries and what they know: the best nodes found, which of them are opened, and those nodes' links."""

    def __init__(self, u: np.ndarray, q: np.ndarray, entries: np.ndarray, held: int):
        n = len(u)
        self.u, self.q = u, q
        self.pool, self.score = np.full((n, held), -1, "i8"), np.full((n, held), -np.inf)
        self.opened, self.links = np.ones((n, held), bool), np.full((n, held, LINKS), -1, "i8")
        self.ask = [np.unique(np.append(e, own)) for e, own in zip(entries, u, strict=True)]

    @classmethod
    def load(cls, payload: bytes) -> Block:
        block = cls.__new__(cls)
        block.__dict__ = pickle.loads(payload)
        return block

    def least(self) -> np.ndarray:
        return self.score.min(1)

    def messages(self, pages: int) -> Iterator[tuple[int, bytes]]:
        """page, (queries, their vectors and least scores, nodes asked for, of which query each is)."""
        owner = np.repeat(np.arange(len(self.u)), [len(a) for a in self.ask])
        asked = np.concatenate([np.zeros(0, "i8"), *self.ask]).astype("i8")
        page = asked % pages
        order = np.argsort(page, kind="stable")
        owner, asked, page = owner[order], asked[order], page[order]
        cuts = np.append(np.flatnonzero(np.diff(page, prepend=-1)), len(page))
        least = self.least()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows, at = np.unique(owner[a:b], return_inverse=True)
            yield int(page[a]), pickle.dumps((rows, self.q[rows], least[rows], asked[a:b], at))

    def learn(self, rows: np.ndarray, nodes: np.ndarray, scores: np.ndarray, links: np.ndarray) -> None:
        """Keep the best of what is known and what was answered: distinct nodes of a row, none of them known to it."""
        order = np.argsort(rows, kind="stable")
        rows, nodes, scores, links = rows[order], nodes[order], scores[order], links[order]
        held = self.pool.shape[1]
        cuts = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r = rows[a]
            s = np.concatenate([self.score[r], scores[a:b]])
            top = np.argpartition(-s, held - 1)[:held] if len(s) > held else np.arange(len(s))
            self.pool[r], self.score[r] = np.concatenate([self.pool[r], nodes[a:b]])[top], s[top]
            self.opened[r] = np.concatenate([self.opened[r], np.zeros(b - a, bool)])[top]
            self.links[r] = np.concatenate([self.links[r], links[a:b]])[top]

    def open(self) -> None:
        """Open each query's best nodes that aren't yet, and ask for what they link to."""
        ready = np.where(self.opened, -np.inf, self.score)
        many = min(OPENED, ready.shape[1])
        best = np.argpartition(-ready, many - 1, 1)[:, :many]
        for r in range(len(self.u)):
            chosen = best[r][ready[r, best[r]] > -np.inf]
            self.opened[r, chosen] = True
            self.ask[r] = np.setdiff1d(self.links[r, chosen], np.append(self.pool[r], -1))


_STEP = "kind int, key bigint, payload binary"


def _told(block: Block, number: int, pages: int) -> pa.RecordBatch:
    """Rows of a step: kind 0: the block; kind 1: its messages, by page."""
    keys, blobs = [number], [b""]
    for page, blob in block.messages(pages):
        keys.append(page)
        blobs.append(pickle.dumps((number, blob)))
    block.ask = [a[:0] for a in block.ask]
    blobs[0] = pickle.dumps(block.__dict__)
    return pa.RecordBatch.from_arrays([pa.array([0] + [1] * (len(keys) - 1), pa.int32()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "key", "payload"])


def found(nodes: DataFrame, graph: DataFrame, sp: Space, pages: int, k: int) -> DataFrame:
    """q (number of the asking node), u, score: the nearest nodes that each asking node finds, itself among them."""
    spark = nodes.sparkSession
    seeds = nodes.orderBy(F.xxhash64("u"), "u").select("u", "x").limit(SEEDS).collect()
    seed_u = np.array([r.u for r in seeds], "i8")
    seed_x = np.frombuffer(b"".join([bytes(r.x) for r in seeds]), sp.stored).reshape(len(seeds), sp.width).astype("f8")

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                q = np.frombuffer(b"".join(part.column(1).to_pylist()), sp.stored).reshape(part.num_rows, sp.width).astype("f8")
                s = q @ seed_x.T
                many = min(ENTRIES, len(seed_u))
                yield _told(Block(part.column(0).to_numpy(), q, seed_u[np.argpartition(-s, many - 1, 1)[:, :many]], HELD), number, pages)
                number += 1

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for kind, page, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    now, (own, x, links) = page, pickle.loads(payload)
                    x = x.astype("f8")
                elif page == now:
                    number, blob = pickle.loads(payload)
                    rows, q, least, asked, at = pickle.loads(blob)
                    place = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                    s = np.einsum("nd,nd->n", x[place], q[at])
                    ok = (own[place] == asked) & (s > least[at])
                    blob = pickle.dumps((rows[at[ok]], asked[ok], s[ok], links[place[ok]]))
                    yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([number], pa.int64()), pa.array([blob], pa.binary())], names=["kind", "key", "payload"])

    def onward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = number = None
        for batch in batches:
            for kind, key, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if block is not None:
                        block.open()
                        yield _told(block, number, pages)
                    block, number = Block.load(payload), key
                else:
                    block.learn(*pickle.loads(payload))
        if block is not None:
            block.open()
            yield _told(block, number, pages)

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                block = Block.load(payload)
                rows, at = np.nonzero(block.score > -np.inf)
                order = np.lexsort((-block.score[rows, at], rows))
                rows, at = rows[order], at[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, at = rows[rank < k], at[rank < k]
                yield pa.RecordBatch.from_arrays([pa.array(block.u[rows]), pa.array(block.pool[rows, at]), pa.array(block.score[rows, at])], names=["q", "u", "score"])

    n = parts(spark)
    steps = materialise(nodes.filter("asked > 0").select("u", "x").transform(in_batches, begin, _STEP), "search")
    stored = graph.select(F.lit(0).alias("kind"), F.col("page").alias("key"), "payload")
    while steps.filter("kind = 1").limit(1).count():
        met = stored.union(steps.filter("kind = 1")).repartition(n, "key").sortWithinPartitions("key", "kind").select("kind", "key", "payload")
        back = steps.filter("kind = 0").union(met.transform(in_batches, answer, _STEP))
        back = back.repartition(n, "key").sortWithinPartitions("key", "kind").select("kind", "key", "payload")
        steps = _replaced(back.transform(in_batches, onward, _STEP), steps, "search")
    return steps.filter("kind = 0").select("payload").transform(in_batches, told, "q bigint, u bigint, score double")


def nearest(df: DataFrame, chosen: str, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of df that meets the condition `chosen`, k near rows among all others.

    Nearness is the inner product in double precision; ties go to the smaller id. Rows with a null id, or a vector that
    is null, zero or holds null or non-finite components, take no part; a shorter vector ends in zeros. Ids are integers.
    Candidates are all rows but those with the query's id; rows repeated whole are one. Every row is in the graph, by the
    node of its vector. Other columns are neither read nor returned.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = df.filter(valid(id_col, vec_col, True)).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.coalesce(F.expr(chosen), F.lit(False)).alias("asked"))
    sp = space(rows, False)
    if df.schema[vec_col].dataType.elementType.typeName() == "float":
        sp.stored = "f4"
    nodes = nodes_of(rows, sp, k)
    n = nodes.count()
    pages = max(1, math.ceil(n / PAGE))
    state = descend(nodes, sp, n)
    graph = materialise(graph_pages(nodes, state, sp, pages), "pages")
    pairs = materialise(found(nodes, graph, sp, pages, k + 1), "pairs")
    # popular nodes are in many lists: told apart from the others, as are vectors of many queries
    times = pairs.groupBy("u").agg(F.count("*").alias("times"))
    ids = nodes.select("u", "ids").join(times, "u")
    wide = with_facts(pairs, ids, "u", "times", pairs.count()).select("q", "score", F.explode("ids").alias("id"))
    best = wide.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), F.col("id").alias("c")))), 1, 2 * k + 2).alias("best"))
    return _by_query(rows, nodes, best, sp, k)


def _by_query(rows: DataFrame, nodes: DataFrame, best: DataFrame, sp: Space, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from what the nodes found: best (q, array<struct<d, c>>)."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = sp.matrix(batch.column(1).to_pylist()).astype(sp.stored)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    queries = rows.filter("asked").select("id", "v").transform(in_batches, packed, "id bigint, x binary").distinct()
    facts = materialise(nodes.filter("asked > 0").select(F.col("u").alias("q"), "x", "asked").join(best, "q").select("x", "asked", "best"), "best")
    total = facts.agg(F.sum("asked")).first()[0] or 0
    told = with_facts(queries, facts, "x", "asked", total)
    others = F.slice(F.filter("best", lambda b: b["c"] != F.col("id")), 1, k)
    out = told.select("id", F.posexplode(others).alias("at", "b"))
    return out.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("b.c").alias("vec_id"), (-F.col("b.d")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), f"vec_id % {EVERY} = 0")
