"""Connected components of a table of links: few links on the driver, more by alternating star steps over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import with_facts


def _stars(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """edges a > b, `total` or fewer. Links each node's larger (or smaller) neighbours to the least of them and itself."""
    if small:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = with_facts(sides, least, "u", "n", total if small else 2 * total)
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a > b").distinct()


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a[k], b[k], in order, and the least node of each one's component.

    In each turn every component that has a link to another one is joined to one, so that turns are few.
    """
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (root[x] != root[y]).any():
        u, v = root[x], root[y]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def components(edges: DataFrame, a: str = "a", b: str = "b", at_once: int = 1 << 18) -> DataFrame:
    """id, root: every node that has a link, with the least id of its component; loops and repeated links are allowed.

    Up to `at_once` distinct links, 16 bytes each, are joined up on the driver: the rounds that more of them take are a
    dozen stages each. Each round is written to the shared folder, which cuts lineage; the number of rounds grows with
    the logarithm of the longest chain. A hot node's minimum is partly taken before the shuffle, and told by a broadcast of hot nodes alone.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    now, before = materialise(now, "links"), None
    total = now.count()
    if total <= at_once and now.schema["a"].dataType.simpleString() == "bigint":
        got = now.toArrow()
        ids, least = roots(*(got.column(k).to_numpy() for k in (0, 1)))
        return now.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "root": pa.array(least, pa.int64())}))
    while True:
        turned = materialise(_stars(now, False, total), "turned")
        now = materialise(_stars(turned, True, turned.count()), "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())
        if state == before:
            break
        before, total = state, state[0]
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
