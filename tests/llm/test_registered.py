"""Registered queries against their SQL on the smallest tables, and recall of the approximate one."""

import os

import duckdb
import numpy as np
import pytest

from twinsieve.llm import registry

SF = os.environ.get("TWINSIEVE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_recall_of_graph_search(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], "f8")
    found = {}
    for r in registry.queries()["op6_graph_search"](spark, SF).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        hits, total = hits + len(best & found[int(ids[k])]), total + len(best)
    assert hits / total >= 0.9
