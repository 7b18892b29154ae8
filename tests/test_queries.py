"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TWINSIEVE_TEST_SF", "/root/testdata/sf0.001")
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(rows):
    return sorted(repr([int(x) if isinstance(x, bool) else x for x in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, oracle, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if (sql := entry.oracle_sql().get(name)) is None:
        assert rows
        return
    want = oracle.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(rows) == plain([tuple(r[k] for k in order) for r in want.fetchall()])
