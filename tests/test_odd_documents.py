"""Registered queries against their SQL over documents of which some are empty or null."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from test_queries import plain

ODD = [(100001, "", "en", "src1"), (100010, "", "fr", "src12"), (100007, None, "en", "src1"), (100012, "abc", "es", "src4"), (100013, "abc", "de", "src1"), (100020, "abc", "es", "src2")]


@pytest.fixture(scope="module", params=["one empty", "several"])
def odd(request, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = ODD[:1] + ODD[3:] if request.param == "one empty" else ODD
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY documents TO '{os.path.join(folder, 'documents.parquet')}' (FORMAT parquet)")
    return folder, con


@pytest.mark.parametrize("name", ["filter_path_glob", "filter_name_glob", "filter_exclude_glob", "filter_depth", "filter_regex", "having_rf_under", "having_rf_over", "duplicate_groups", "redundant_count", "subgroup_count", "report_stats", "order_groups", "order_files_in_group", "partition_by_key", "priority_top", "plan_remove", "having_unique", "missing_count"])
def test_odd_documents(spark, odd, name):
    folder, con = odd
    got = entry.queries()[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert want and plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)
