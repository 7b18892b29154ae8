import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinsieve.operators import cache, grouping, transform
from twinsieve.options import GroupOptions, OptionError

SMALL = {"prefix": 4, "suffix": 4, "suffix_from": 10}


def files(spark, rows):
    """rows: (path, content) or (path, inode, content)."""
    full = [(r[0], 1, r[1] if len(r) == 3 else k, len(r[-1]), r[-1], "extra") for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "path string, device long, inode long, len long, content binary, n_files string").drop("n_files")


def groups(spark, rows, **options):
    opts = GroupOptions(**{"min_size": 0, **options})
    found = [r.files for r in grouping.nested(grouping.group(files(spark, rows), opts), opts.isolated).orderBy(*grouping.group_order()).collect()]
    if not opts.transform:
        stages = grouping.nested(grouping.cascade(grouping.selected(grouping.unique_paths(files(spark, rows)), opts), GroupOptions(**{"min_size": 0, **options, **SMALL})), opts.isolated)
        assert sorted(r.files for r in stages.collect()) == sorted(found)
    return found


BIG = bytes(40)


def test_contents_decide(spark):
    assert groups(spark, [("/a", b"aaa"), ("/b", b"aaa")]) == [["/a", "/b"]]
    assert groups(spark, [("/a", BIG + b"1" * 4 + b"2" * 4), ("/b", BIG + b"1" * 4 + b"2" * 4)]) == [["/a", "/b"]]
    assert groups(spark, [("/a", b"aaaa"), ("/b", b"aaa")], rf_over=0) == [["/a"], ["/b"]]
    for x, y in ((b"aaa", b"bbb"), (BIG + b"suffix1", BIG + b"suffix2"), (BIG + b"middle1" + BIG, BIG + b"middle2" + BIG)):
        assert sorted(groups(spark, [("/a", x), ("/b", y)], unique=True)) == [["/a"], ["/b"]]
    assert groups(spark, [("/a", b""), ("/b", b"")]) == [["/a", "/b"]] and groups(spark, [("/a", b""), ("/b", b"")], min_size=1) == []
    assert groups(spark, []) == []


def test_links_count_once(spark):
    rows = [("/a", 7, b"xx"), ("/b", 7, b"xx")]
    assert groups(spark, rows) == [] and groups(spark, rows, unique=True) == [["/a", "/b"]]
    assert groups(spark, rows, match_links=True) == [["/a", "/b"]]
    assert groups(spark, [("/a", 7, b"xx")] * 3, match_links=True, unique=True) == [["/a"]]


def test_isolated_roots(spark):
    rows = [("/r1/a", b"q"), ("/r1/b", b"q"), ("/r12/c", b"zz")]
    assert groups(spark, rows, roots=["/r1", "/r2"], isolate=True) == []
    assert groups(spark, rows) == [["/r1/a", "/r1/b"]]
    assert groups(spark, [*rows, ("/r2/x/y", b"q")], roots=["/r2", "/r1"], isolate=True) == [["/r2/x/y", "/r1/a", "/r1/b"]]


def test_replication_modes_and_counts(spark):
    rows = [("/a", b"x"), ("/b", b"x"), ("/c", b"x"), ("/d", b"yy"), ("/e", b"yy"), ("/f", b"zzz")]
    assert groups(spark, rows, rf_over=2) == [["/a", "/b", "/c"]]
    assert groups(spark, rows, rf_under=3) == [["/f"], ["/d", "/e"]] and groups(spark, rows, unique=True) == [["/f"]]
    under = GroupOptions(rf_under=3, min_size=0)
    got = grouping.summary(grouping.group(files(spark, rows), under), under).collect()
    assert sorted((r.n_files, r.replicas, r.redundant, r.missing) for r in got) == [(1, 1, 0, 2), (2, 2, 0, 1)]
    over = GroupOptions(min_size=0)
    stats = grouping.statistics(grouping.summary(grouping.group(files(spark, rows), over), over)).first()
    assert tuple(stats) == (2, 5, 7, 3, 4, 0, 0)
    iso = GroupOptions(min_size=0, roots=["/r", "/s"], isolate=True)
    members = grouping.group(files(spark, [("/r/1", b"a"), ("/r/2", b"a"), ("/s/1", b"a"), ("/t", b"a")]), iso)
    assert [tuple(r)[2:] for r in grouping.summary(members, iso).collect()] == [(4, 3, 2, 0)]


def test_transformed_and_failing_rows(spark):
    cut = transform.transformed(lambda b: b[:2] if b != b"boom" else 1 / 0)
    assert groups(spark, [("/a", b"aa|1"), ("/b", b"aa|23456"), ("/c", b"boom"), ("/d", b"boom")], transform=cut) == [["/a", "/b"]]


def test_programs(spark):
    rows = files(spark, [("/a", b"one two"), ("/b", b"one three")])
    for program in (transform.Program("head -c 3"), transform.Program("head -c 3 $IN"), transform.Program("dd if=$IN of=$OUT bs=1 count=3"), transform.Program("truncate -s 3 $IN", in_place=True)):
        got = rows.select(transform.apply(program)(F.col("content")).alias("t")).collect()
        assert [(r.t.len, bytes(r.t.content), r.t.error) for r in got] == [(3, b"one", None)] * 2
    failed = rows.select(transform.apply(transform.Program("ls /no/such/place"))(F.col("content")).alias("t")).first().t
    assert failed.content is None and "ls ended with" in failed.error
    for bad in (("", False), ("x $IN $OUT", True), ("x", True)):
        with pytest.raises(transform.TransformError):
            transform.Program(bad[0], in_place=bad[1])
    with pytest.raises(transform.TransformError):
        transform.Program("no-such-program-here").check()


def test_order_does_not_matter(spark):
    rows = [(f"/{k}", bytes([k % 5]) * (k % 4)) for k in range(60)]
    want = groups(spark, rows)
    random.Random(1).shuffle(rows)
    assert [sorted(g) for g in groups(spark, rows)] == [sorted(g) for g in want]


def test_selection(spark):
    rows = [("/r/a.txt", b"1"), ("/r/.h/b.txt", b"1"), ("/r/s/c.txt", b"12"), ("/r/s/t/d.jpg", b"123"), ("/r/.e", b"1")]
    chosen = lambda **o: {r.path for r in grouping.selected(files(spark, rows), GroupOptions(roots=["/r"], **o)).collect()}
    assert chosen() == {"/r/a.txt", "/r/s/c.txt", "/r/s/t/d.jpg"} and len(chosen(hidden=True)) == 5
    assert chosen(depth=1) == {"/r/a.txt"} and chosen(depth=2) == {"/r/a.txt", "/r/s/c.txt"}
    assert chosen(min_size=2, max_size="2B") == {"/r/s/c.txt"} and chosen(names=["*.jpg"]) == {"/r/s/t/d.jpg"}


def test_options_that_do_not_go_together():
    for bad in ({"rf_over": 1, "unique": True}, {"isolate": True, "follow_links": True}, {"isolate": True, "roots": ["/a"]}, {"min_size": "x"}, {"hash_fn": "crc"}, {"format": "xml"}, {"depth": -1}):
        with pytest.raises(OptionError):
            GroupOptions(**bad)
    assert (GroupOptions().over, GroupOptions(unique=True).over, GroupOptions(unique=True).under, GroupOptions(rf_under=4).under) == (1, 0, 2, 4)
    assert [GroupOptions(**o).search for o in ({}, {"unique": True}, {"rf_under": 2})] == ["redundant", "unique", "missing"]


def test_digests_once_for_each_inode(spark):
    out = grouping.fan_out(files(spark, [("/a", 1, b"x"), ("/b", 1, b"x"), ("/c", 2, b"y")]), GroupOptions()).collect()
    by = {r.path: r.file_hash for r in out}
    assert by["/a"] == by["/b"] != by["/c"] and len(by) == 3


def test_cache(spark, tmp_path):
    rows = spark.sql("SELECT 1L device, id inode, 5L len, timestamp_millis(id * 1000) modified, cast('abc' as binary) content FROM range(4)")
    chunks = cache.chunk_rows(rows)
    path = f"file://{tmp_path}/cache"
    assert cache.opened(spark, path, "sha256").count() == 0
    entry = "SELECT 1L device, {0}L inode, 0L chunk_pos, 5L chunk_len, {1}L modified_ms, {2}L file_len, 5L data_len, '{3}' hash"
    old = spark.sql(" UNION ALL ".join(entry.format(*e) for e in ((0, 0, 5, "hit"), (1, 999, 5, "old"), (2, 2000, 6, "grown"))))
    cache.store(old, path, "sha256")
    cache.store(old.filter("inode = 0"), path, "md5", "head")
    kept = cache.opened(spark, path, "sha256")
    got = {r.inode: r.hash for r in cache.through(chunks, kept, lambda missed: missed.withColumn("hash", F.lit("computed"))).collect()}
    assert got == {0: "hit", 1: "computed", 2: "computed", 3: "computed"}
    other = cache.chunk_rows(rows, 0, F.lit(3))
    assert {r.cached_hash for r in cache.lookup(other, kept).collect()} == {None} and cache.opened(spark, path, "md5").count() == 0
    new = chunks.select(*cache.KEY, "modified_ms", F.col("len").alias("file_len"), F.col("len").alias("data_len"), F.lit("new").alias("hash"))
    assert {(r.inode, r.hash) for r in cache.merged(kept, new).collect()} == {(k, "new") for k in range(4)}


def test_counted_by_tasks(spark, monkeypatch, tmp_path):
    rows = [(1, 2, k % 5) for k in range(90)] + [(k, k, k) for k in range(3, 40)] + [(7, None, None), (7, None, 4), (7, None, 4), (8, 8, None)]
    table = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_orderkey long")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(grouping, "TASK_ROWS", 10)
    out = entry.queries()["group_by_key"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == -(-len(rows) // 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") > plan.rindex("HashAggregate")  # no task aggregates all that it scans
    keys = ["l_partkey", "l_suppkey"]
    want = table.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey")).filter("n > 1")
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert grouping.counted(table.limit(0), keys, "l_orderkey").count() == 0
