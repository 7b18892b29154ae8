from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from twinsieve.operators import dedupe
from twinsieve.options import DedupeOptions, GroupOptions, OptionError

META = "path string, device long, inode long, len long, is_file boolean, created timestamp, modified timestamp, accessed timestamp, ctime_sec long, ctime_nsec long"
NOW = datetime(2024, 5, 1, tzinfo=UTC)


def meta(spark, rows):
    """rows: dicts with path and what differs from the k-th file's defaults."""
    full = []
    for k, r in enumerate(rows):
        t = NOW + timedelta(seconds=k)
        d = {"device": 1, "inode": k, "len": 0, "is_file": True, "created": t, "modified": t, "accessed": t, "ctime_sec": k, "ctime_nsec": 0} | r
        full.append(tuple(d[c.split()[0]] for c in META.split(", ")))
    return spark.createDataFrame(full, META)


def split(spark, rows, operation="remove", length=0, **options):
    """(kept, dropped) paths of one group."""
    opts = DedupeOptions(**options)
    m = meta(spark, rows)
    members = m.select(F.lit(length).cast("long").alias("file_len"), F.lit("ab").alias("file_hash"), "path")
    files, keys = dedupe.candidates(members, m, opts, operation)
    out = dedupe.partition(files, keys, opts).collect()
    return sorted(r.path for r in out if r.keep), sorted(r.path for r in out if not r.keep)


THREE = [{"path": f"/d/file_{k}"} for k in (1, 2, 3)]


def test_one_stays(spark):
    assert split(spark, THREE) == (["/d/file_1"], ["/d/file_2", "/d/file_3"])
    assert split(spark, THREE, rf_over=2) == (["/d/file_1", "/d/file_2"], ["/d/file_3"])
    assert split(spark, THREE, rf_over=9) == (["/d/file_1", "/d/file_2", "/d/file_3"], [])


def test_groups_and_files_that_are_left_out(spark):
    assert split(spark, THREE, modified_before=NOW + timedelta(seconds=1)) == ([], [])
    assert split(spark, THREE, modified_before=NOW + timedelta(seconds=2))[0] == ["/d/file_1"]
    assert split(spark, [{"path": "/a", "modified": None}, {"path": "/b"}], modified_before=NOW + timedelta(days=1)) == ([], [])
    assert split(spark, [THREE[0] | {"len": 3}, *THREE[1:]]) == (["/d/file_2"], ["/d/file_3"])
    assert split(spark, [THREE[0] | {"len": 3}, *THREE[1:]], no_check_size=True)[0] == ["/d/file_1"]
    assert split(spark, [THREE[0] | {"is_file": False}, *THREE[1:]]) == (["/d/file_2"], ["/d/file_3"])
    assert split(spark, [{"path": "/a", "created": None}, {"path": "/b"}], priority=["newest"]) == ([], [])
    m = meta(spark, THREE)
    members = m.select(F.lit(0).cast("long").alias("file_len"), F.lit("ab").alias("file_hash"), "path")
    assert dedupe.enriched(members, m.filter("inode > 0")).count() == 0


@pytest.mark.parametrize(
    ("priority", "kept"),
    [
        (["newest"], "a"), (["oldest"], "c"), (["most-recently-modified"], "b"), (["least-recently-modified"], "a"), (["most-recently-accessed"], "c"), (["least-recently-accessed"], "b"),
        (["most-recent-status-change"], "b"), (["least-recent-status-change"], "c"), (["most-nested"], "a"), (["least-nested"], "c"), (["top"], "c"), (["bottom"], "a"), (["top", "bottom"], "c"),
        (["most-nested", "oldest"], "b"), (["top", "newest"], "c"), (["newest", "top"], "a"),
    ],
)
def test_priorities(spark, priority, kept):
    t = lambda s: NOW + timedelta(seconds=s)
    rows = [
        {"path": "/x/a", "created": t(1), "modified": t(9), "accessed": t(5), "ctime_sec": 4, "ctime_nsec": 2},
        {"path": "/x/b", "created": t(2), "modified": t(7), "accessed": t(6), "ctime_sec": 4, "ctime_nsec": 1},
        {"path": "/x/y/c", "created": t(3), "modified": t(8), "accessed": t(4), "ctime_sec": 5, "ctime_nsec": 0},
    ]
    assert split(spark, rows, priority=priority)[0] == [next(r["path"] for r in rows if r["path"].endswith(kept))]


def test_patterns(spark):
    assert split(spark, THREE, keep_names=["*_1"]) == (["/d/file_1"], ["/d/file_2", "/d/file_3"])
    assert split(spark, THREE, keep_paths=["**/file_2"]) == (["/d/file_2"], ["/d/file_1", "/d/file_3"])
    assert split(spark, THREE, names=["*_3"]) == (["/d/file_1", "/d/file_2"], ["/d/file_3"])
    assert split(spark, THREE, paths=["**/file_3"], names=["file_2"]) == (["/d/file_1"], ["/d/file_2", "/d/file_3"])
    assert split(spark, THREE, keep_names=["file_?"]) == (["/d/file_1", "/d/file_2", "/d/file_3"], [])


def test_replicas(spark):
    rows = [{"path": f"/r{r}/{k}"} for r in (1, 2) for k in (1, 2, 3)]
    assert split(spark, rows, isolated=["/r1", "/r2"]) == ([f"/r1/{k}" for k in (1, 2, 3)], [f"/r2/{k}" for k in (1, 2, 3)])
    links = [{"path": "/b1", "inode": 5}, {"path": "/a2", "inode": 6}, {"path": "/a1", "inode": 6}, {"path": "/b2", "inode": 5}]
    assert split(spark, links) == (["/a1", "/a2"], ["/b1", "/b2"])
    assert split(spark, links, match_links=True) == (["/a1"], ["/a2", "/b1", "/b2"])
    devices = [{"path": f"/{k}", "device": k % 2} for k in range(4)]
    assert split(spark, devices, "hardlink") == (["/0", "/1"], ["/2", "/3"]) and split(spark, devices, "symlink")[0] == ["/0"]


def test_plans_and_scripts(spark):
    m = meta(spark, [*THREE, {"path": "/e f", "len": 9}, {"path": "/g", "len": 9}])
    members = m.select(F.col("len").alias("file_len"), F.concat(F.lit("a"), F.col("len")).alias("file_hash"), "path")
    rows = dedupe.plan(members, m, "symlink", DedupeOptions(keep_paths=["/d/file_2"]))
    got = {(r.source, r.target, r.reclaimed) for r in rows.collect()}
    assert got == {("/d/file_1", "/d/file_2", 0), ("/d/file_3", "/d/file_2", 0), ("/g", "/e f", 9)}
    lines = [r.line for r in dedupe.script(rows).collect()]
    aside = lines[0].split()[-1]
    assert lines[:3] == [f"mv /g {aside}", "ln -s '/e f' /g", f"rm {aside}"] and [x.split()[1] for x in lines[3::3]] == ["/d/file_1", "/d/file_3"]
    assert [x.line for x in dedupe.script(dedupe.plan(members, m, "remove")).collect()] == ["rm /g", "rm /d/file_2", "rm /d/file_3"]
    mounts = spark.createDataFrame([("/", 0), ("/old", 1), ("/d", 1)], "path string, device long")
    moves = {r.source: (r.target, r.use_rename) for r in dedupe.plan(members, m, "move", DedupeOptions(target="/old"), mounts).collect()}
    assert moves == {"/g": ("/old/g", False), "/d/file_2": ("/old/d/file_2", True), "/d/file_3": ("/old/d/file_3", True)}
    assert tuple(dedupe.result(rows).first()) == (3, 9)
    for bad in ("melt", "move"):
        with pytest.raises(OptionError):
            dedupe.plan(members, m, bad)


def test_inherited_options():
    opts = DedupeOptions.after(GroupOptions(rf_over=3, roots=list("abcd"), isolate=True, match_links=True), NOW, priority=["top"])
    assert (opts.rf_over, list(opts.isolated), opts.match_links, opts.modified_before, list(opts.priority)) == (3, list("abcd"), True, NOW, ["top"])
    for bad in ({"rf_over": 0}, {"priority": ["best"]}, {"modified_before": "whenever"}):
        with pytest.raises(OptionError):
            DedupeOptions(**bad)
