"""Registered queries: sources, filters and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.patterns import Pattern, Selector, ignored
from ..operators import dedupe, grouping
from ..options import DedupeOptions, GroupOptions
from ..sources import documents, walker
from .common import FILES, LINKED, META, options, query

IGNORE = [("/", ["*7.txt", "!*77.txt"]), ("/src3", ["fr/", "/de/*1.txt"])]


def _files(spark: SparkSession, sf_dir: str, links: bool = False) -> DataFrame:
    return documents.files(spark, sf_dir, links).drop("content")


@query("scan_files", f"WITH {LINKED} SELECT path, device, inode, len FROM files WHERE len >= 1")
def _(spark, sf_dir):
    return grouping.selected(_files(spark, sf_dir, True), GroupOptions())


@query(
    "scan_ignore_rules",
    f"WITH {FILES} SELECT path FROM files WHERE NOT (regexp_full_match(path, '.*7\\.txt') AND NOT regexp_full_match(path, '.*77\\.txt'))"
    " AND path NOT LIKE '/src3/fr/%' AND NOT regexp_full_match(path, '/src3/de/[^/]*1\\.txt')",
)
def _(spark, sf_dir):
    return _files(spark, sf_dir).filter(~ignored(IGNORE, F.col("path"))).select("path")


@query(
    "scan_path_list",
    f"WITH {FILES} SELECT path, len FROM files",
)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    below = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("./")).otherwise(F.lit("")), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    lines = docs.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), F.regexp_replace(below, r"^\./", ""))).otherwise(below).alias("value"))
    return walker.path_list(spark, lines.union(lines), "/").join(_files(spark, sf_dir), "path").select("path", "len")


@query(
    "gen_files",
    "WITH g AS (SELECT CAST(unnest(range(200)) AS BIGINT) AS g), c AS (SELECT g, unnest(range(1 + (g * 7) % 5)) AS c FROM g)"
    " SELECT sha256(repeat(md5(CAST(g AS VARCHAR)), 2048) || substr(md5(CAST(g AS VARCHAR)), 1, 2)) AS file_hash, count(*) AS n, CAST(65538 AS BIGINT) AS len FROM c GROUP BY g",
)
def _(spark, sf_dir):
    made = documents.generated(spark, 200, 5)
    return made.groupBy(F.sha2("content", 256).alias("file_hash"), "len").agg(F.count("*").alias("n"))


@query("filter_size_range", f"WITH {FILES} SELECT path, len FROM files WHERE len BETWEEN 1000 AND 3000")
def _(spark, sf_dir):
    return grouping.selected(_files(spark, sf_dir), GroupOptions(min_size="1KB", max_size=3000)).select("path", "len")


@query("filter_name_glob", f"WITH {FILES} SELECT path FROM files WHERE regexp_full_match(path, '.*/(1[^/]*|[^/]*[3-5])\\.txt')")
def _(spark, sf_dir):
    return grouping.selected(_files(spark, sf_dir), options(names=["1*.txt", "*[3-5].txt"])).select("path")


@query("filter_path_glob", f"WITH {FILES} SELECT path FROM files WHERE regexp_full_match(path, '/src[0-4]/(en|de)/.*')")
def _(spark, sf_dir):
    return grouping.selected(_files(spark, sf_dir), options(paths=["src[0-4]/{en,de}/**"])).select("path")


@query("filter_exclude_glob", f"WITH {FILES} SELECT path FROM files WHERE path NOT LIKE '/src1%' AND NOT regexp_full_match(path, '.*/fr/[^/]*2\\.txt')")
def _(spark, sf_dir):
    return grouping.selected(_files(spark, sf_dir), options(exclude=["/src1*/**", "**/fr/*2.txt"])).select("path")


@query(
    "filter_dir_prune",
    f"WITH {FILES} SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM files WHERE path LIKE '/src1%' AND path NOT LIKE '/src1/fr/%'",
)
def _(spark, sf_dir):
    dirs = _files(spark, sf_dir).select(paths.parent(F.col("path")).alias("dir")).distinct()
    chosen = Selector(paths=["/src1*/**"], exclude=["/src1/fr/**"])
    # a prefix is compared up to its last folder: /src1* may be any folder that begins so
    return dirs.filter(chosen.directory(F.col("dir")) & F.col("dir").startswith("/src1"))


@query("filter_regex", f"WITH {FILES} SELECT path FROM files WHERE regexp_full_match(path, '(?i)(/src[12]/.*|.*/es/[0-9]+\\.txt)')")
def _(spark, sf_dir):
    return grouping.selected(_files(spark, sf_dir), options(paths=["^/SRC[12]/.*|.*/es/[0-9]+\\.txt$"], regex=True, ignore_case=True)).select("path")


GLOBS = ["/src1*/e?/*.txt", "/**/@(de|fr)/+(1|2)*", "/{src2,src3}/**", "/src[!0-9]*/**", "/src?(1)5/e[ns]/*"]


@query(
    "glob_compile",
    f"WITH {FILES} SELECT path, CAST(g AS BIGINT) AS glob FROM files, (VALUES (0, '/src1[^/]*/e[^/]/[^/]*\\.txt'), (1, '/.*/(de|fr)/(1|2)+[^/]*'), (2, '/(src2|src3)/.*'), (3, '/src[^0-9][^/]*/.*'), (4, '/src(1)?5/e[ns]/[^/]*')) AS p(g, r) WHERE regexp_full_match(path, r)",
)
def _(spark, sf_dir):
    hits = F.array(*[F.when(Pattern.glob(g).matches(F.col("path")), F.lit(k).cast("bigint")) for k, g in enumerate(GLOBS)])
    return _files(spark, sf_dir).select("path", F.explode(F.array_compact(hits)).alias("glob"))


@query(
    "filter_hidden",
    "SELECT path FROM (SELECT '/' || source || CASE WHEN doc_id % 5 = 0 THEN '/.git/' WHEN doc_id % 5 = 1 THEN '/a.b/.' ELSE '/' END || doc_id AS path FROM documents) WHERE NOT regexp_matches(path, '/\\.')",
)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    middle = F.when(F.col("doc_id") % 5 == 0, F.lit("/.git/")).when(F.col("doc_id") % 5 == 1, F.lit("/a.b/.")).otherwise(F.lit("/"))
    return docs.select(F.concat(F.lit("/"), "source", middle, F.col("doc_id").cast("string")).alias("path")).filter(~paths.hidden(F.col("path")))


@query("filter_depth", f"WITH {LINKED} SELECT path FROM files WHERE len(string_split(path, '/')) <= 3")
def _(spark, sf_dir):
    return grouping.selected(_files(spark, sf_dir, True), options(depth=2)).select("path")


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Members of duplicate groups, and metadata in which some files have changed since."""
    members = grouping.group(documents.files(spark, sf_dir, True), options())
    meta = documents.metadata(spark, sf_dir, True).withColumns({"is_file": F.col("inode") % 11 != 0, "len": F.col("len") + (F.col("inode") % 13 == 0).cast("bigint")})
    return members, meta


_GROUPED = f"WITH {META}, g AS (SELECT len AS file_len, sha256(content) AS file_hash, path, inode, modified FROM meta), r AS (SELECT file_len, file_hash FROM g GROUP BY ALL HAVING count(DISTINCT inode) > 1), m AS (SELECT g.* FROM g JOIN r USING (file_len, file_hash))"


@query("filter_regular_files", f"{_GROUPED} SELECT path, file_hash FROM m WHERE inode % 11 <> 0")
def _(spark, sf_dir):
    members, meta = _changed(spark, sf_dir)
    return dedupe.candidates(members, meta, DedupeOptions(no_check_size=True))[0].select("path", "file_hash")


@query("filter_len_changed", f"{_GROUPED} SELECT path, file_hash FROM m WHERE inode % 11 <> 0 AND inode % 13 <> 0")
def _(spark, sf_dir):
    members, meta = _changed(spark, sf_dir)
    return dedupe.candidates(members, meta, DedupeOptions())[0].select("path", "file_hash")


@query("filter_group_modified", f"{_GROUPED} SELECT path, file_hash FROM m JOIN (SELECT file_len, file_hash FROM m GROUP BY ALL HAVING max(modified) <= 1704067200 + 900) USING (file_len, file_hash)")
def _(spark, sf_dir):
    members = grouping.group(documents.files(spark, sf_dir, True), options())
    opts = DedupeOptions(modified_before="2024-01-01 00:15:00 +0000")
    return dedupe.candidates(members, documents.metadata(spark, sf_dir, True), opts)[0].select("path", "file_hash")


@query("walk_visited_set", f"WITH {LINKED} SELECT inode, min(path) AS path FROM files GROUP BY inode")
def _(spark, sf_dir):
    """Each file once, however many names lead to it."""
    return _files(spark, sf_dir, True).groupBy("inode").agg(F.min("path").alias("path"))


@query("dedup_paths", f"WITH {FILES} SELECT path, len FROM files")
def _(spark, sf_dir):
    listed = _files(spark, sf_dir)
    return grouping.unique_paths(listed.union(listed.filter("inode % 3 = 0"))).select("path", "len")


@query("root_prefix_assign", f"WITH {FILES} SELECT path, CAST(CASE WHEN path LIKE '/src1/%' THEN 0 WHEN path LIKE '/src2/de/%' THEN 1 WHEN path LIKE '/src2/%' THEN 2 END AS BIGINT) AS root FROM files")
def _(spark, sf_dir):
    return _files(spark, sf_dir).select("path", paths.first_root(["/src1", "/src2/de", "/src2", "/src1/en"], F.col("path")).cast("bigint").alias("root"))


MOUNTS = [("/", "disk0"), ("/src1", "disk1"), ("/src1/de", "disk2"), ("/src2", "disk3")]


@query("device_longest_prefix", f"WITH {FILES} SELECT path, CASE WHEN path LIKE '/src1/de/%' THEN 'disk2' WHEN path LIKE '/src1/%' THEN 'disk1' WHEN path LIKE '/src2/%' THEN 'disk3' ELSE 'disk0' END AS device_name FROM files")
def _(spark, sf_dir):
    """The mount that a path lies below, the deepest one: a row for each mount of a machine, tried in that order."""
    found = None
    for mount, name in sorted(MOUNTS, key=lambda m: -len(m[0])):
        below = paths.is_prefix_of(F.lit(mount), F.col("path"))
        found = F.when(below, F.lit(name)) if found is None else found.when(below, F.lit(name))
    return _files(spark, sf_dir).select("path", found.alias("device_name"))
