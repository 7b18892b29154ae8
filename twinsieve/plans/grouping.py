"""Registered queries: groups by content, replicas, stages and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests, paths
from ..operators import cache, grouping, transform
from ..options import GroupOptions
from ..sources import documents
from .common import FILES, LINKED, MEMBERS, META, options, query

#: Lengths that let every stage of the cascade have work on short documents.
SMALL = {"prefix": 256, "suffix": 256, "suffix_from": 1024, "match_links": True}


def _all(spark, sf_dir, links=False):
    return documents.files(spark, sf_dir, links)


@query("duplicate_groups", f"WITH {FILES} SELECT len AS file_len, sha256(content) AS file_hash, count(*) AS n_files FROM files GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    members = grouping.group(_all(spark, sf_dir), options())
    return members.groupBy(*grouping.KEYS).agg(F.count("*").alias("n_files"))


@query("group_by_key", "SELECT l_partkey, l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return grouping.counted(rows, ["l_partkey", "l_suppkey"], "l_orderkey").filter("n > 1").withColumnRenamed("ids", "orders")


@query("group_by_size", f"WITH {FILES} SELECT len, count(*) AS n FROM files GROUP BY len HAVING count(*) > 1")
def _(spark, sf_dir):
    return grouping.by_size(_all(spark, sf_dir).drop("content"), GroupOptions(**SMALL)).groupBy("len").agg(F.count("*").alias("n"))


_STAGES = (
    "s0 AS (SELECT *, md5(content[1:256]) AS p, CASE WHEN len >= 1024 THEN md5(content[-256:]) ELSE '' END AS s, md5(content) AS h FROM files),"
    " s1 AS (SELECT * FROM s0 QUALIFY count(*) OVER (PARTITION BY len) > 1), s2 AS (SELECT * FROM s1 QUALIFY count(*) OVER (PARTITION BY len, p) > 1),"
    " s3 AS (SELECT * FROM s2 QUALIFY count(*) OVER (PARTITION BY len, p, s) > 1), s4 AS (SELECT * FROM s3 QUALIFY count(*) OVER (PARTITION BY len, h) > 1)"
)


def _stage(spark, sf_dir, number):
    opts = GroupOptions(hash_fn="md5", **SMALL)
    out = grouping.with_content(grouping.with_suffix(grouping.with_prefix(_all(spark, sf_dir), opts), opts), opts).drop("content")
    out = grouping.by_size(out, opts)
    for keys in grouping.STAGES[: number - 1]:
        out = grouping.pruned(out, ["len", *keys], opts)
    return out


@query("group_by_prefix", f"WITH {FILES}, {_STAGES} SELECT path, len, p AS prefix_hash FROM s2")
def _(spark, sf_dir):
    return _stage(spark, sf_dir, 2).select("path", "len", "prefix_hash")


@query("group_by_suffix", f"WITH {FILES}, {_STAGES} SELECT path, len, p AS prefix_hash, s AS suffix_hash FROM s3")
def _(spark, sf_dir):
    return _stage(spark, sf_dir, 3).select("path", "len", "prefix_hash", "suffix_hash")


@query("group_by_contents", f"WITH {FILES}, {_STAGES} SELECT path, len AS file_len, h AS file_hash FROM s4")
def _(spark, sf_dir):
    return grouping.cascade(_all(spark, sf_dir), GroupOptions(hash_fn="md5", **SMALL)).select("path", "file_len", "file_hash")


@query("stage_stats", f"WITH {FILES}, {_STAGES} SELECT 1 AS stage, count(*) AS files, CAST(sum(len) AS BIGINT) AS bytes FROM s1 UNION ALL SELECT 2, count(*), CAST(sum(len) AS BIGINT) FROM s2 UNION ALL SELECT 3, count(*), CAST(sum(len) AS BIGINT) FROM s3 UNION ALL SELECT 4, count(*), CAST(sum(len) AS BIGINT) FROM s4")
def _(spark, sf_dir):
    rows = [_stage(spark, sf_dir, k).agg(F.lit(k).alias("stage"), F.count("*").alias("files"), F.sum("len").alias("bytes")) for k in (1, 2, 3, 4)]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("rehash", f"WITH {LINKED} SELECT path, inode, sha256(content) AS file_hash FROM files")
def _(spark, sf_dir):
    """A digest for each inode, given to all of its links."""
    return grouping.fan_out(_all(spark, sf_dir, True), GroupOptions()).select("path", "inode", "file_hash")


@query("hash_fanout_by_inode", f"WITH {LINKED} SELECT sha256(content) AS file_hash, count(*) AS links, count(DISTINCT inode) AS inodes FROM files GROUP BY 1 HAVING count(*) > count(DISTINCT inode)")
def _(spark, sf_dir):
    hashed = grouping.fan_out(_all(spark, sf_dir, True), GroupOptions())
    return hashed.groupBy("file_hash").agg(F.count("*").alias("links"), F.countDistinct("inode").alias("inodes")).filter("links > inodes")


@query("rehash_prefilter", f"WITH {LINKED}, c AS (SELECT *, min(inode) OVER (PARTITION BY len) <> max(inode) OVER (PARTITION BY len) AS more FROM files) SELECT path, CASE WHEN more THEN sha256(content) END AS file_hash FROM c")
def _(spark, sf_dir):
    """Files that are alone in their length need no digest."""
    files = _all(spark, sf_dir, True).withColumn("hash", digests.digest(F.col("content"))).drop("content")
    need = files.groupBy("len").agg((F.min("inode") != F.max("inode")).alias("_more"))
    return files.join(need, "len").select("path", F.when(F.col("_more"), F.col("hash")).alias("file_hash"))


@query("group_transformed", f"WITH {FILES}, t AS (SELECT path, len, content[1:200] AS c FROM files) SELECT CAST(least(len, 200) AS BIGINT) AS file_len, sha256(c) AS file_hash, count(*) AS n_files FROM t GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    opts = options(transform=transform.transformed(lambda b: b[:200]))
    return grouping.group(_all(spark, sf_dir), opts).groupBy(*grouping.KEYS).agg(F.count("*").alias("n_files"))


def _groups(spark, sf_dir, links=False, **given):
    return grouping.group_summary(_all(spark, sf_dir, links), options(**given))


_REPLICAS = f"WITH {LINKED} SELECT len AS file_len, sha256(content) AS file_hash, count(*) AS n_files, count(DISTINCT inode) AS replicas FROM files GROUP BY 1, 2"


@query("having_rf_over", f"{_REPLICAS} HAVING count(DISTINCT inode) > 2")
def _(spark, sf_dir):
    return _groups(spark, sf_dir, True, rf_over=2).select(*grouping.KEYS, "n_files", "replicas")


@query("having_rf_under", f"{_REPLICAS} HAVING count(DISTINCT inode) < 3")
def _(spark, sf_dir):
    return _groups(spark, sf_dir, True, rf_under=3).select(*grouping.KEYS, "n_files", "replicas")


@query("having_unique", f"{_REPLICAS} HAVING count(DISTINCT inode) < 2")
def _(spark, sf_dir):
    return _groups(spark, sf_dir, True, unique=True).select(*grouping.KEYS, "n_files", "replicas")


@query("count_distinct_ids", f"WITH {LINKED} SELECT len AS file_len, count(DISTINCT inode) AS ids, CAST(count(DISTINCT inode) * len AS BIGINT) AS size FROM files GROUP BY len")
def _(spark, sf_dir):
    rows = _all(spark, sf_dir, True).groupBy(F.col("len").alias("file_len")).agg(F.countDistinct("device", "inode").alias("ids"))
    return rows.withColumn("size", F.col("ids") * F.col("file_len"))


ROOTS = [f"/src{k}" for k in range(20)]
_ROOT = "CASE WHEN path LIKE '/links/%' THEN 'i1:' || inode ELSE 'r' || substr(string_split(path, '/')[2], 4) END"


@query("subgroup_count", f"WITH {LINKED} SELECT len AS file_len, sha256(content) AS file_hash, count(DISTINCT {_ROOT}) AS replicas FROM files GROUP BY 1, 2 HAVING count(DISTINCT {_ROOT}) > 1")
def _(spark, sf_dir):
    return _groups(spark, sf_dir, True, roots=ROOTS, isolate=True).select(*grouping.KEYS, "replicas")


@query("subgroup_assign", f"WITH {LINKED} SELECT path, {_ROOT} AS subgroup FROM files")
def _(spark, sf_dir):
    return _all(spark, sf_dir, True).select("path", grouping.subgroup_key(ROOTS).alias("subgroup"))


@query("redundant_count", f"WITH {LINKED} SELECT len AS file_len, sha256(content) AS file_hash, count(*) - 1 AS redundant FROM files GROUP BY 1, 2 HAVING count(DISTINCT inode) > 1")
def _(spark, sf_dir):
    return _groups(spark, sf_dir, True).select(*grouping.KEYS, "redundant")


@query(
    "redundant_count_isolated",
    f"WITH {LINKED}, s AS (SELECT len AS file_len, sha256(content) AS file_hash, {_ROOT} AS g, CASE WHEN path LIKE '/links/%' THEN 99 ELSE CAST(substr(string_split(path, '/')[2], 4) AS INT) END AS r, path FROM files),"
    " g AS (SELECT file_len, file_hash, g, min(r) AS r, min(string_split(path, '/')) AS p, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY file_len, file_hash ORDER BY r, len(p), p) AS k FROM g)"
    " SELECT file_len, file_hash, CAST(sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS BIGINT) AS redundant FROM k GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf_dir):
    return _groups(spark, sf_dir, True, roots=ROOTS, isolate=True).select(*grouping.KEYS, "redundant")


@query("missing_count", f"WITH {LINKED} SELECT len AS file_len, sha256(content) AS file_hash, 3 - count(DISTINCT inode) AS missing FROM files GROUP BY 1, 2 HAVING count(DISTINCT inode) < 3")
def _(spark, sf_dir):
    return _groups(spark, sf_dir, True, rf_under=3).select(*grouping.KEYS, "missing")


@query(
    "report_stats",
    f"WITH {LINKED}, g AS (SELECT len, count(*) AS n FROM files GROUP BY len, sha256(content) HAVING count(DISTINCT inode) > 1)"
    " SELECT count(*) AS group_count, CAST(sum(n) AS BIGINT) AS total_file_count, CAST(sum(n * len) AS BIGINT) AS total_file_size, CAST(sum(n - 1) AS BIGINT) AS redundant_file_count, CAST(sum((n - 1) * len) AS BIGINT) AS redundant_file_size, CAST(0 AS BIGINT) AS missing_file_count, CAST(0 AS BIGINT) AS missing_file_size FROM g",
)
def _(spark, sf_dir):
    return grouping.statistics(_groups(spark, sf_dir, True))


@query("partition_by_key", f"WITH {FILES}, {MEMBERS} SELECT len AS file_len, file_hash, string_split(path, '/')[3] AS part, count(*) AS n FROM members WHERE n_files > 1 GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    members = grouping.group(_all(spark, sf_dir), options())
    return members.groupBy(*grouping.KEYS, F.element_at(paths.components(F.col("path")), 3).alias("part")).agg(F.count("*").alias("n"))


@query("partition_by_device", f"WITH {FILES} SELECT inode % 3 AS device, count(*) AS files, CAST(sum(len) AS BIGINT) AS bytes FROM files GROUP BY 1")
def _(spark, sf_dir):
    rows = _all(spark, sf_dir).withColumn("device", F.col("inode") % 3)
    return rows.groupBy("device").agg(F.count("*").alias("files"), F.sum("len").alias("bytes"))


@query("order_groups", f"WITH {FILES}, {MEMBERS}, g AS (SELECT DISTINCT len AS file_len, file_hash FROM members WHERE n_files > 1) SELECT *, row_number() OVER (ORDER BY file_len DESC, array_to_string(list_reverse(regexp_extract_all(file_hash[1:32], '..')), '') DESC) AS place FROM g")
def _(spark, sf_dir):
    """Places by a sort by ranges, whose partitions know how many rows come before theirs."""
    members = grouping.group(_all(spark, sf_dir), options())
    return numbered(members.select(*grouping.KEYS).distinct().orderBy(*grouping.group_order()), "place")


def numbered(ordered, name):
    """Rows of a sorted table with their place, from 1: a count for each partition, and a place within it."""
    from ..session import materialise

    marked = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()
    at, base = 0, {}
    for r in sorted(sizes):
        base[r[0]] = at
        at += r.n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), part) if base else F.lit(0)
    return marked.withColumn(name, (start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint")).drop("_id")


@query("order_files_in_group", f"WITH {LINKED}, h AS (SELECT len AS file_len, sha256(content) AS file_hash, path, inode FROM files), r AS (SELECT file_len, file_hash FROM h GROUP BY ALL HAVING count(DISTINCT inode) > 1) SELECT path, row_number() OVER (PARTITION BY file_len, file_hash ORDER BY len(string_split(path, '/')), string_split(path, '/')) AS place FROM h JOIN r USING (file_len, file_hash)")
def _(spark, sf_dir):
    groups = grouping.nested(grouping.group(_all(spark, sf_dir, True), options()))
    return groups.select(F.posexplode("files").alias("p", "path")).select("path", (F.col("p") + 1).cast("bigint").alias("place"))


def _cached(spark, sf_dir):
    """Chunks of all files, a cache with entries that are valid, older than the file, or of another length, and what computes digests."""
    chunks = cache.chunk_rows(documents.metadata(spark, sf_dir))
    old = chunks.filter("inode % 4 <> 3").select(
        "device", "inode", "chunk_pos", "chunk_len", (F.col("modified_ms") - (F.col("inode") % 4 == 1).cast("bigint")).alias("modified_ms"), (F.col("len") + (F.col("inode") % 4 == 2).cast("bigint")).alias("file_len"),
        F.col("len").alias("data_len"), F.concat(F.lit("cached"), F.col("inode").cast("string")).alias("hash"),
    )
    hashed = documents.files(spark, sf_dir).select("path", digests.digest(F.col("content")).alias("hash"))
    return chunks, old, lambda missed: missed.join(hashed, "path")


@query("hash_cache_lookup", f"WITH {FILES} SELECT path, CASE WHEN inode % 4 = 0 THEN 'cached' || inode END AS cached_hash FROM files")
def _(spark, sf_dir):
    chunks, old, _ = _cached(spark, sf_dir)
    return cache.lookup(chunks, old).select("path", "cached_hash")


@query("cache_join", f"WITH {FILES} SELECT path, CASE WHEN inode % 4 = 0 THEN 'cached' || inode ELSE sha256(content) END AS hash FROM files")
def _(spark, sf_dir):
    chunks, old, compute = _cached(spark, sf_dir)
    return cache.through(chunks, old, compute).select("path", "hash")


@query("hash_cache_store", f"WITH {META} SELECT inode, len AS file_len, CASE WHEN inode % 4 = 0 THEN 'cached' || inode ELSE sha256(content) END AS hash, 1000 * modified AS modified_ms FROM meta WHERE path NOT LIKE '/links/%'")
def _(spark, sf_dir):
    """The cache after a run: what was computed replaces what was stale, and adds what was missing."""
    chunks, old, compute = _cached(spark, sf_dir)
    met = cache.through(chunks, old, compute)
    new = met.filter("cached_hash IS NULL").select(*cache.KEY, "modified_ms", F.col("len").alias("file_len"), F.col("len").alias("data_len"), "hash")
    return cache.merged(old, new).select("inode", "file_len", "hash", "modified_ms")
