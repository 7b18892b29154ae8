"""Registered queries: functions of digests, sizes, times and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests, paths, sizes
from ..functions.digests import Algorithm
from ..operators import grouping, transform
from ..options import GroupOptions
from ..sources import documents
from .common import FILES, query



def _digest(algorithm: Algorithm, sql: str | None = None):
    @query(f"hash_{algorithm.value.replace('-', '_')}", sql)
    def _(spark, sf_dir):
        return grouping.with_content(documents.files(spark, sf_dir), GroupOptions(hash_fn=algorithm)).select("path", F.col("file_hash").alias("hash"))


for _algorithm in Algorithm:
    _digest(_algorithm, {Algorithm.SHA256: f"WITH {FILES} SELECT path, sha256(content) AS hash FROM files", Algorithm.MD5: f"WITH {FILES} SELECT path, md5(content) AS hash FROM files"}.get(_algorithm))


@query("chunk_hash", f"WITH {FILES} SELECT path, sha256(content[101:300]) AS hash FROM files")
def _(spark, sf_dir):
    return documents.files(spark, sf_dir).select("path", digests.digest(digests.chunk(F.col("content"), 100, 200)).alias("hash"))


@query(
    "hash_xor",
    f"WITH {FILES}, h AS (SELECT path, md5(content[1:256]) AS a, md5(content[-256:]) AS b FROM files)"
    " SELECT path, string_agg(printf('%08x', xor(CAST('0x' || substr(a, 8 * k + 1, 8) AS BIGINT), CAST('0x' || substr(b, 8 * k + 1, 8) AS BIGINT))), '' ORDER BY k) AS hash FROM h, range(4) AS t(k) GROUP BY path",
)
def _(spark, sf_dir):
    a = F.md5(digests.chunk(F.col("content"), 0, 256))
    b = F.md5(digests.tail(F.col("content"), 256))
    return documents.files(spark, sf_dir).select("path", digests.xor(a, b).alias("hash"))


@query("hash_to_hex", f"WITH {FILES} SELECT path, lower(hex(content[1:8])) AS hex, upper(hex(content[1:8])) AS back FROM files")
def _(spark, sf_dir):
    text = F.lower(F.hex(digests.chunk(F.col("content"), 0, 8)))
    return documents.files(spark, sf_dir).select("path", text.alias("hex"), F.hex(F.unhex(text)).alias("back"))


_SIZES = ["10", "7 B", "100M", "1.5 KB", "2KiB", "3 mib", "x", "1 GB", "4i", "0.5k"]


@query("parse_size", "SELECT text, CAST(bytes AS BIGINT) AS bytes FROM (VALUES ('10', 10), ('7 B', 7), ('100M', 100000000), ('1.5 KB', 1500), ('2KiB', 2048), ('3 mib', 3145728), ('x', NULL), ('1 GB', 1000000000), ('4i', NULL), ('0.5k', 500)) AS t(text, bytes)")
def _(spark, sf_dir):
    rows = spark.createDataFrame([(s,) for s in _SIZES], "text string")
    return rows.withColumn("bytes", sizes.parse_size_column(F.col("text")))


@query(
    "format_size",
    f"WITH {FILES}, s AS (SELECT path, len * len * (1 + inode % 1000) AS size FROM files), u AS (SELECT path, size, CAST(CASE WHEN size <= 1000000 THEN 100 WHEN size <= 1000000000 THEN 100000 WHEN size <= 1000000000000 THEN 100000000 ELSE 100000000000 END AS BIGINT) AS tenth,"
    " CASE WHEN size <= 1000000 THEN ' KB' WHEN size <= 1000000000 THEN ' MB' WHEN size <= 1000000000000 THEN ' GB' ELSE ' TB' END AS unit FROM s),"
    " t AS (SELECT *, size // tenth + CASE WHEN 2 * (size % tenth) > tenth OR (2 * (size % tenth) = tenth AND (size // tenth) % 2 = 1) THEN 1 ELSE 0 END AS n FROM u)"
    " SELECT path, CASE WHEN size <= 1000 THEN size || ' B' ELSE (n // 10) || '.' || (n % 10) || unit END AS text FROM t",
)
def _(spark, sf_dir):
    size = F.col("len") * F.col("len") * (1 + F.col("inode") % 1000)
    return documents.files(spark, sf_dir).select("path", sizes.format_size(size).alias("text"))


@query("format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.') || printf('%03d', CAST(date_part('millisecond', ts) AS BIGINT) % 1000) AS text FROM events")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.regexp_replace(sizes.format_time(F.col("ts")), " [+-]0000$", "").alias("text"))


@query("parse_datetime", "SELECT text, CAST(seconds AS BIGINT) AS seconds FROM (VALUES ('2024-03-05', 1709596800), ('2024-03-05T10:11:12Z', 1709633472), ('2024-03-05 10:11:12+02:00', 1709626272), ('05.03.2024', 1709596800), ('2024/03/05', 1709596800), ('soon', NULL)) AS t(text, seconds)")
def _(spark, sf_dir):
    rows = spark.createDataFrame([(s,) for s in ("2024-03-05", "2024-03-05T10:11:12Z", "2024-03-05 10:11:12+02:00", "05.03.2024", "2024/03/05", "soon")], "text string")
    return rows.withColumn("seconds", F.unix_seconds(sizes.parse_datetime_column(F.col("text"))))


_URL = "p AS (SELECT page_id, '/' || regexp_replace(url, '^https?://', '') AS path FROM pages)"


def _urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("/"), F.regexp_replace("url", "^https?://", "")).alias("path"))


@query("path_is_absolute", f"WITH {_URL} SELECT page_id, page_id % 2 = 0 AS absolute FROM p")
def _(spark, sf_dir):
    some = F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(paths.strip_root(F.col("path")))
    return _urls(spark, sf_dir).select("page_id", paths.is_absolute(some).alias("absolute"))


@query("path_join", f"WITH {_URL} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN path ELSE '/base' || path END AS joined FROM p")
def _(spark, sf_dir):
    other = F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(paths.strip_root(F.col("path")))
    return _urls(spark, sf_dir).select("page_id", paths.join(F.lit("/base/"), other).alias("joined"))


@query("path_file_name", f"WITH {_URL} SELECT page_id, nullif(string_split(path, '/')[-1], '') AS name FROM p")
def _(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", paths.file_name(F.col("path")).alias("name"))


@query("path_parent", f"WITH {_URL} SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS parent FROM p")
def _(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", paths.parent(F.col("path")).alias("parent"))


@query("path_strip_prefix", f"WITH {FILES} SELECT path, CASE WHEN path LIKE '/src1/%' THEN substr(path, 7) END AS below FROM files")
def _(spark, sf_dir):
    return documents.files(spark, sf_dir).select("path", paths.strip_prefix(F.lit("/src1"), F.col("path")).alias("below"))


@query("path_is_prefix_of", f"WITH {FILES} SELECT path, path LIKE '/src1/%' AS below, true AS below_root FROM files")
def _(spark, sf_dir):
    return documents.files(spark, sf_dir).select("path", paths.is_prefix_of(F.lit("/src1"), F.col("path")).alias("below"), paths.is_prefix_of(F.lit("/"), F.col("path")).alias("below_root"))


@query("path_depth", f"WITH {_URL} SELECT page_id, len(string_split(path, '/')) AS depth FROM p")
def _(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", paths.depth(F.col("path")).alias("depth"))


@query("path_order", f"WITH {_URL} SELECT string_split(path, '/')[2] AS host, first(path ORDER BY len(string_split(path, '/')), string_split(path, '/')) AS first FROM p GROUP BY 1")
def _(spark, sf_dir):
    key = F.struct(*[c.alias(n) for c, n in zip(paths.order_key(F.col("path")), ("d", "c"), strict=True)])
    return _urls(spark, sf_dir).groupBy(F.element_at(F.split("path", "/"), 2).alias("host")).agg(F.min_by("path", key).alias("first"))


_NAME = "CASE doc_id % 4 WHEN 0 THEN '/plain/' WHEN 1 THEN '/two words/' WHEN 2 THEN '/it''s/' ELSE '/tab' || chr(9) || '\\/' END || doc_id"


@query(
    "shell_quote",
    f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN p WHEN 1 THEN '''' || p || '''' WHEN 2 THEN '$''/it\\''s/' || doc_id || '''' ELSE '$''/tab\\t\\\\/' || doc_id || '''' END AS quoted FROM (SELECT doc_id, {_NAME} AS p FROM documents)",
)
def _(spark, sf_dir):
    middle = F.element_at(F.array(*[F.lit(x) for x in ("/plain/", "/two words/", "/it's/", "/tab\t\\/")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", paths.quote(F.concat(middle, F.col("doc_id").cast("string"))).alias("quoted"))


@query("move_target", f"WITH {FILES} SELECT path, '/old' || path AS target FROM files")
def _(spark, sf_dir):
    return documents.files(spark, sf_dir).select("path", paths.move_target(F.lit("/old"), F.col("path")).alias("target"))


@query("transform_udf", f"WITH {FILES} SELECT path, CAST(least(len, 2) AS BIGINT) AS new_len, sha256(content[1:2]) AS hash FROM files")
def _(spark, sf_dir):
    """A user's function of bytes; tests run external programs through the same operator."""
    made = transform.apply(lambda content: content[:2])(F.col("content"))
    files = documents.files(spark, sf_dir).withColumn("_t", made)
    return files.select("path", F.col("_t.len").alias("new_len"), digests.digest(F.col("_t.content")).alias("hash"))
