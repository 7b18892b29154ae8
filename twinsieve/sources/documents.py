"""A table of documents as a file tree: /source/lang/doc_id.txt, with metadata that follows from doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds since 1970 of 2024-01-01; times of a file are some seconds later.
EPOCH = 1_704_067_200


def time(factor: int, span: int) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.col("doc_id") * factor, F.lit(span)))


def files(spark: SparkSession, sf_dir: str, links: bool = False) -> DataFrame:
    """path, device, inode, len, content; with links, every tenth document has a hard link /links/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.col("text").cast("binary")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    if links:
        link = F.concat(F.lit("/links/"), F.col("doc_id").cast("string"))
        docs = docs.withColumn("_path", F.explode(F.when(F.col("doc_id") % 10 == 0, F.array(path, link)).otherwise(F.array(path))))
        path = F.col("_path")
    return docs.select(path.alias("path"), F.lit(1).cast("bigint").alias("device"), F.col("doc_id").alias("inode"), F.octet_length("text").cast("bigint").alias("len"), content.alias("content"))


def metadata(spark: SparkSession, sf_dir: str, links: bool = False) -> DataFrame:
    """path, device, inode, len, is_file and times."""
    return files(spark, sf_dir, links).drop("content").withColumn("doc_id", F.col("inode")).select(
        "path", "device", "inode", "len", F.lit(True).alias("is_file"),
        time(53, 997).alias("created"), time(37, 1000).alias("modified"), time(71, 1009).alias("accessed"),
        (F.lit(EPOCH) + F.pmod(F.col("doc_id") * 13, F.lit(991))).alias("ctime_sec"), F.pmod(F.col("doc_id") * 7, F.lit(1000)).alias("ctime_nsec"),
    )


def generated(spark: SparkSession, groups: int, most: int, size: int = 65_538) -> DataFrame:
    """path, device, inode, len, content: 1 to `most` copies of each of `groups` contents, without chance."""
    md5 = F.md5(F.col("g").cast("string"))
    body = F.concat(F.expr(f"repeat(md5(cast(g as string)), {size // 32})"), F.substring(md5, 1, size % 32))
    copies = F.explode(F.sequence(F.lit(0), F.pmod(F.col("g") * 7, F.lit(most)))).alias("c")
    rows = spark.range(groups).withColumnRenamed("id", "g").select("g", copies)
    path = F.concat_ws("/", F.lit("/gen"), F.col("g").cast("string"), F.col("c").cast("string"))
    return rows.select(path.alias("path"), F.lit(1).cast("bigint").alias("device"), (F.col("g") * most + F.col("c")).alias("inode"), F.lit(size).cast("bigint").alias("len"), body.cast("binary").alias("content"))
