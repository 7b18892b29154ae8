"""A table of digests of earlier runs, by algorithm and transformation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import epoch_millis

KEY = ["device", "inode", "chunk_pos", "chunk_len"]
#: The namespace of digests without a transformation.
PLAIN = "-"
SCHEMA = "device bigint, inode bigint, chunk_pos bigint, chunk_len bigint, modified_ms bigint, file_len bigint, data_len bigint, hash string, algorithm string, transform string"


def lookup(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks (KEY, modified_ms, len, ...) with cached_hash and cached_len: null where the cache has none that is valid.

    An entry is valid as long as the file's time of modification, in milliseconds, and its length are what they were.
    """
    state = [*KEY, "modified_ms", "len"]
    entries = cache.select(*KEY, "modified_ms", F.col("file_len").alias("len"), "hash", "data_len")
    entries = entries.groupBy(*state).agg(F.max(F.struct("hash", "data_len")).alias("_entry"))  # an append may repeat one
    return chunks.join(entries, state, "left").withColumns({"cached_hash": F.col("_entry.hash"), "cached_len": F.col("_entry.data_len")}).drop("_entry")


def through(chunks: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """chunks with hash and cached_hash: what the cache has, else what compute() adds, as hash, to those it hasn't."""
    met = lookup(chunks, cache)
    hits = met.filter("cached_hash IS NOT NULL").withColumn("hash", F.col("cached_hash"))
    return hits.unionByName(compute(met.filter("cached_hash IS NULL")))


def merged(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries in the place of old ones of the same key (and of later ones among the new)."""
    value = ["modified_ms", "file_len", "data_len", "hash"]
    both = cache.select(*KEY, *value, F.lit(0).alias("_age")).union(new.select(*KEY, *value, F.lit(1).alias("_age")))
    best = both.groupBy(*KEY).agg(F.max(F.struct("_age", *value)).alias("_v"))
    return best.select(*KEY, *[F.col(f"_v.{c}").alias(c) for c in value])


def opened(spark: SparkSession, path: str, algorithm: str, transform: str | None = None) -> DataFrame:
    """The entries of one algorithm and transformation; none if there is no such cache yet."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
    table = spark.read.schema(SCHEMA).parquet(path) if exists else spark.createDataFrame([], SCHEMA)
    return table.filter((F.col("algorithm") == algorithm) & (F.col("transform") == (transform or PLAIN)))


def store(entries: DataFrame, path: str, algorithm: str, transform: str | None = None) -> None:
    """Append entries to the namespace of an algorithm and transformation; merged() of what is read resolves keys."""
    entries.select(*KEY, "modified_ms", "file_len", "data_len", "hash", F.lit(algorithm).alias("algorithm"), F.lit(transform or PLAIN).alias("transform")).write.mode("append").partitionBy("algorithm", "transform").parquet(path)


def chunk_rows(files: DataFrame, start: int = 0, length: Column | None = None) -> DataFrame:
    """files (device, inode, len, modified, ...) with KEY and modified_ms of one chunk each."""
    length = F.col("len") if length is None else length
    return files.withColumns({"chunk_pos": F.lit(start).cast("bigint"), "chunk_len": length.cast("bigint"), "modified_ms": epoch_millis(F.col("modified"))})
