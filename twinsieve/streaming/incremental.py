"""Groups of files that keep arriving: each micro-batch adds digests to a table, and groups are told from the table.

There is no state in the stream: a batch that runs again replaces what it wrote. This is a convenience beside the two
batch queries, not a form of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import grouping
from ..options import GroupOptions

SCHEMA = "path string, device bigint, inode bigint, file_len bigint, file_hash string, arrived bigint, batch bigint"


def follow(files: DataFrame, table: str, checkpoint: str, opts: GroupOptions | None = None, once: bool = True) -> StreamingQuery:
    """Start to add the digests of a stream of files (path, device, inode, len, content) to the table.

    once: stop when what is there has been read.
    """
    opts = opts or GroupOptions()

    def add(batch: DataFrame, number: int) -> None:
        chosen = grouping.with_content(grouping.selected(batch, opts), opts)
        rows = chosen.select("path", "device", "inode", F.col("len").alias("file_len"), "file_hash", F.lit(number).cast("bigint").alias("arrived"))
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def members(spark: SparkSession, table: str, opts: GroupOptions | None = None) -> DataFrame:
    """Members of the groups to report of all files so far; of a path that came again, the last one counts."""
    opts = opts or GroupOptions()
    rows = spark.read.schema(SCHEMA).option("basePath", table).parquet(f"{table}/batch=*")
    last = rows.groupBy("path").agg(F.max_by(F.struct("device", "inode", "file_len", "file_hash"), "arrived").alias("f")).select("path", "f.*")
    return grouping.pruned(last, grouping.KEYS, opts, strict=True)
