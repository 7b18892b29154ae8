"""Session helpers: nothing here is needed on a cluster that brings its own session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "twinsieve") -> SparkSession:
    """A local session for tests and the bench; a cluster job passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TWINSIEVE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, as in local tests, a temporary folder is made and set for this session; only a local master can
    do with one, others raise ValueError.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="twinsieve-")
    spark.sparkContext.setCheckpointDir(root)
    return jsc.getCheckpointDir().get()


def stage_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder for a table or file set that a later step reads."""
    return f"{shared_dir(spark).rstrip('/')}/twinsieve-{what}-{uuid.uuid4().hex}"


#: Spark then deletes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python about 4 MB at a time, unless the session has a size of its own; for columns of whole contents."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "4m")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back.

    Nothing needs the shuffle files of the writing afterwards, so they go at its end.
    """
    spark = df.sparkSession
    path, before = stage_path(spark, what), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged path through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
