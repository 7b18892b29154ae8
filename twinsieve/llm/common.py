"""What the operators share: table reading, the held-out rule, state that Python workers keep."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialise

#: Keys that may each hold more than this part of all rows: there are at most so many, so that they can be broadcast.
HEAVY = 4096
#: Bits of the broadcast map that tells rows by their keys, at most (8 MB), and for each key while there are few.
SLOTS, SLOTS_EACH = 1 << 26, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps over its tasks, until another one is asked for."""
    store = sys.__dict__.setdefault("_twinsieve_kept", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def give_back(spark: SparkSession | None = None) -> None:
    """Return memory that this process, and the driver's JVM if a session is given, holds without need to the system."""
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def executors_give_back(spark: SparkSession) -> None:
    """Have the executors' JVMs return memory to the system that they hold without need, for use between stages.

    A heap that grew in one stage otherwise stays as it is while Python workers grow in the next. There is a task for each
    core, which idle executors take alike; an executor that gets none keeps what it has, and no result depends on it.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema), sparing of memory, for use with DataFrame.transform.

    Rows, which may hold long texts, go to Python 2000 at a time, unless the session has a number of its own; at its end
    a task gives back what its worker holds without need.
    """

    def sparing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, "2000")
    return df.mapInArrow(sparing, schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with as many underscores before it as no column of df needs."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_facts(rows: DataFrame, facts: DataFrame, key: str, times: str, total: int, how: str = "inner") -> DataFrame:
    """rows.join(facts, key, how), without a hot key in the shuffle.

    facts has a row for each key, and in `times` how often `rows` has it, or more; these add up to `total` or less. Keys
    with more than one HEAVY-th of the total, fewer than HEAVY by that, are broadcast; no other key is hot.
    """
    hot = facts.filter(F.col(times) * HEAVY > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.filter(F.col(times) * HEAVY <= total), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def told_apart(rows: DataFrame, ids: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose `col` may be among ids (one stored column without null), and rows whose `col` is not.

    A broadcast map of bits by a hash of the ids tells: every row with one of the ids is among the first, and with it a
    few others while ids are not many more than SLOTS. So a join of long rows with ids need only shuffle the first.
    """
    slots = 1 << 15
    while slots < min(SLOTS, SLOTS_EACH * ids.count()):
        slots *= 2
    kind = ids.schema[0].dataType
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast(kind)), F.lit(slots))
    bits = ids.select(slot(ids.columns[0]).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    at, part, bitmap = (free_name(rows, x) for x in ("at", "part", "bitmap"))
    place = F.bitmap_bit_position(slot(col))
    asked = rows.withColumns({at: place, part: F.bitmap_bucket_number(slot(col))})
    asked = asked.join(F.broadcast(bits.select(F.col("b").alias(part), F.col("m").alias(bitmap))), part, "left")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(F.col(at), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce((byte.bitwiseAND(F.pow(F.lit(2), F.col(at) % 8).cast("int")) != 0) & F.col(col).isNotNull(), F.lit(False))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return asked.filter(hit).select(*own), asked.filter(~hit).select(*own)


def without(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """rows but those whose `col` is among ids (one stored column without null): only what may be one is shuffled."""
    maybe, others = told_apart(rows, ids, col)
    own = free_name(rows, "own")
    return others.union(maybe.join(ids.toDF(own), F.col(col).cast(ids.schema[0].dataType) == F.col(own), "left_anti"))


def text_tag(text_col: str) -> Column:
    """SHA-256 of a text; a null one counts as empty."""
    return F.sha2(F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")), 256)


def numbered(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc bigint, bytes binary), and, if ids are no unique integers, the table of what each doc stands for.

    Then distinct (id, text) rows are numbered in the order of id (null first) and digest of the text.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("bytes"))
    integer = df.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if integer and rows.groupBy("id").count().filter("count > 1 OR id IS NULL").limit(1).count() == 0:
        return rows.select(F.col("id").cast("bigint").alias("doc"), "bytes"), None
    tagged = rows.withColumn("tag", F.sha2("bytes", 256)).dropDuplicates(["id", "tag"])
    found = materialise(tagged.orderBy(F.col("id").asc_nulls_first(), "tag").withColumn("doc", F.monotonically_increasing_id()), "numbered")
    return found.select("doc", "bytes"), found.select("doc", "id", "tag")


_WORD_SIGNS = "".join(c if c.isalnum() or c == "_" else " " for c in map(chr, range(128)))


def word_runs(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case; an ASCII text is split without a regular expression."""
    low = text.lower()
    return low.translate(_WORD_SIGNS).split() if low.isascii() else re.findall(r"\w+", low)


class Bounded(dict):
    """word -> value by make(word), forgotten as a whole beyond `most` words; long words are not kept."""

    def __init__(self, make: Callable[[str], Any], most: int = 300_000, longest: int = 40):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, word: str) -> Any:
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value
