"""Operator 5: token ids in sorted-string-table shards.

A shard holds documents in ascending order of their keys:

    blocks   entries (shared key bytes, new key bytes, value bytes as varints; new key part; value), with a full
             key at every 16th entry and the places of those at the end; each block compressed by zstd
    index    for each block: its first key, offset, stored bytes, entries
    bloom    ten bits a key, seven probes
    footer   offsets of index and bloom, documents, ids, width of an id, magic

A lookup reads footer, index and bloom filter, finds one block by binary search, and in it one run of entries by
binary search over the full keys.
"""

from __future__ import annotations

import bisect
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path
from .common import in_batches, kept, table
from .word_bpe import VOCABULARY, WordEncoder, load

MAGIC = b"TWSSTAB1"
_FOOTER = "<QQQQQQB7x8s"
BLOCK_BYTES, RESTART, PROBES, BITS = 1 << 16, 16, 7, 10
#: Shards at most: their splitters are part of the plan, and the driver adds up their ids.
MOST_SHARDS = 1 << 15


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def to_key(value: int | str | None) -> bytes:
    """Bytes that order as Spark orders the values: null first, integers by size, strings by bytes."""
    if value is None:
        return b"\x00"
    return b"\x01" + (struct.pack(">Q", value + (1 << 63)) if isinstance(value, int) else value.encode())


def from_key(key: bytes, integer: bool = True) -> int | str | None:
    if key == b"\x00":
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if integer else key[1:].decode()


def stored(column: Column, kind: str) -> Column:
    """Ids of type `kind` as integers or strings in the same order."""
    if kind in ("bigint", "int", "smallint", "tinyint", "boolean"):
        return column.cast("int").cast("bigint") if kind == "boolean" else column.cast("bigint")
    if kind == "date":
        return F.unix_date(column).cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "string":
        return column
    raise ValueError(f"ids of type {kind} have no keys in a sorted table")


def restored(column: Column, kind: str) -> Column:
    """The ids that stored() was given."""
    if kind == "date":
        return F.date_from_unix_date(column.cast("int"))
    return F.timestamp_micros(column) if kind == "timestamp" else column.cast(kind)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(hashed: int, bits: int) -> list[int]:
    step = (hashed >> 32) | 1
    return [((hashed + i * step) & 0xFFFFFFFFFFFFFFFF) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard; keys must come in ascending order, equal ones are allowed."""

    def __init__(self, out: Any, width: int):
        self.out, self.width = out, width
        self.at = self.docs = self.ids = 0
        self.index, self.hashes = [], []
        self.squeeze = zstandard.ZstdCompressor(level=3)
        self._begin()

    def _begin(self) -> None:
        self.block, self.size, self.restarts, self.n, self.first, self.last = [], 0, [], 0, b"", b""

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian integers of `width` bytes."""
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(self.size)
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.first = key if not self.n else self.first
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.block.append(entry)
        self.size += len(entry)
        self.n += 1
        self.last = key
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.docs += 1
        self.ids += len(ids) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            tail = struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            data = self.squeeze.compress(b"".join(self.block) + tail)
            self.out.write(data)
            self.index.append((self.first, self.at, len(data), self.n))
            self.at += len(data)
            self._begin()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QII", *rest) for k, *rest in self.index)
        bits = max(64, BITS * len(self.hashes) + 7 & ~7)
        bloom = np.zeros(bits, "u1")
        hashes = np.array(self.hashes, "u8")
        for i in range(PROBES):  # _probes() of all keys
            bloom[(hashes + np.uint64(i) * ((hashes >> np.uint64(32)) | np.uint64(1))) % np.uint64(bits)] = 1
        packed = np.packbits(bloom).tobytes()
        self.out.write(index + packed + struct.pack(_FOOTER, self.at, len(index), self.at + len(index), len(packed), self.docs, self.ids, self.width, MAGIC))
        self.out.close()


class Reader:
    """Reads one shard from a seekable file."""

    def __init__(self, source: Any):
        self.source = source
        end = source.seek(0, 2) if not hasattr(source, "size") else source.size()
        at, n, bloom_at, bloom_n, self.docs, self.ids, self.width, magic = struct.unpack(_FOOTER, self._read(end - struct.calcsize(_FOOTER), struct.calcsize(_FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        data, self.index, k = self._read(at, n), [], 0
        while k < n:
            size, k = _read_varint(data, k)
            self.index.append((data[k : k + size], *struct.unpack_from("<QII", data, k + size)))
            k += size + 16
        self.first_keys = [x[0] for x in self.index]
        self.bloom = self._read(bloom_at, bloom_n)
        self.open = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, at, n, _ = self.index[k]
        data = self.open.decompress(self._read(at, n))
        (count,) = struct.unpack_from("<I", data, len(data) - 4)
        body = len(data) - 4 * (count + 1)
        return data[:body], list(struct.unpack_from(f"<{count}I", data, body))

    @staticmethod
    def _entries(body: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            new, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + new]
            yield key, body[at + new : at + new + size]
            at += new + size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._entries(self._block(k)[0])

    def may_hold(self, key: bytes) -> bool:
        bits = 8 * len(self.bloom)
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(xxhash.xxh64_intdigest(key), bits))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: none, one, or several if it was added repeatedly."""
        if not self.index or not self.may_hold(key):
            return []
        found = []
        for k in range(max(0, bisect.bisect_left(self.first_keys, key) - 1), len(self.index)):
            if self.first_keys[k] > key:
                break
            body, restarts = self._block(k)
            low, high = 0, len(restarts)
            while low < high:  # the first full key that isn't below
                mid = (low + high) // 2
                low, high = (mid + 1, high) if next(self._entries(body, restarts[mid]))[0] < key else (low, mid)
            for other, value in self._entries(body, restarts[max(0, low - 1)]):
                if other > key:
                    break
                if other == key:
                    found.append(value)
        return found

    def ids_of(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")


def encode(df: DataFrame, vocabulary: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids binary: the ids of each whole text (null: empty) and the end id, little-endian, `width` bytes each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("words", vocabulary), lambda: WordEncoder(vocabulary))
        for batch in batches:
            out = [x.astype(f"<u{width}").tobytes() for x in encoder.encode(batch.column(1).to_pylist(), end_id)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).transform(in_batches, run, f"`{id_col}` {kind}, ids binary")


def write(df: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20) -> DataFrame:
    """Write shards under `path`, a folder that all executors reach; returns their manifest.

    Ranges of ids come from the id column alone, by approximate quantiles, so texts are encoded once and the
    one shuffle carries their ids. shard_bytes: text bytes to a shard, on average. A shard's file name holds a
    random part: of a task that is run again, the manifest names the file of the run that counted. The manifest
    (shard int, path string, docs long, n_ids long, first, last key) is written under `path`, too.
    A null id comes first; rows of the same id are ordered by their ids' bytes, and are in one shard, which a task
    writes as it reads them. Ids may be integers, strings, dates, timestamps or booleans, others raise ValueError; in
    the manifest and in lookup() they are integers or strings, as of stored(), and `kind` names their type. An id takes
    two bytes, or four if the vocabulary or the end id has need of them. From MOST_SHARDS on shards grow instead.
    """
    spark, original = df.sparkSession, df.schema[id_col].dataType.simpleString()
    df = df.select(stored(F.col(id_col), original).alias("id"), F.col(text_col).alias("text"))
    id_col, text_col, kind = "id", "text", "string" if original == "string" else "bigint"
    total = df.agg(F.sum(F.octet_length(text_col).cast("bigint")).alias("n"), F.count("*").alias("rows")).first()
    shards = min(MOST_SHARDS, max(1, math.ceil(((total.n or 0) + 8 * total.rows) / shard_bytes)))
    width = 2 if max(load(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    splits: list[Any] = []
    if shards > 1:
        if kind == "bigint":
            quantiles = [k / shards for k in range(1, shards)]
            splits = sorted(set(df.agg(F.percentile_approx(id_col, quantiles, max(10_000, 20 * shards)).alias("q")).first().q or []))
        else:  # strings: bounded sample of 100 ids a shard
            sample = [r[0] for r in df.select(id_col).filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col)).limit(100 * shards).collect()]
            sample.sort()
            splits = sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []
    shards = len(splits) + 1
    typed = F.lit(splits).cast(f"array<{kind}>") if splits else None
    shard = F.coalesce(_rank_in(typed, F.col(id_col), len(splits)), F.lit(0)) if splits else F.lit(0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_no = TaskContext.get().partitionId()
        writer = name = first = last = None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    fs, folder = file_system(path)
                    fs.create_dir(folder, recursive=True)
                    name, first = f"shard-{shard_no:06d}-{uuid.uuid4().hex[:12]}.sst", key
                    writer = Writer(fs.open_output_stream(f"{folder}/{name}"), width)
                writer.add(to_key(key), ids)
                last = key
        if writer is not None:
            writer.close()
            row = [[shard_no], [f"{path}/{name}"], [writer.docs], [writer.ids]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)] + [pa.array([first], batch.schema.field(0).type), pa.array([last], batch.schema.field(0).type)], names=["shard", "path", "docs", "n_ids", "first", "last"])

    schema = f"shard int, path string, docs bigint, n_ids bigint, first {kind}, last {kind}"
    (
        encode(df, vocabulary, end_id, width, id_col, text_col)
        .withColumn("_shard", shard)
        .repartitionById(shards, F.col("_shard"))
        .sortWithinPartitions(id_col, "ids")
        .select(id_col, "ids")
        .transform(in_batches, run, schema)
        .withColumn("kind", F.lit(original))
        .write.parquet(f"{path}/manifest")
    )
    return spark.read.schema(f"{schema}, kind string").parquet(f"{path}/manifest")


def _rank_in(splits: Column, value: Column, n: int) -> Column:
    """How many of n sorted splitters are <= value: a binary search, its steps folded over an array."""
    steps = [1 << k for k in range(max(0, n.bit_length() - 1), -1, -1)]

    def further(at: Column, step: Column) -> Column:
        return at + F.when(F.try_element_at(splits, at + step) <= value, step).otherwise(F.lit(0))

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), further)


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 of every document, from the files.

    The manifest has a row for each shard, which the driver turns into the ids before each shard.
    """
    spark = manifest.sparkSession
    kind = manifest.schema["first"].dataType.simpleString()
    arrow_kind = pa.string() if kind == "string" else pa.int64()
    starts, at, original = [], 0, kind
    for r in sorted(manifest.select("shard", "path", "n_ids", "kind").collect()):
        original = r.kind
        starts.append((r.path, at))
        at += r.n_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = file_system(path)
                reader, rows = Reader(fs.open_input_file(place)), []
                for key, value in reader.scan():
                    ids = reader.ids_of(value)
                    rows.append((from_key(key, kind != "string"), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows, arrow_kind, id_col)
                        rows = []
                if rows:
                    yield _rows(rows, arrow_kind, id_col)

    schema = f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    rows = spark.createDataFrame(starts, "path string, start bigint").repartition(max(1, len(starts))).transform(in_batches, run, schema)
    return rows.withColumn(id_col, restored(F.col(f"`{id_col}`"), original))


def _rows(rows: list[tuple], kind: pa.DataType, id_col: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, keys: list[int | str | None]) -> dict[int | str | None, list[np.ndarray]]:
    """Ids of a few documents, read by the driver from the shards whose range holds their keys."""
    found: dict[int | str | None, list[np.ndarray]] = {k: [] for k in keys}
    for r in manifest.collect():
        inside = [k for k in found if to_key(r["first"]) <= to_key(k) <= to_key(r["last"])]
        if inside:
            fs, place = file_system(r.path)
            reader = Reader(fs.open_input_file(place))
            for k in inside:
                found[k] += [reader.ids_of(v) for v in reader.get(to_key(k))]
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "sst")
    manifest = write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path(VOCABULARY), 2)
    return read(manifest)
