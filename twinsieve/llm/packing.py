"""Operator 7: packing token ids into windows by minimum bin slack.

Documents are cut into full windows and a remainder. Remainders are packed from the histogram of their lengths,
which has at most window - 1 entries whatever the input: a bitset subset-sum dynamic program picks the multiset of
remaining lengths, with the longest one in it, that fills a window closest to capacity; the counts are backtracked,
and the pattern is used as often as the histogram holds it. The pieces then take their places by their rank within
their length, without a shuffle of ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .common import in_batches, kept, table
from .word_bpe import VOCABULARY, WordEncoder

WINDOW, END = 2048, 1


def _power(n: int) -> bool:
    return n & (n - 1) == 0


def best_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """length -> how many of it fill one window with least padding; the longest length is in it.

    A window whose total is a power of two has no padding. Ties go to the larger total.
    """
    longest = max(counts)
    target = window - longest
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), target // length)
        chunk = 1
        while left > 0:  # counts by powers of two
            take = min(chunk, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take)
            left -= take
            chunk *= 2
        reach &= (2 << target) - 1
        if reach >> target & 1:
            break
    total = longest + reach.bit_length() - 1
    if total != window:
        powers = [p for p in (1 << k for k in range(window.bit_length())) if longest <= p <= window and reach >> (p - longest) & 1]
        total = powers[-1] if powers else total
    rest, fill = total - longest, {longest: 1}
    for before, length, take in reversed(steps):
        if not before >> rest & 1:
            rest -= length * take
            fill[length] = fill.get(length, 0) + take
    return fill


def patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(length -> count in a window, windows like that) until all lengths are used."""
    counts = {k: n for k, n in histogram.items() if n}
    found = []
    if full := counts.pop(window, 0):
        found.append(({window: 1}, full))
    while counts:
        fill = best_fill(counts, window)
        times = min(counts[k] // n for k, n in fill.items())
        found.append((fill, times))
        for k, n in fill.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return found


class Places:
    """Where the piece of a given rank among those of its length goes."""

    def __init__(self, found: list[tuple[dict[int, int], int]]):
        rows, used, sequence = [], {}, 0
        for fill, times in found:
            offset = 0
            for length in sorted(fill, reverse=True):
                n = fill[length]
                first = used.get(length, 0)
                rows.append((length, first, n, sequence, offset))
                used[length] = first + n * times
                offset += length * n
            sequence += times
        rows.sort()
        self.length, self.first, self.n, self.sequence, self.offset = (np.array(c, "i8") for c in zip(*rows, strict=True)) if rows else (np.zeros(0, "i8"),) * 5
        self.key = self._key(self.length, self.first)
        self.windows = sequence

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << 46) + rank

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id, offset."""
        at = np.searchsorted(self.key, self._key(length, rank), "right") - 1
        k = rank - self.first[at]
        return self.sequence[at] + k // self.n[at], self.offset[at] + k % self.n[at] * length


def cut(df: DataFrame, vocabulary: str, end_id: int = END, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text's ids and end id: full windows, then the remainder.

    id_col, start, length, ids_crc32, doc_tokens, part (the task), rank (among the task's pieces of this length).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("words", vocabulary), lambda: WordEncoder(vocabulary))
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, "i8")
        for batch in batches:
            doc, rows = [], []
            for k, ids in enumerate(encoder.encode(batch.column(1).to_pylist(), end_id)):
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, int(seen[len(piece)])))
                    seen[len(piece)] += 1
                    doc.append(k)
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True))], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).transform(in_batches, run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, rank bigint")


def place(pieces: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """pieces: the stored result of cut(). Adds sequence_id and offset; every piece keeps its row.

    The driver gets the histogram of lengths, at most `window` rows. Counts of a length by task give each task's
    first rank by a running sum. An empty table gives no pieces.
    """
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(patterns(histogram, window))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = places.of(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = pieces.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    ranked = pieces.join(firsts, ["part", "length"]).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.transform(in_batches, run, schema)


def pack(df: DataFrame, vocabulary: str, end_id: int = END, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    A null text is an empty one (its end id alone); repeated rows are packed each for itself; other columns are
    neither read nor returned. The pieces, some forty bytes each, are stored once in the shared folder, so that
    ranks and histogram agree whatever tasks run again.
    """
    return place(materialise(cut(df, vocabulary, end_id, window, id_col, text_col), "pieces"), window, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
