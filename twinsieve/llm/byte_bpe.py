"""Operator 4: byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, kept, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts longer than this many characters are cut at safe boundaries.
LONG = 1 << 16
#: What `\s` of the pattern matches, by Unicode's property White_Space: fixed values.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The library's backtracking over a run of white space fails from some hundred thousand characters on; a run of so many
#: is encoded as the piece that it is.
RUN = 1 << 14


def load(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of about `size` characters that joined are the text, cut where no match of the pattern can cross.

    A cut lies between a letter or digit and a space or line feed: no alternative of the pattern goes on
    from a character that isn't white space to one that is, and a run of white space is never divided.
    A stretch without such a place stays whole. Runs of white space of any length are for pieces() to take out.
    """
    start, n = 0, len(text)
    while n - start > size:
        cut = start + size
        while cut < n and not (text[cut] in " \n" and text[cut - 1].isalnum()):
            cut += 1
        yield text[start:cut]
        start = cut
    if start < n or not n:
        yield text[start:]


def pieces(text: str, size: int = LONG, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """safe_parts(), and whether the part is one match of the pattern: a run of `run` white characters or more.

    Such a match is the whole run at the end of a text; before anything else it leaves the run's last character to what
    follows, where a blank joins the next match and any other is a match by itself.
    """
    at = 0
    for found in re.finditer(f"[{WHITE}]{{{run},}}", text) if len(text) >= run else ():
        end = found.end() - (found.end() < len(text))
        if found.start() > at:
            yield from ((part, False) for part in safe_parts(text[at : found.start()], size))
        yield text[found.start() : end], True
        at = end
    if at < len(text):
        yield from ((part, False) for part in safe_parts(text[at:], size))


def encoded_parts(encoding, text: str | None) -> Iterator[list[int]]:
    """Token ids of a whole text, part by part; none for a null or empty one."""
    for part, single in pieces(text or ""):
        yield encoding._encode_single_piece(part) if single else encoding.encode_ordinary(part)


def encode_text(encoding, text: str | None) -> np.ndarray:
    """Token ids of a whole text; none for a null or empty one."""
    return np.concatenate([np.zeros(0, "<u4"), *(np.array(ids, "<u4") for ids in encoded_parts(encoding, text))])


def decode_ids(encoding, ids: np.ndarray) -> bytes:
    """The raw bytes of token ids, whether or not they are valid UTF-8."""
    return encoding.decode_bytes(ids.tolist())


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<bigint>. A null text counts as empty; other columns are neither read nor returned."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = kept(("tiktoken", ranks, pattern), lambda: load(ranks, pattern))
        for batch in batches:
            ids = [encode_text(encoding, t) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
            flat = np.concatenate(ids).astype("i8") if ids else np.zeros(0, "i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).transform(in_batches, run, f"`{id_col}` {kind}, ids array<bigint>")


def decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, bytes binary: the joined bytes of the ids; a null list gives empty bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = kept(("tiktoken", ranks, pattern), lambda: load(ranks, pattern))
        for batch in batches:
            out = [encoding.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).transform(in_batches, run, f"`{id_col}` {kind}, bytes binary")


def digests(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and digest both sides in one pass; one row for each input row, repeated ones too.

    n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256. A null or empty text
    has no tokens and the digests of no bytes. No shuffle: a text needs only its own row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = kept(("tiktoken", ranks, pattern), lambda: load(ranks, pattern))
        for batch in batches:
            n, coded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                count, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encoded_parts(encoding, text):
                    count += len(ids)
                    a.update(np.array(ids, "<u4").tobytes())
                    b.update(encoding.decode_bytes(ids))
                n.append(count)
                coded.append(a.hexdigest())
                decoded.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).transform(in_batches, run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
