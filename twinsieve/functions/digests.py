"""Digests of binary columns, as lower-case hexadecimal text.

md5, sha256 and sha512 are Spark's own; the others run in Python over Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from enum import StrEnum

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Algorithm(StrEnum):
    METRO = "metro"
    XXHASH3 = "xxhash3"
    BLAKE3 = "blake3"
    SHA256 = "sha256"
    SHA512 = "sha512"
    SHA3_256 = "sha3-256"
    SHA3_512 = "sha3-512"
    MD5 = "md5"

    @classmethod
    def parse(cls, text: str) -> Algorithm:
        name = text.strip().lower().replace("_", "-")
        name = {"xxhash": "xxhash3", "sha3-256": "sha3-256"}.get(name, name)
        try:
            return cls(name)
        except ValueError:
            raise ValueError(f"unknown hash function {text!r}; there are {', '.join(cls)}") from None


def _xxhash3(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(data)


def _blake3(data: bytes) -> bytes:
    try:
        import blake3
    except ImportError:
        from twinsieve.functions.blake import blake3 as own

        return own(data)
    return blake3.blake3(data).digest()


def _blake3_many(contents: Iterable[bytes]) -> Iterator[bytes]:
    """About one MB at a time, of which no more is held, where the library is missing."""
    try:
        import blake3
    except ImportError:
        from twinsieve.functions.blake import blake3_many
    else:
        yield from (blake3.blake3(b).digest() for b in contents)
        return
    part: list[bytes] = []
    size = 0
    for b in contents:
        part.append(b)
        size += len(b)
        if size > 1 << 20:
            yield from blake3_many(part)
            part, size = [], 0
    yield from blake3_many(part)


def _metro(data: bytes) -> bytes:
    from twinsieve.functions.metro import metro128

    return metro128(data)


def in_python(algorithm: Algorithm) -> Callable[[bytes], bytes]:
    """The digest function of bytes."""
    return {
        Algorithm.METRO: _metro,
        Algorithm.XXHASH3: _xxhash3,
        Algorithm.BLAKE3: _blake3,
        Algorithm.SHA256: lambda b: hashlib.sha256(b).digest(),
        Algorithm.SHA512: lambda b: hashlib.sha512(b).digest(),
        Algorithm.SHA3_256: lambda b: hashlib.sha3_256(b).digest(),
        Algorithm.SHA3_512: lambda b: hashlib.sha3_512(b).digest(),
        Algorithm.MD5: lambda b: hashlib.md5(b, usedforsecurity=False).digest(),
    }[algorithm]


class Stream:
    """A digest fed piece by piece: update(bytes), hexdigest(). Algorithms without such a form hold the whole content."""

    def __init__(self, algorithm: Algorithm):
        self.of, self.held = in_python(algorithm), None
        name = {Algorithm.SHA3_256: "sha3_256", Algorithm.SHA3_512: "sha3_512"}.get(algorithm, algorithm.value)
        if algorithm == Algorithm.XXHASH3:
            import xxhash

            self.state = xxhash.xxh3_128()
        elif name in hashlib.algorithms_available:
            self.state = hashlib.new(name, usedforsecurity=False)
        else:
            self.held = bytearray()

    def update(self, data: bytes) -> None:
        if self.held is None:
            self.state.update(data)
        else:
            self.held += data

    def hexdigest(self) -> str:
        return self.state.hexdigest() if self.held is None else self.of(bytes(self.held)).hex()


def digest(content: Column, algorithm: Algorithm | str = Algorithm.SHA256) -> Column:
    """The hexadecimal digest of a binary column; null for null."""
    algorithm = Algorithm.parse(algorithm)
    if runs_in_python(algorithm):
        return digest_udf(algorithm)(content)
    return F.md5(content) if algorithm == Algorithm.MD5 else F.sha2(content, int(algorithm[3:]))


def runs_in_python(algorithm: Algorithm | str) -> bool:
    return Algorithm.parse(algorithm) not in (Algorithm.MD5, Algorithm.SHA256, Algorithm.SHA512)


def digest_udf(algorithm: Algorithm) -> Callable[[Column], Column]:
    of = in_python(algorithm)
    many = _blake3_many if algorithm == Algorithm.BLAKE3 else lambda contents: map(of, contents)

    @F.arrow_udf("string")
    def hexadecimal(content: pa.Array) -> pa.Array:
        # contents leave Arrow one by one, so that they are not held a second time
        found = many(b.as_py() for b in content if b.is_valid)
        return pa.array([next(found).hex() if there else None for there in content.is_valid().to_pylist()], pa.string())

    return hexadecimal


def chunk(content: Column, start: int | Column, length: int | Column) -> Column:
    """Bytes [start, start + length) of a binary column, as far as they are there."""
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return F.substring(content, start.cast("int") + 1, length.cast("int"))


def tail(content: Column, length: int) -> Column:
    """The last `length` bytes, or all if there are fewer."""
    return F.when(F.octet_length(content) <= length, content).otherwise(F.substring(content, -length, length))


def xor(a: Column, b: Column) -> Column:
    """Digests of equal width, given in hexadecimal, joined bit by bit; a wider one's rest counts as 0.

    Each group of eight signs is a number of 32 bits.
    """
    width = F.greatest(F.length(a), F.length(b))
    both = F.least(F.length(a), F.length(b))

    def word(text: Column, k: Column) -> Column:
        return F.conv(F.substr(text, k * 8 + 1, F.lit(8)), 16, 10).cast("bigint")

    words = F.transform(F.sequence(F.lit(0), F.floor(both / 8).cast("int") - 1), lambda k: F.lpad(F.lower(F.hex(word(a, k).bitwiseXOR(word(b, k)))), 8, "0"))
    return F.rpad(F.array_join(words, ""), width.cast("int"), "0")


def first_number_key(hexadecimal: Column) -> Column:
    """Sorts as the little-endian number in the first 16 bytes of a digest."""
    pairs = F.regexp_extract_all(F.rpad(F.substring(hexadecimal, 1, 32), 32, "0"), F.lit("(..)"), 1)
    return F.array_join(F.reverse(pairs), "")
