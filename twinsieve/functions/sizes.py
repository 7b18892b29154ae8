"""Sizes and times as text."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_POWER = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4, "p": 5, "e": 6}
_SIZE = re.compile(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgtpe]?)(i?)(b?)\s*", re.IGNORECASE)
UNITS = ["KB", "MB", "GB", "TB", "PB", "EB"]
STAMP = "yyyy-MM-dd HH:mm:ss.SSS xx"


def parse_size(text: str | int) -> int:
    """Bytes of a size such as 100, 1.5 MB (10^6) or 2KiB (2^10)."""
    if isinstance(text, int):
        return text
    found = _SIZE.fullmatch(text)
    if not found or (found[3] and not found[2]):
        raise ValueError(f"not a size: {text!r}")
    size = int(Decimal(found[1]) * (1024 if found[3] else 1000) ** _POWER[found[2].lower()])
    if size >= 2**63:
        raise ValueError(f"too large a size: {text!r}")
    return size


def parse_size_column(text: Column) -> Column:
    """parse_size() of a column; null where the text isn't a size."""
    shape = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgtpe]?)(i?)(b?)\s*$"
    number = F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).cast("decimal(38,6)")
    power = F.position(F.lower(F.regexp_extract(text, shape, 2)), F.lit("kmgtpe"))
    power = F.when(F.regexp_extract(text, shape, 2) == "", F.lit(0)).otherwise(power)
    binary = F.regexp_extract(text, shape, 3) != ""
    factor = F.when(binary, F.pow(F.lit(1024.0), power)).otherwise(F.pow(F.lit(1000.0), power)).cast("decimal(19,0)")
    return F.when(~binary | (power > 0), F.floor(number * factor).cast("bigint"))


def format_size(size: Column) -> Column:
    """A size in decimal units: 16.0 KB for 16000; a unit is used beyond 1000 of the one before it.

    The digit behind the point is rounded half to even, in whole numbers.
    """
    out = F.when(size <= 1000, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(UNITS):
        tenth = 10 ** (3 * k + 2)
        whole, rest = F.floor(size / F.lit(tenth).cast("decimal(19,0)")).cast("bigint"), size % F.lit(tenth)
        up = (rest * 2 > tenth) | ((rest * 2 == tenth) & (whole % 2 == 1))
        tenths = whole + up.cast("bigint")
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == UNITS[-1] else out.when(size <= 10 ** (3 * k + 6), text)
    return out


def size_text(size: int) -> str:
    """format_size() of one number."""
    if size <= 1000:
        return f"{size} B"
    k = 0
    while k < len(UNITS) - 1 and size > 10 ** (3 * k + 6):
        k += 1
    tenths, rest = divmod(size, unit := 10 ** (3 * k + 2))
    tenths += 2 * rest > unit or (2 * rest == unit and tenths % 2)
    return f"{tenths // 10}.{tenths % 10} {UNITS[k]}"


def format_time(time: Column) -> Column:
    return F.date_format(time, STAMP)


def parse_time(text: Column) -> Column:
    return F.to_timestamp(text, STAMP)


def parse_datetime(text: str) -> datetime:
    """A date, or a date and time with or without an offset (without one: UTC)."""
    for shape in ("%Y-%m-%d %H:%M:%S.%f %z", "%Y-%m-%d %H:%M:%S %z", "%d %b %Y", "%Y/%m/%d", "%Y/%m/%d %H:%M:%S", "%d.%m.%Y"):
        try:
            found = datetime.strptime(text.strip(), shape)
            break
        except ValueError:
            continue
    else:
        try:
            found = datetime.fromisoformat(text.strip())
        except ValueError as e:
            raise ValueError(f"not a date or time: {text!r}") from e
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def parse_datetime_column(text: Column) -> Column:
    """Times of ISO texts, or of days written 31.12.2024 or 2024/12/31; null for others. Without an offset: the session's zone."""
    iso = F.try_to_timestamp(text)
    dotted = F.try_to_timestamp(F.regexp_replace(text, r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1"))
    slashed = F.try_to_timestamp(F.regexp_replace(text, "/", "-"))
    return F.coalesce(iso, dotted, slashed)


def epoch_millis(time: Column) -> Column:
    """Milliseconds since 1970; 0 before."""
    return F.greatest(F.unix_millis(time), F.lit(0))
