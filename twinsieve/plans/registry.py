"""The registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from . import deduplication, grouping, scalars, selection  # noqa: F401 - they register their queries
from .common import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
