"""What registered queries share: the registry, and the tables of the file tree as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..options import GroupOptions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The file tree of sources.documents, and that with hard links, in DuckDB's SQL.
FILES = "files AS (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, CAST(1 AS BIGINT) AS device, doc_id AS inode, CAST(octet_length(encode(text)) AS BIGINT) AS len, encode(text) AS content FROM documents)"
LINKED = FILES.replace("files AS", "plain AS") + ", files AS (SELECT * FROM plain UNION ALL SELECT '/links/' || inode, device, inode, len, content FROM plain WHERE inode % 10 = 0)"
META = LINKED + ", meta AS (SELECT path, device, inode, len, true AS is_file, 1704067200 + (inode * 53) % 997 AS created, 1704067200 + (inode * 37) % 1000 AS modified, 1704067200 + (inode * 71) % 1009 AS accessed, 1704067200 + (inode * 13) % 991 AS ctime_sec, (inode * 7) % 1000 AS ctime_nsec, content FROM files)"
#: Members of groups with the same content.
MEMBERS = "hashed AS (SELECT *, sha256(content) AS file_hash FROM files), members AS (SELECT *, count(*) OVER (PARTITION BY len, file_hash) AS n_files FROM hashed)"


def options(**given: object) -> GroupOptions:
    """Options of a grouping over documents: unless a least size is given, empty ones count, as they do in the SQL."""
    return GroupOptions(**{"min_size": 0} | given)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL if it has one."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register
