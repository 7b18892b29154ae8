"""Registered queries: priorities, what stays and what goes, plans, scripts and reports."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..operators import dedupe, grouping, reports
from ..options import DedupeOptions
from ..session import stage_path
from ..sources import documents
from .common import META, options, query

_GROUPED = (
    f"WITH {META}, g AS (SELECT len AS file_len, sha256(content) AS file_hash, string_split(path, '/') AS c, * EXCLUDE (len, content) FROM meta),"
    " r AS (SELECT file_len, file_hash FROM g GROUP BY ALL HAVING count(DISTINCT inode) > 1), m AS (SELECT g.* FROM g JOIN r USING (file_len, file_hash)),"
    " s AS (SELECT file_len, file_hash, inode, min(created) AS created, max(modified) AS modified, max(accessed) AS accessed, max(ctime_sec * 1000 + ctime_nsec) AS changed, min(len(c)) AS min_nesting, max(len(c)) AS max_nesting, min([len(c)]) AS d, first(c ORDER BY len(c), c) AS c, count(*) AS n_files"
)


def _sql(order: str, keep: int = 1, forced: str = "false", columns: str = "path, keep") -> str:
    """Files with `keep`, by ranks of the replicas (inodes) in the order of the SQL `order` (over s)."""
    return (
        f"{_GROUPED}, {forced} AS forced FROM m GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY file_len, file_hash, forced ORDER BY {order}) AS k, count(*) FILTER (forced) OVER (PARTITION BY file_len, file_hash) AS f FROM s),"
        f" p AS (SELECT m.*, forced, (forced OR k <= {keep} - f) AS keep, k FROM k JOIN m USING (file_len, file_hash, inode)),"
        f" t AS (SELECT file_len, file_hash, '' || array_to_string(first(c ORDER BY NOT forced, k), '/') AS target FROM k GROUP BY ALL) SELECT {columns} FROM p JOIN t USING (file_len, file_hash)"
    )


def _inputs(spark, sf_dir):
    members = grouping.group(documents.files(spark, sf_dir, True), options())
    return members, documents.metadata(spark, sf_dir, True)


def _partitioned(spark, sf_dir, **options):
    opts = DedupeOptions(**options)
    files, keys = dedupe.candidates(*_inputs(spark, sf_dir), opts)
    return dedupe.partition(files, keys, opts)


_PLACE, _BACK = "len(c), c", "len(c) DESC, c DESC"


def _priority(name: str, priorities: list[str], order: str) -> None:
    @query(name, _sql(order))
    def _(spark, sf_dir):
        return _partitioned(spark, sf_dir, priority=priorities).select("path", "keep")


_priority("priority_top", ["top"], _BACK)
_priority("priority_bottom", ["bottom"], _PLACE)
_priority("priority_newest", ["newest"], f"created, {_PLACE}")
_priority("priority_oldest", ["oldest"], f"created DESC, {_PLACE}")
_priority("priority_mtime_most", ["most-recently-modified"], f"modified, {_PLACE}")
_priority("priority_mtime_least", ["least-recently-modified"], f"modified DESC, {_PLACE}")
_priority("priority_atime_most", ["most-recently-accessed"], f"accessed, {_PLACE}")
_priority("priority_atime_least", ["least-recently-accessed"], f"accessed DESC, {_PLACE}")
_priority("priority_ctime_most", ["most-recent-status-change"], f"changed, {_PLACE}")
_priority("priority_ctime_least", ["least-recent-status-change"], f"changed DESC, {_PLACE}")
_priority("priority_most_nested", ["most-nested"], f"max_nesting, {_PLACE}")
_priority("priority_least_nested", ["least-nested"], f"min_nesting DESC, {_PLACE}")
_priority("priority_composite", ["most-nested", "top", "newest"], f"max_nesting, created DESC, {_BACK}")


@query("dedupe_keep_patterns", _sql(_PLACE, 1, "bool_or(path LIKE '/src1%' OR regexp_full_match(path, '.*/[^/]*5\\.txt'))"))
def _(spark, sf_dir):
    return _partitioned(spark, sf_dir, keep_paths=["/src1**"], keep_names=["*5.txt"]).select("path", "keep")


@query("dedupe_drop_patterns", _sql(_PLACE, 1, "NOT bool_and(path LIKE '/links/%' OR regexp_full_match(path, '.*/[^/]*[0-6]\\.txt'))"))
def _(spark, sf_dir):
    return _partitioned(spark, sf_dir, paths=["/links/**"], names=["*[0-6].txt"]).select("path", "keep")


@query("dedupe_partition", _sql(f"modified DESC, {_PLACE}", 1, "bool_or(path LIKE '/src2/%')"))
def _(spark, sf_dir):
    return _partitioned(spark, sf_dir, priority=["least-recently-modified"], keep_paths=["/src2/**"]).select("path", "keep")


@query("limit_keep_n", _sql(_PLACE, 3))
def _(spark, sf_dir):
    return _partitioned(spark, sf_dir, rf_over=3).select("path", "keep")


@query("subgroup_min_max_times", f"{_GROUPED} FROM m GROUP BY ALL) SELECT file_hash, inode, created, modified, accessed, changed, n_files FROM s")
def _(spark, sf_dir):
    files, keys = dedupe.candidates(*_inputs(spark, sf_dir), DedupeOptions())
    groups = dedupe.subgroups(files, keys, DedupeOptions())
    seconds = [F.unix_seconds(c).alias(c) for c in ("created", "modified", "accessed")]
    changed = F.col("changed.ctime_sec") * 1000 + F.col("changed.ctime_nsec")
    return groups.select("file_hash", F.regexp_extract("subgroup", "[0-9]+$", 0).cast("bigint").alias("inode"), *seconds, changed.alias("changed"), "n_files")


@query("subgroup_nesting", f"{_GROUPED} FROM m GROUP BY ALL) SELECT file_hash, inode, min_nesting, max_nesting FROM s")
def _(spark, sf_dir):
    files, keys = dedupe.candidates(*_inputs(spark, sf_dir), DedupeOptions())
    groups = dedupe.subgroups(files, keys, DedupeOptions())
    return groups.select("file_hash", F.regexp_extract("subgroup", "[0-9]+$", 0).cast("bigint").alias("inode"), F.col("min_nesting").cast("bigint").alias("min_nesting"), F.col("max_nesting").cast("bigint").alias("max_nesting"))


def _plan(spark, sf_dir, operation, **options):
    return dedupe.plan(*_inputs(spark, sf_dir), operation, DedupeOptions(**options))


def _plan_sql(operation: str, target: str) -> str:
    return _sql(_PLACE, columns=f"'{operation}' AS op, path AS source, {target} AS target, file_len AS reclaimed") + " WHERE NOT keep"


for _name, _operation, _target in (("plan_remove", "remove", "CAST(NULL AS VARCHAR)"), ("plan_link_soft", "symlink", "target"), ("plan_link_hard", "hardlink", "target"), ("plan_reflink", "reflink", "target"), ("plan_move", "move", "'/old' || path")):

    @query(_name, _plan_sql(_operation, _target))
    def _(spark, sf_dir, operation=_operation):
        return _plan(spark, sf_dir, operation, target="/old").select("op", "source", "target", "reclaimed")


_SHELL = {
    "remove": "['rm ' || path]",
    "symlink": "['mv ' || path || ' ' || path || '.' || sha256(path)[1:24], 'ln -s ' || target || ' ' || path, 'rm ' || path || '.' || sha256(path)[1:24]]",
}


@query("plan_script", _sql(_PLACE, columns="path AS source, unnest(" + _SHELL["symlink"] + ") AS line") + " WHERE NOT keep")
def _(spark, sf_dir):
    return dedupe.commands(_plan(spark, sf_dir, "symlink")).select("source", F.explode("lines").alias("line"))


@query("plan_shell_script", "SELECT row_number() OVER (ORDER BY file_len DESC, key DESC, len(c), c) AS place, line FROM (" + _sql(_PLACE, columns="file_len, array_to_string(list_reverse(regexp_extract_all(file_hash[1:32], '..')), '') AS key, p.c AS c, " + _SHELL["remove"] + "[1] AS line") + " WHERE NOT keep)")
def _(spark, sf_dir):
    from .grouping import numbered

    return numbered(dedupe.script(_plan(spark, sf_dir, "remove")), "place").select("place", "line")


@query("dedupe_result", "SELECT count(*) AS processed_count, CAST(sum(reclaimed) AS BIGINT) AS reclaimed_space FROM (" + _plan_sql("remove", "NULL") + ")")
def _(spark, sf_dir):
    return dedupe.result(_plan(spark, sf_dir, "remove"))


@query("space_to_reclaim", "SELECT source, reclaimed FROM (" + _plan_sql("move", "NULL") + ")")
def _(spark, sf_dir):
    return _plan(spark, sf_dir, "move", target="/old").select("source", "reclaimed")


_REPORT = (
    f"{_GROUPED} FROM m GROUP BY ALL), q AS (SELECT file_len, file_hash, list(path ORDER BY len(c), c) AS files FROM m GROUP BY ALL), z AS (SELECT *, CAST(CASE WHEN file_len <= 1000000 THEN 100 ELSE 100000 END AS BIGINT) AS tenth FROM q),"
    " y AS (SELECT *, file_len // tenth + CASE WHEN 2 * (file_len % tenth) > tenth OR (2 * (file_len % tenth) = tenth AND (file_len // tenth) % 2 = 1) THEN 1 ELSE 0 END AS tenths FROM z),"
    " x AS (SELECT *, CASE WHEN file_len <= 1000 THEN file_len || ' B' ELSE (tenths // 10) || '.' || (tenths % 10) || CASE WHEN tenth = 100 THEN ' KB' ELSE ' MB' END END AS size FROM y)"
)


def _nested(spark, sf_dir):
    return grouping.nested(_inputs(spark, sf_dir)[0])


def _lines(form, spark, sf_dir):
    return reports.FORMATS[form](_nested(spark, sf_dir)).select("file_hash", F.posexplode("lines").alias("p", "line")).select("file_hash", F.col("p").cast("bigint").alias("no"), "line")


def _report_sql(lines: str) -> str:
    return f"{_REPORT}, l AS (SELECT file_hash, {lines} AS lines FROM x) SELECT file_hash, CAST(k AS BIGINT) AS no, lines[k + 1] AS line FROM (SELECT file_hash, lines, unnest(range(len(lines))) AS k FROM l)"


@query("report_text", _report_sql("list_concat([file_hash || ', ' || file_len || ' B (' || size || ') * ' || len(files) || ':'], list_transform(files, lambda f: '    ' || f))"))
def _(spark, sf_dir):
    return _lines("default", spark, sf_dir)


@query("report_fdupes", _report_sql("list_concat(files, [''])"))
def _(spark, sf_dir):
    return _lines("fdupes", spark, sf_dir)


@query("report_csv", _report_sql("[file_len || ',' || file_hash || ',' || len(files) || ',' || array_to_string(files, ',')]"))
def _(spark, sf_dir):
    return _lines("csv", spark, sf_dir)


@query("report_json", _report_sql("""['{"file_len":' || file_len || ',"file_hash":"' || file_hash || '","files":["' || array_to_string(files, '","') || '"]}']"""))
def _(spark, sf_dir):
    return _lines("json", spark, sf_dir)


_BACK_SQL = f"{_GROUPED} FROM m GROUP BY ALL) SELECT file_len, file_hash, path FROM m"


@query("report_read_text", _BACK_SQL)
def _(spark, sf_dir):
    """A text report, written by Spark and read back."""
    path = stage_path(spark, "report")
    reports.ordered_lines(_nested(spark, sf_dir), "default").write.text(path)
    return reports.read_text(spark, path)


@query("report_read_json", _BACK_SQL)
def _(spark, sf_dir):
    """A JSON report's groups, written by Spark, a group on a line, and read back."""
    path = stage_path(spark, "report")
    reports.ordered_lines(_nested(spark, sf_dir), "json").write.text(path)
    return spark.read.schema(reports.GROUPS).json(path).select("file_len", "file_hash", F.explode("files").alias("path"))


@query("metadata_enrich", f"{_GROUPED} FROM m GROUP BY ALL), b AS (SELECT DISTINCT file_len, file_hash FROM m WHERE inode % 17 = 0) SELECT path, file_hash, modified FROM m ANTI JOIN b USING (file_len, file_hash)")
def _(spark, sf_dir):
    """Groups of which a file's metadata can't be found are left out."""
    members, meta = _inputs(spark, sf_dir)
    return dedupe.enriched(members, meta.filter("inode % 17 <> 0")).select("path", "file_hash", F.unix_seconds("modified").alias("modified"))


@query("report_header", "SELECT '# Report by twinsieve 0.1.0' AS line UNION ALL SELECT '# Command: twinsieve group ''two words'''")
def _(spark, sf_dir):
    """The fixed lines of a report's header, through writing and reading."""
    header = reports.Header("0.1.0", datetime(2024, 1, 1, tzinfo=UTC), ["twinsieve", "group", "two words"])
    again = reports.read_header(header.lines())
    return spark.createDataFrame([(line,) for line in again.lines() if line.startswith(("# Report", "# Command"))], "line string")


