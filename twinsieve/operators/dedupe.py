"""The second query: from groups and their files' metadata to what to keep, what to drop, and a plan of actions.

Nothing here numbers a whole group: what stays is found by a rank of at most rf_over, which Spark limits before the
shuffle, and what goes is the rest, by an anti join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.patterns import Pattern, any_of
from ..options import OPERATIONS, DedupeOptions, OptionError
from ..session import materialise
from .grouping import KEYS, subgroup_key

#: priority -> (aggregate of a replica's files, whether the least comes first); what comes first is kept
_RANKED = {
    "newest": ("created", True),
    "oldest": ("created", False),
    "most-recently-modified": ("modified", True),
    "least-recently-modified": ("modified", False),
    "most-recently-accessed": ("accessed", True),
    "least-recently-accessed": ("accessed", False),
    "most-recent-status-change": ("changed", True),
    "least-recent-status-change": ("changed", False),
    "most-nested": ("max_nesting", True),
    "least-nested": ("min_nesting", False),
}


def enriched(members: DataFrame, metadata: DataFrame) -> DataFrame:
    """members (file_len, file_hash, path) with the columns of metadata, without groups of which a file is missing."""
    found = members.select(*KEYS, "path").join(metadata.withColumn("_found", F.lit(True)), "path", "left")
    broken = found.filter("_found IS NULL").select(*KEYS).distinct()
    return found.join(broken, KEYS, "left_anti").drop("_found")


def modified_groups(files: DataFrame, keys: Sequence[str], before: object) -> DataFrame:
    """Keys of groups with a file that was modified after `before`, or whose time is unknown."""
    return files.filter(F.col("modified").isNull() | (F.col("modified") > F.lit(before))).select(*keys).distinct()


def _matches(names: Sequence[str], path_globs: Sequence[str], ignore_case: bool) -> Column:
    name = paths.file_name(F.col("path"))
    found = [Pattern.glob(t, ignore_case).matches(name) for t in names] + [Pattern.glob(t, ignore_case).matches(F.col("path")) for t in path_globs]
    return any_of(found)


def must_keep(opts: DedupeOptions) -> Column:
    """The file's name or path matches one of the patterns to keep."""
    return _matches(opts.keep_names, opts.keep_paths, opts.ignore_case)


def may_drop(opts: DedupeOptions) -> Column:
    """There are no patterns of what to drop, or the file's name or path matches one of them."""
    return _matches(opts.names, opts.paths, opts.ignore_case) if opts.names or opts.paths else F.lit(True)


def file_order() -> Column:
    c = paths.components(F.col("path"))
    return F.struct(F.size(c).alias("depth"), c.alias("components"))


def subgroups(files: DataFrame, keys: Sequence[str], opts: DedupeOptions) -> DataFrame:
    """keys, subgroup, and of each: place, times, nesting, forced, and how many files it has.

    created is the least, the other times are the greatest of its files; null if one of them is unknown.
    """
    root = F.coalesce(paths.first_root(list(opts.isolated), F.col("path")), F.lit(1 << 30))
    nesting = F.size(paths.components(F.col("path")))

    def whole(best: Column, of: Column) -> Column:
        return F.when(F.count(of) == F.count("*"), best)

    changed = F.struct("ctime_sec", "ctime_nsec")
    return files.groupBy(*keys, subgroup_key(opts.isolated, not opts.match_links).alias("subgroup")).agg(
        F.min(F.struct(root.alias("root"), file_order().alias("file"))).alias("place"),
        whole(F.min("created"), F.col("created")).alias("created"),
        whole(F.max("modified"), F.col("modified")).alias("modified"),
        whole(F.max("accessed"), F.col("accessed")).alias("accessed"),
        whole(F.max(changed), F.col("ctime_sec")).alias("changed"),
        F.min(nesting).alias("min_nesting"),
        F.max(nesting).alias("max_nesting"),
        (F.bool_or(must_keep(opts)) | ~F.bool_and(may_drop(opts))).alias("forced"),
        F.count("*").alias("n_files"),
    )


def sort_keys(priorities: Sequence[str]) -> list[tuple[str, bool]]:
    """(column, ascending): the first priority counts most, ties go by place; `top` turns round all that follows it."""
    order = [("place", True)]
    for p in reversed(priorities):
        if p == "top":
            order = [(c, not up) for c, up in order]
        elif p != "bottom":
            order.insert(0, _RANKED[p])
    return order


def ordering(priorities: Sequence[str]) -> list[Column]:
    return [F.asc(c) if up else F.desc(c) for c, up in sort_keys(priorities)]


def rejected(groups: DataFrame, keys: Sequence[str], priorities: Sequence[str]) -> DataFrame:
    """Keys of groups where what a priority needs is unknown of some replica."""
    needed = {c for c, _ in sort_keys(priorities) if c != "place"}
    unknown = any_of([F.col(c).isNull() for c in sorted(needed)])
    return groups.filter(unknown).select(*keys).distinct()


def kept(groups: DataFrame, keys: Sequence[str], opts: DedupeOptions) -> DataFrame:
    """subgroups() that stay, with their rank: forced ones, and so many of the others, best first, as make up rf_over."""
    order = W.partitionBy(*keys).orderBy(*ordering(opts.priority))
    best = groups.filter("NOT forced").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= opts.rf_over)
    forced = groups.filter("forced").groupBy(*keys).agg(F.count("*").alias("_forced"))
    more = best.join(forced, list(keys), "left").filter(F.col("_rank") <= F.lit(opts.rf_over) - F.coalesce("_forced", F.lit(0))).drop("_forced")
    return groups.filter("forced").withColumn("_rank", F.lit(0)).unionByName(more)


def candidates(members: DataFrame, metadata: DataFrame, opts: DedupeOptions, operation: str = "remove") -> tuple[DataFrame, list[str]]:
    """Files that take part, with metadata, and the keys of their groups; links other than symbolic stay on one device.

    They are stored: ranks, targets and plans all read them.
    """
    keys = [*KEYS, "device"] if operation in ("hardlink", "reflink") else list(KEYS)
    files = enriched(members, metadata).filter("is_file")
    if not opts.no_check_size:
        files = files.filter("len = file_len")
    if opts.modified_before is not None:
        files = files.join(modified_groups(files, keys, opts.modified_before), keys, "left_anti")
    return materialise(files, "candidates"), keys


def partition(files: DataFrame, keys: Sequence[str], opts: DedupeOptions) -> DataFrame:
    """files with `keep`: whether each stays. Groups of which too little is known are left out."""
    groups = subgroups(files, keys, opts)
    if {c for c, _ in sort_keys(opts.priority)} - {"place"}:
        bad = rejected(groups, keys, opts.priority)
        groups, files = groups.join(bad, list(keys), "left_anti"), files.join(bad, list(keys), "left_anti")
    stay = kept(groups, keys, opts).select(*keys, "subgroup", F.lit(True).alias("keep"))
    named = files.withColumn("subgroup", subgroup_key(opts.isolated, not opts.match_links))
    return named.join(stay, [*keys, "subgroup"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def retained(files: DataFrame, keys: Sequence[str], opts: DedupeOptions) -> DataFrame:
    """keys, target: the file of each group that links point to, the first of those that stay, forced ones before."""
    groups = subgroups(files, keys, opts)
    order = W.partitionBy(*keys).orderBy(F.desc("forced"), *ordering(opts.priority))
    first = groups.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select(*keys, F.col("place.file.components").alias("_c"))
    return first.select(*keys, F.when(F.size("_c") == 1, F.lit("/")).otherwise(F.array_join("_c", "/")).alias("target"))


def plan(members: DataFrame, metadata: DataFrame, operation: str, opts: DedupeOptions | None = None, mounts: DataFrame | None = None) -> DataFrame:
    """keys, op, source, target, use_rename, reclaimed: an action for each file that goes. Nothing is carried out.

    The target of a link is the file that stays; that of a move is below opts.target, and use_rename tells that source
    and target are below the same mount (mounts: path, device), as all are if no mounts are given.
    """
    opts = opts or DedupeOptions()
    if operation not in OPERATIONS:
        raise OptionError(f"unknown operation {operation!r}; there are {', '.join(OPERATIONS)}")
    files, keys = candidates(members, metadata, opts, operation)
    gone = partition(files, keys, opts).filter("NOT keep")
    source, length = F.col("path").alias("source"), F.col("file_len").alias("reclaimed")
    if operation == "remove":
        rows = gone.select(*keys, F.lit("remove").alias("op"), source, F.lit(None).cast("string").alias("target"), F.lit(False).alias("use_rename"), length)
    elif operation == "move":
        if not opts.target:
            raise OptionError("a target folder is needed")
        target = paths.move_target(F.lit(opts.target), F.col("path"))
        rows = gone.select(*keys, F.lit("move").alias("op"), source, target.alias("target"), F.lit(True).alias("use_rename"), length)
        if mounts is not None:
            at = mounts.select("path", "device").collect()  # a row for each mount of a machine

            def device(path: Column) -> Column:
                found = F.lit(None).cast("bigint")
                for r in sorted(at, key=lambda r: len(r.path)):
                    found = F.when(paths.is_prefix_of(F.lit(r.path), path), F.lit(r.device)).otherwise(found)
                return found

            rows = rows.withColumn("use_rename", device(F.col("source")).eqNullSafe(device(F.col("target"))))
    else:
        rows = gone.join(retained(files, keys, opts), keys).select(*keys, F.lit(operation).alias("op"), source, "target", F.lit(False).alias("use_rename"), length)
    return rows.select(*KEYS, "op", "source", "target", "use_rename", "reclaimed")


def result(plan_rows: DataFrame) -> DataFrame:
    """One row: how many files a plan acts on and how many bytes that frees."""
    return plan_rows.agg(F.count("*").alias("processed_count"), F.coalesce(F.sum("reclaimed"), F.lit(0)).cast("bigint").alias("reclaimed_space"))


def commands(plan_rows: DataFrame) -> DataFrame:
    """Plan rows with `lines`, an array of the shell commands that carry the action out."""
    source, target, aside = (paths.quote(c) for c in (F.col("source"), F.col("target"), paths.aside(F.col("source"))))

    def replaced(command: str) -> Column:
        return F.array(F.concat(F.lit("mv "), source, F.lit(" "), aside), F.concat(F.lit(command), target, F.lit(" "), source), F.concat(F.lit("rm "), aside))

    copied = F.array(F.concat(F.lit("cp "), source, F.lit(" "), target), F.concat(F.lit("rm "), source))
    lines = (
        F.when(F.col("op") == "remove", F.array(F.concat(F.lit("rm "), source)))
        .when(F.col("op") == "symlink", replaced("ln -s "))
        .when(F.col("op") == "hardlink", replaced("ln "))
        .when(F.col("op") == "reflink", replaced("cp --reflink=always "))
        .when(F.col("use_rename"), F.array(F.concat(F.lit("mv "), source, F.lit(" "), target)))
        .otherwise(copied)
    )
    return plan_rows.withColumn("lines", lines)


def script(plan_rows: DataFrame) -> DataFrame:
    """line: the commands of a plan, groups in the order of a report, files of a group by path. A sort by ranges."""
    from .grouping import group_order

    ordered = commands(plan_rows).orderBy(*group_order(), *paths.order_key(F.col("source")))
    return ordered.select(F.explode("lines").alias("line"))
