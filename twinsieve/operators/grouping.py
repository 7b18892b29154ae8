"""Grouping by content: replicas, stages, groups and their statistics.

Rows stay flat, one for each file; a group's array of files is made by a sink alone. A group is known by its keys
(file_len, file_hash); what is told of it is aggregated, partly before the shuffle, and joined back to its members.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import digests, paths
from ..options import GroupOptions
from ..session import materialise, small_batches

KEYS = ["file_len", "file_hash"]
#: Rows of a task of counted(), and its tasks at most: two shuffles have a block for each pair of them.
TASK_ROWS, MOST_TASKS = 1 << 19, 2048


def unique_paths(files: DataFrame) -> DataFrame:
    """Each path once, however often it was listed."""
    return files.dropDuplicates(["path"])


def subgroup_key(roots: Sequence[str] = (), by_id: bool = True) -> Column:
    """What counts as one replica: the first isolated root that a path is below, else its inode, else the path."""
    rest = F.concat(F.lit("i"), F.col("device").cast("string"), F.lit(":"), F.col("inode").cast("string")) if by_id else F.concat(F.lit("p"), F.col("path"))
    root = paths.first_root(list(roots), F.col("path"))
    return F.when(root.isNotNull(), F.concat(F.lit("r"), root.cast("string"))).otherwise(rest) if roots else rest


def replicas(files: DataFrame, keys: Sequence[str], subgroup: Column) -> DataFrame:
    """keys, n_files, replicas."""
    return files.withColumn("_s", subgroup).groupBy(*keys).agg(F.count("*").alias("n_files"), F.countDistinct("_s").alias("replicas"))


def having(opts: GroupOptions) -> Column:
    """The condition on replicas of a group to report."""
    return F.col("replicas") < opts.under if opts.under is not None else F.col("replicas") > opts.over


def pruned(files: DataFrame, keys: Sequence[str], opts: GroupOptions, strict: bool = False) -> DataFrame:
    """Rows whose group by keys can still be reported; all rows at an early stage where that can't be told yet."""
    if not strict and not opts.prunable:
        return files
    if len(keys) and opts.prunable and opts.over == 1 and not opts.isolate and opts.match_links:
        alive = files.groupBy(*keys).agg(F.count("*").alias("replicas"))
    else:
        alive = replicas(files, keys, subgroup_key(opts.isolated, not opts.match_links))
    return files.join(alive.filter(having(opts)).select(*keys), list(keys), "left_semi")


def selected(files: DataFrame, opts: GroupOptions) -> DataFrame:
    """Files by size, name, path, hiddenness and depth below their root; one of unknown length unless a size is asked for."""
    out = files.filter(F.col("len") >= opts.min_size) if opts.min_size > 0 else files
    if opts.max_size is not None:
        out = out.filter(F.col("len") <= opts.max_size)
    out = out.filter(opts.selector().condition(F.col("path"), paths.file_name(F.col("path"))))
    below = F.col("path")
    for root in opts.roots:
        below = F.when(paths.is_prefix_of(F.lit(root), F.col("path")), paths.strip_prefix(F.lit(root), F.col("path"))).otherwise(below)
    if not opts.hidden:
        out = out.filter(~paths.hidden(below))
    if opts.depth is not None:
        out = out.filter(paths.depth(paths.strip_root(below)) <= opts.depth)
    return out


def by_size(files: DataFrame, opts: GroupOptions) -> DataFrame:
    """Files whose length others have, too (as far as the mode lets groups be dropped)."""
    return pruned(files, ["len"], opts)


def with_prefix(files: DataFrame, opts: GroupOptions) -> DataFrame:
    return files.withColumn("prefix_hash", digests.digest(digests.chunk(F.col("content"), 0, opts.prefix), opts.hash_fn))


def with_suffix(files: DataFrame, opts: GroupOptions) -> DataFrame:
    """suffix_hash of files from suffix_from bytes on; of others it is empty."""
    long = F.when(F.col("len") >= opts.suffix_from, digests.tail(F.col("content"), opts.suffix))
    return files.withColumn("suffix_hash", F.coalesce(digests.digest(long, opts.hash_fn), F.lit("")))


def with_content(files: DataFrame, opts: GroupOptions) -> DataFrame:
    """file_hash of the whole content."""
    if digests.runs_in_python(opts.hash_fn):
        small_batches(files.sparkSession)
    return files.withColumn("file_hash", digests.digest(F.col("content"), opts.hash_fn))


def fan_out(files: DataFrame, opts: GroupOptions) -> DataFrame:
    """file_hash of every file, the same for all links of an inode."""
    hashed = with_content(files, opts).drop("content")
    once = hashed.groupBy("device", "inode").agg(F.min("file_hash").alias("file_hash"))
    return hashed.drop("file_hash").join(once, ["device", "inode"])


#: The keys that a stage of the cascade adds.
STAGES = (("prefix_hash",), ("prefix_hash", "suffix_hash"), ("file_hash",))


def cascade(files: DataFrame, opts: GroupOptions, read: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Members of reported groups by refinement: size, prefix, suffix, content, each on what the last one left.

    read(files, column) adds prefix_hash, suffix_hash or file_hash to the files that are left, so that contents are read
    for those alone. Without it, files have a content column: then all digests are made at the scan, as it is cheaper to
    hash a content there than to carry it through a shuffle.
    """
    if read is None:
        files = with_suffix(with_prefix(files, opts), opts)
        files = materialise(unique_paths((files if opts.skip_content_hash else with_content(files, opts)).drop("content")), "digests")
    out = by_size(files, opts)
    for keys in STAGES[:2] if opts.skip_content_hash else STAGES:
        out = pruned(read(out, keys[-1]) if read else out, ["len", *keys], opts)
    if opts.skip_content_hash:
        out = out.withColumn("file_hash", F.concat_ws("", "prefix_hash", "suffix_hash"))
    out = out.withColumnRenamed("len", "file_len").drop("prefix_hash", "suffix_hash")
    return pruned(out, KEYS, opts, strict=True)


def direct(files: DataFrame, opts: GroupOptions) -> DataFrame:
    """Members of reported groups by one digest: for columnar sources, where content comes with the scan.

    Contents leave the plan at the scan; the shuffles carry digests. The digests of all files, some hundred bytes each,
    are stored, since members, groups and all that follows from them read them anew, and contents are read once.
    """
    return pruned(stored_digests(files, opts), KEYS, opts, strict=True)


def stored_digests(files: DataFrame, opts: GroupOptions) -> DataFrame:
    """Files with file_len and file_hash in place of content, each path once, stored."""
    out = with_content(files, opts).withColumnRenamed("len", "file_len").drop("content")
    return materialise(unique_paths(out), "digests")


def counted(rows: DataFrame, keys: Sequence[str], distinct: str) -> DataFrame:
    """keys, n (rows) and ids (distinct values of a column that aren't null) of each group of rows that are cheap to read.

    A task has about TASK_ROWS rows, however many there are: by key and value first, so that no hot key meets in one
    task, then by key. Nothing is aggregated before the first shuffle, where few rows would have a partner.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, -(-rows.count() // TASK_ROWS)))
    each = rows.select(*keys, distinct).repartition(tasks, *keys, distinct).groupBy(*keys, distinct).agg(F.count("*").alias("_n"))
    return each.repartition(tasks, *keys).groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(distinct).alias("ids"))


def transformed(files: DataFrame, opts: GroupOptions) -> DataFrame:
    """Members of groups whose content is equal once it went through opts.transform, a function of a binary column.

    A row whose transformation fails (null) is dropped. file_len is the length of what comes out.
    """
    out = files.withColumn("content", opts.transform(F.col("content"))).filter(F.col("content").isNotNull())
    out = out.withColumn("file_len", F.octet_length("content").cast("bigint")).withColumn("file_hash", digests.digest(F.col("content"), opts.hash_fn))
    return pruned(materialise(unique_paths(out.drop("content", "len")), "digests"), KEYS, opts, strict=True)


def summary(members: DataFrame, opts: GroupOptions) -> DataFrame:
    """file_len, file_hash, n_files, replicas, redundant, missing of each group.

    Without isolated roots all files beyond the factor are redundant; with them, those of the replicas after it, roots
    first, in their order.
    """
    key = subgroup_key(opts.isolated, not opts.match_links)
    limit = max(opts.over, 1)
    if not opts.isolated:
        out = replicas(members, KEYS, key).withColumn("redundant", F.greatest(F.col("n_files") - limit, F.lit(0)).cast("bigint"))
    else:
        root = F.coalesce(paths.first_root(opts.isolated, F.col("path")), F.lit(1 << 30))
        place = F.min(F.struct(root.alias("root"), F.size(paths.components(F.col("path"))).alias("depth"), paths.components(F.col("path")).alias("components")))
        each = members.groupBy(*KEYS, key.alias("_s")).agg(F.count("*").alias("_n"), place.alias("_place"))
        order = W.partitionBy(*KEYS).orderBy("_place")
        stay = each.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).groupBy(*KEYS).agg(F.sum("_n").alias("_stay"))
        out = each.groupBy(*KEYS).agg(F.sum("_n").alias("n_files"), F.count("*").alias("replicas")).join(stay, KEYS)
        out = out.withColumn("redundant", F.col("n_files") - F.col("_stay")).drop("_stay")
    under = opts.under
    out = out.withColumn("missing", F.lit(0).cast("bigint") if under is None else F.greatest(F.lit(under) - F.col("replicas"), F.lit(0)).cast("bigint"))
    return out.withColumn("redundant", F.col("redundant") if under is None else F.lit(0).cast("bigint"))


def group_summary(files: DataFrame, opts: GroupOptions) -> DataFrame:
    """summary() of the groups to report, for columnar sources: groups are judged by their row, without their members.

    Nothing is joined by the keys, so that contents that are null are a group, as for GROUP BY.
    """
    if opts.transform is not None or opts.skip_content_hash:
        return summary(group(files, opts), opts)
    return summary(stored_digests(selected(files, opts), opts), opts).filter(having(opts))


def statistics(groups: DataFrame) -> DataFrame:
    """One row of totals over summary()."""
    return groups.agg(
        F.count("*").alias("group_count"),
        F.coalesce(F.sum("n_files"), F.lit(0)).cast("bigint").alias("total_file_count"),
        F.coalesce(F.sum(F.col("n_files") * F.col("file_len")), F.lit(0)).cast("bigint").alias("total_file_size"),
        F.coalesce(F.sum("redundant"), F.lit(0)).cast("bigint").alias("redundant_file_count"),
        F.coalesce(F.sum(F.col("redundant") * F.col("file_len")), F.lit(0)).cast("bigint").alias("redundant_file_size"),
        F.coalesce(F.sum("missing"), F.lit(0)).cast("bigint").alias("missing_file_count"),
        F.coalesce(F.sum(F.col("missing") * F.col("file_len")), F.lit(0)).cast("bigint").alias("missing_file_size"),
    )


def group_order() -> list[Column]:
    """Longest first; of a length, by the number in the first 16 bytes of the digest, largest first."""
    return [F.desc("file_len"), F.desc(digests.first_number_key(F.col("file_hash")))]


def nested(members: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """file_len, file_hash, files: the report's form, with the files of a group in the order of their paths.

    With roots, files of a root stay together, roots in their order. An array holds a whole group: for sinks.
    """
    root = F.coalesce(paths.first_root(list(roots), F.col("path")), F.lit(1 << 30))
    key = F.struct(root.alias("r"), F.size(paths.components(F.col("path"))).alias("d"), paths.components(F.col("path")).alias("c"), F.col("path").alias("path"))
    grouped = members.groupBy(*KEYS).agg(F.array_sort(F.collect_list(key)).alias("_f"))
    return grouped.select(*KEYS, F.transform("_f", lambda x: x["path"]).alias("files"))


def group(files: DataFrame, opts: GroupOptions | None = None) -> DataFrame:
    """The first query: members (all columns of files, file_len, file_hash) of the groups to report.

    files: path, device, inode, len, content.
    """
    opts = opts or GroupOptions()
    out = selected(files, opts)
    if opts.transform is not None:
        return transformed(out, opts)
    return cascade(out, opts) if opts.skip_content_hash else direct(out, opts)

