"""The two queries over file trees: group, and what to do with a report."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators import dedupe as dedupe_
from ..operators import grouping, reports, transform
from ..options import DedupeOptions, GroupOptions, OptionError
from ..sources import walker


def scan_tree(spark: SparkSession, opts: GroupOptions, content: bool = True) -> DataFrame:
    """Files below the options' roots."""
    if not opts.roots:
        raise OptionError("no roots are given")
    return walker.scan(spark, list(opts.roots), content, depth=opts.depth, hidden=opts.hidden, follow_links=opts.follow_links, report_links=opts.symbolic_links, no_ignore=opts.no_ignore, one_fs=opts.one_fs)


def group_tree(spark: SparkSession, opts: GroupOptions) -> DataFrame:
    """Members of the groups to report. Of the files that a stage leaves, the next one reads what it needs."""
    from dataclasses import replace

    listed = scan_tree(spark, opts, content=False).drop("content")
    flat = replace(opts, hidden=True, depth=None)  # the walk has seen to these
    chosen = grouping.selected(grouping.unique_paths(listed), flat)
    if opts.transform is not None:
        return grouping.transformed(read_content(chosen), opts)
    return grouping.cascade(chosen, opts, lambda files, column: with_digest(files, column, opts))


def with_digest(files: DataFrame, column: str, opts: GroupOptions) -> DataFrame:
    """files with prefix_hash, suffix_hash or file_hash, read by the tasks that hold them, 64 KiB at a time.

    A file that can't be read is dropped. A short file's prefix is all of it, and its suffix isn't read. Of the links of
    an inode one is read.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from ..functions.digests import Stream

    prefix, suffix, suffix_from, algorithm = opts.prefix, opts.suffix, opts.suffix_from, opts.hash_fn

    def read(path: str, size: int) -> str | None:
        if column == "suffix_hash" and size < suffix_from:
            return ""
        stream = Stream(algorithm)
        left = prefix if column == "prefix_hash" else suffix if column == "suffix_hash" else size
        try:
            with open(path, "rb") as f:
                if column == "suffix_hash":
                    f.seek(max(0, size - suffix))
                while left > 0 and (data := f.read(min(left, 1 << 16))):
                    stream.update(data)
                    left -= len(data)
        except OSError:
            return None
        return stream.hexdigest()

    def run(batches):
        for batch in batches:
            found = [read(p, n) for p, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["device", "inode", column])
            yield made.filter(pa.array([x is not None for x in found], pa.bool_()))

    once = files.groupBy("device", "inode").agg(F.min("path").alias("path"), F.min("len").alias("len"))
    return files.join(once.mapInArrow(run, f"device bigint, inode bigint, {column} string"), ["device", "inode"])


def read_content(files: DataFrame) -> DataFrame:
    """files with their content, read by the tasks that hold them; a file that can't be read is dropped."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out = []
                for path in part.column(part.schema.names.index("path")).to_pylist():
                    try:
                        with open(path, "rb") as f:
                            out.append(f.read())
                    except OSError:
                        out.append(None)
                got = part.append_column("content", pa.array(out, pa.binary()))
                yield got.filter(pa.array([x is not None for x in out]))

    from pyspark.sql.types import BinaryType, StructType

    schema = StructType([*files.schema.fields]).add("content", BinaryType())
    return files.mapInArrow(run, schema)


def report(spark: SparkSession, opts: GroupOptions, path: str, command: list[str] | None = None) -> reports.Header:
    """Group and write a report; returns its header."""
    from ..session import materialise

    members = materialise(group_tree(spark, opts), "members")
    stats = grouping.statistics(grouping.summary(members, opts)).first().asDict()
    header = reports.Header(timestamp=datetime.now(UTC), command=command or ["twinsieve", "group", *opts.roots], base_dir=opts.base_dir, stats=stats)
    reports.write(grouping.nested(members, opts.isolated), path, opts.format, header)
    return header


def plan_report(spark: SparkSession, path: str, operation: str, opts: DedupeOptions) -> DataFrame:
    """The plan for a report's files, whose metadata is read anew."""
    header, members = reports.read(spark, path)
    if opts.modified_before is None:
        opts.modified_before = header.timestamp
    return dedupe_.plan(members, stat_files(members), operation, opts)


def stat_files(members: DataFrame) -> DataFrame:
    """Metadata of the members' paths, read by the tasks that hold them; none of a path that can't be read."""
    import pyarrow as pa

    schema = "path string, device bigint, inode bigint, len bigint, is_file boolean, created timestamp, modified timestamp, accessed timestamp, ctime_sec bigint, ctime_nsec bigint"

    def run(batches):
        import os
        import stat

        stamp = pa.timestamp("us", "UTC")
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), stamp, stamp, stamp, pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    i = os.stat(path)
                except OSError:
                    continue
                born = getattr(i, "st_birthtime", i.st_ctime)
                rows.append((path, i.st_dev, i.st_ino, i.st_size, stat.S_ISREG(i.st_mode), int(born * 1e6), i.st_mtime_ns // 1000, i.st_atime_ns // 1000, i.st_ctime_ns // 10**9, i.st_ctime_ns % 10**9))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return members.select("path").distinct().mapInArrow(run, schema)


def program(command: str, in_place: bool = False):
    """The transformation of contents by an external program, checked to be there."""
    found = transform.Program(command, in_place)
    found.check()
    return transform.transformed(found)
