"""A Spark data source that lists a file tree: spark.read.format("twinsieve_files").

A planning step lists the roots down to enough folders; each of those is a partition that an executor walks on its own.
For trees that all executors reach by the same path, such as a shared mount. spark.read.format("binaryFile") is the way
into object stores; it lists neither names that begin with a full stop or an underscore, nor inodes.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, device bigint, inode bigint, len bigint, is_file boolean, is_link boolean, created timestamp, modified timestamp, accessed timestamp, ctime_sec bigint, ctime_nsec bigint, content binary"
#: Folders of which one reader task walks everything below.
TASKS = 64


@dataclass
class _Below(InputPartition):
    """Folders to walk wholly, and single files; level: how deep a folder lies below its root."""

    folders: list[tuple[str, str, int]]
    files: list[str]


class _Rules:
    """Ignore files of the folders from a root down: one level that ignores is enough."""

    def __init__(self, levels: list[tuple[str, list[str]]]):
        self.levels = levels

    def below(self, folder: str) -> _Rules:
        for name in (".gitignore", ".fdignore"):
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    return _Rules([*self.levels, (folder, f.read().splitlines())])
            except OSError:
                continue
        return self

    def ignore(self, path: str, is_folder: bool) -> bool:
        import re

        from twinsieve.functions.patterns import ignore_rule

        for folder, lines in self.levels:
            decided = False
            for line in lines:
                if (rule := ignore_rule(line)) is not None:
                    regex, only_folder, back = rule
                    if (is_folder or not only_folder) and re.fullmatch(regex, os.path.relpath(path, folder), re.DOTALL):
                        decided = not back
            if decided:
                return True
        return False


class _Walk:
    def __init__(self, options: dict[str, str]):
        flag = lambda name: options.get(name, "false").lower() == "true"
        self.roots = [self._absolute(r) for r in json.loads(options["roots"])]
        self.depth = int(options["depth"]) if "depth" in options else None
        self.hidden, self.follow, self.links = flag("hidden"), flag("follow_links"), flag("report_links")
        self.no_ignore, self.one_fs, self.content = flag("no_ignore"), flag("one_fs"), flag("content")
        self.seen: set[str] = set()

    @staticmethod
    def _absolute(path: str) -> str:
        """Absolute, with links in its folders resolved, but not the path itself if it is one."""
        path = os.path.abspath(path)
        return os.path.join(os.path.realpath(os.path.dirname(path)), os.path.basename(path)) if os.path.islink(path) else os.path.realpath(path)

    def entries(self, folder: str, root: str, level: int, rules: _Rules, device: int | None) -> Iterator[tuple[str, bool]]:
        """(path, whether it is a folder to go into) of what is to be visited in a folder."""
        try:
            found = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for entry in found:
            if entry.name.startswith(".") and not self.hidden:
                continue
            try:
                is_link = entry.is_symlink()
                if is_link:
                    target = os.path.realpath(entry.path)
                    is_folder = os.path.isdir(target)
                    if not is_folder and os.path.isfile(target) and self.links:
                        path = entry.path
                    elif self.follow and os.path.exists(target):
                        path = target
                    else:
                        continue
                else:
                    path, is_folder = entry.path, entry.is_dir()
                if not self.no_ignore and rules.ignore(path, is_folder):
                    continue
                if is_folder and (self.depth is not None and level + 1 >= self.depth or self.one_fs and device is not None and os.stat(path).st_dev != device):
                    continue
            except OSError:
                continue
            yield path, is_folder

    def start(self, folder: str, root: str) -> _Rules:
        """The rules that hold in a folder, from its root down."""
        rules, at = _Rules([]), root
        if self.no_ignore:
            return rules
        for part in ["", *[p for p in os.path.relpath(folder, root).split(os.sep) if p != "."]] if folder.startswith(root) else [""]:
            at = os.path.join(at, part) if part else at
            rules = rules.below(at)
        return rules if folder.startswith(root) else _Rules([]).below(folder)

    def run(self, part: _Below) -> Iterator[str]:
        yield from part.files
        stack = [(f, r, level, self.start(os.path.dirname(f) if f != r else f, r)) for f, r, level in part.folders]
        while stack:
            folder, root, level, rules = stack.pop()
            real = os.path.realpath(folder)
            if real in self.seen:
                continue
            self.seen.add(real)
            rules = rules if self.no_ignore else rules.below(folder) if folder != root else rules
            device = os.stat(root).st_dev if self.one_fs else None
            for path, is_folder in self.entries(folder, root, level, rules, device):
                if is_folder:
                    stack.append((path, root, level + 1, rules))
                else:
                    yield path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        walk = _Walk(self.options)
        folders = [(r, r, 0) for r in walk.roots if os.path.isdir(r)]
        files = [r for r in walk.roots if os.path.isfile(r)]
        turned = 0
        while folders and len(folders) < TASKS and turned < 4:
            turned, deeper = turned + 1, []
            for folder, root, level in folders:
                rules = walk.start(folder, root)
                device = os.stat(root).st_dev if walk.one_fs else None
                for path, is_folder in walk.entries(folder, root, level, rules, device):
                    if is_folder:
                        deeper.append((path, root, level + 1))
                    else:
                        files.append(path)
            folders = list({os.path.realpath(f[0]): f for f in deeper}.values())
        parts: list[InputPartition] = [_Below([f], []) for f in folders]
        return parts + [_Below([], files[k : k + 10_000]) for k in range(0, len(files), 10_000)] or [_Below([], [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from datetime import UTC, datetime

        walk = _Walk(self.options)
        for path in walk.run(partition):
            try:
                info, link = os.stat(path), os.path.islink(path)
                content = None
                if walk.content:
                    with open(path, "rb") as f:
                        content = f.read()
            except OSError:
                continue  # it has gone, or can't be read
            time = lambda s: datetime.fromtimestamp(s, UTC)
            born = getattr(info, "st_birthtime", info.st_ctime)
            yield (path, info.st_dev & (2**63 - 1), info.st_ino & (2**63 - 1), info.st_size, stat.S_ISREG(info.st_mode), link, time(born), time(info.st_mtime), time(info.st_atime), info.st_ctime_ns // 10**9, info.st_ctime_ns % 10**9, content)


class FileTree(DataSource):
    """options: roots (JSON list), depth, hidden, follow_links, report_links, no_ignore, one_fs, content."""

    @classmethod
    def name(cls) -> str:
        return "twinsieve_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, roots: list[str], content: bool = True, **options: object) -> DataFrame:
    """Files below the roots, each path once, with their metadata; their content, unless it isn't wanted."""
    for root in roots:
        if not os.path.lexists(root):
            raise FileNotFoundError(root)
    spark.dataSource.register(FileTree)
    reader = spark.read.format("twinsieve_files").option("roots", json.dumps(roots)).option("content", str(content).lower())
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load().dropDuplicates(["path"])


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of any store that Spark reads, as path, device, inode (a hash of the path), len, modified, content.

    Spark lists neither empty files nor names that begin with a full stop or an underscore.
    """
    from pyspark.sql import functions as F

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "")
    return found.select(plain.alias("path"), F.lit(0).cast("bigint").alias("device"), F.xxhash64("path").alias("inode"), F.col("length").alias("len"), F.col("modificationTime").alias("modified"), "content")


def path_list(spark: SparkSession, lines: DataFrame, base_dir: str) -> DataFrame:
    """path: the lines (column value) of a list, without blank ones, relative ones below base_dir; each once."""
    from pyspark.sql import functions as F

    from ..functions import paths

    line = F.regexp_replace("value", r"\r$", "")
    return lines.select(line.alias("value")).filter("value <> ''").select(paths.join(F.lit(base_dir), F.regexp_replace("value", r"^(\./)+", "")).alias("path")).distinct()
