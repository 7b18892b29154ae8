"""Carrying out a plan, only when asked to: each action is done by the task that holds its row.

For file trees that all executors reach by the same paths. An action that a task has done and another does again, after
a lost executor, finds its work done and counts it as such.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import paths
from ..session import materialise


def _replaced(source: str, aside: str, put: object) -> None:
    """Put something in the place of source, which is moved aside meanwhile and comes back if that fails."""
    os.rename(source, aside)
    try:
        put()
    except OSError:
        os.rename(aside, source)
        raise
    os.unlink(aside)


def carry_out(op: str, source: str, target: str | None, use_rename: bool, aside: str) -> None:
    """One action on the file system; raises OSError."""
    if op == "remove":
        if os.path.lexists(source):
            os.unlink(source)
    elif op == "move":
        if not os.path.lexists(source) and os.path.exists(target):
            return
        if os.path.lexists(target):
            raise FileExistsError(f"{target} exists")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if use_rename:
            os.rename(source, target)
        else:
            shutil.copy2(source, target)
            os.unlink(source)
    elif op == "symlink":
        if not (os.path.islink(source) and os.readlink(source) == target):
            _replaced(source, aside, lambda: os.symlink(target, source))
    elif op == "hardlink":
        if not os.path.samefile(source, target):
            _replaced(source, aside, lambda: os.link(target, source))
    else:
        raise OSError(f"{op} is planned only: copying blocks on write needs a file system's own tool")


def execute(plan_rows: DataFrame) -> DataFrame:
    """op, source, target, reclaimed, error: what became of each action (error null: done), stored once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for op, source, target, use_rename, aside, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    carry_out(op, source, target, use_rename, aside)
                    rows.append((op, source, target, size, None))
                except OSError as e:
                    rows.append((op, source, target, 0, str(e)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["op", "source", "target", "reclaimed", "error"])

    ready = plan_rows.withColumn("aside", paths.aside(plan_rows["source"])).select("op", "source", "target", "use_rename", "aside", "reclaimed")
    return materialise(ready.mapInArrow(run, "op string, source string, target string, reclaimed bigint, error string"), "executed")
