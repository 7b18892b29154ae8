"""Transformations of contents by Python functions or external programs, as functions of a binary column.

A program gets the content on its standard input, or in a file that the word $IN stands for; its result is what it
writes to its standard output, to a file that $OUT stands for, or, in place, to the file of $IN.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "struct<len:bigint, content:binary, error:string>"


class TransformError(ValueError):
    """A program that can't be run as asked."""


class Program:
    """A command line; words are divided at blanks, without quoting."""

    def __init__(self, command: str, in_place: bool = False, timeout: float | None = None):
        self.words, self.in_place, self.timeout = command.split(), in_place, timeout
        names = set(re.findall(r"\$(\w+)", command))
        if not self.words:
            raise TransformError("the command is empty")
        if in_place and "OUT" in names:
            raise TransformError("$OUT makes no sense for a program that works in place")
        if in_place and "IN" not in names:
            raise TransformError("a program that works in place needs $IN")
        self.reads_file, self.writes_file = "IN" in names, "OUT" in names

    def check(self) -> None:
        """Fail at once if there is no such program here."""
        if shutil.which(self.words[0]) is None:
            raise TransformError(f"there is no program {self.words[0]}")

    def __call__(self, content: bytes) -> bytes:
        with tempfile.TemporaryDirectory() as folder:  # a task's own, gone at its end
            names = {"IN": os.path.join(folder, "in"), "OUT": os.path.join(folder, "out")}
            if self.reads_file:
                with open(names["IN"], "wb") as f:
                    f.write(content)
            words = [re.sub(r"\$(\w+)", lambda m: names.get(m[1], m[0]), w) for w in self.words]
            done = subprocess.run(words, input=None if self.reads_file else content, stdin=subprocess.DEVNULL if self.reads_file else None, capture_output=True, timeout=self.timeout, check=False)
            if done.returncode:
                raise TransformError(f"{self.words[0]} ended with {done.returncode}: {done.stderr.decode(errors='replace').strip()}")
            if self.in_place or self.writes_file:
                with open(names["IN" if self.in_place else "OUT"], "rb") as f:
                    return f.read()
            return done.stdout


def apply(of: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    """A function of a binary column that gives struct<len, content, error>; of a failed row content is null."""

    @F.arrow_udf(RESULT)
    def run(contents: pa.Array) -> pa.Array:
        rows = []
        for content in contents.to_pylist():
            try:
                out = None if content is None else of(content)
                rows.append({"len": None if out is None else len(out), "content": out, "error": None})
            except Exception as e:  # noqa: BLE001 - whatever a user's function raises costs its row alone
                rows.append({"len": None, "content": None, "error": str(e) or type(e).__name__})
        return pa.array(rows, pa.struct([("len", pa.int64()), ("content", pa.binary()), ("error", pa.string())]))

    return run


def transformed(of: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    """A function of a binary column that gives what `of` makes of it, or null."""
    run = apply(of)
    return lambda content: run(content)["content"]
