"""Globs and regular expressions over paths, as columns: patterns become Java regular expressions for rlike."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    """A pattern that can't be compiled."""


#: Extended groups: what follows the closing bracket in the regular expression.
_GROUPS = {"?": "?", "*": "*", "+": "+", "@": ""}


def _closing(glob: str, start: int, separator: str, close: str) -> tuple[list[str], int] | None:
    """Regular expressions of the alternatives that begin at start, and the place behind the closing sign, if there is one."""
    parts, at = [], start
    while True:
        regex, at = _compile(glob, at, separator + close)
        if at >= len(glob):
            return None
        parts.append(regex)
        at += 1
        if glob[at - 1] == close:
            return parts, at


def _character_set(glob: str, start: int) -> tuple[str, int] | None:
    end = glob.find("]", start + 1)
    if end < 0:
        return None
    inner = glob[start:end]
    negated = inner.startswith("!")
    body = re.sub(r"([\[\\^&])", r"\\\1", inner[1:] if negated else inner)
    return (f"[{'^' if negated else ''}{body}]", end + 1) if body else None


def _compile(glob: str, at: int, stops: str) -> tuple[str, int]:
    """The regular expression of glob from `at` up to a stop sign that isn't escaped, and where that is."""
    out = []
    while at < len(glob) and glob[at] not in stops:
        c, following = glob[at], glob[at + 1 : at + 2]
        if c == "\\" and following:
            out.append(re.escape(following))
            at += 2
        elif c in "?*+@!" and following == "(" and (found := _closing(glob, at + 2, "|", ")")):
            body = "|".join(found[0])
            out.append(f"(?!(?:{body})$)[^/]*" if c == "!" else f"(?:{body}){_GROUPS[c]}")
            at = found[1]
        elif c == "{" and (found := _closing(glob, at + 1, ",", "}")):
            out.append(f"(?:{'|'.join(found[0])})")
            at = found[1]
        elif c == "[" and (chars := _character_set(glob, at + 1)):
            out.append(chars[0])
            at = chars[1]
        elif c == "*":
            stars = 2 if following == "*" else 1
            out.append(".*" if stars == 2 else "[^/]*")
            at += stars
        elif c == "?":
            out.append("[^/]")
            at += 1
        else:
            out.append(re.escape(c))
            at += 1
    return "".join(out), at


def glob_regex(glob: str) -> str:
    """The regular expression, without anchors, that an extended glob stands for.

    `?` and `*` stay within a directory, `**` doesn't; `[a-z]`, `[!a-z]`, `{a,b}`, `?(a|b)`, `*(a|b)`, `+(a|b)`,
    `@(a|b)` and `!(a|b)` work as in a shell; a backslash makes the next sign literal; an unbalanced bracket is one.
    """
    return _compile(glob, 0, "")[0]


def literal_prefix(glob: str) -> str:
    """What every match of the glob begins with: its signs before the first special one, escaped ones as themselves."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if c == "\\" and at + 1 < len(glob):
            out.append(glob[at + 1])
            at += 2
            continue
        if c in "?*[{" or (c in "+@!" and glob[at + 1 : at + 2] == "("):
            break
        out.append(c)
        at += 1
    return "".join(out)


@dataclass(frozen=True)
class Pattern:
    """A compiled pattern; `regex` has no anchors."""

    regex: str
    ignore_case: bool = False
    prefix: str = ""

    @staticmethod
    def glob(text: str, ignore_case: bool = False) -> Pattern:
        return Pattern(glob_regex(text), ignore_case, "" if ignore_case else literal_prefix(text))

    @staticmethod
    def regular(text: str, ignore_case: bool = False) -> Pattern:
        """A regular expression that must match the whole input; anchors at its ends are not needed."""
        body = text.removeprefix("^")
        if body.endswith("$") and not body.endswith("\\$"):
            body = body[:-1]
        try:
            re.compile(body)
        except re.error as e:
            raise PatternError(f"{text}: {e}") from e
        return Pattern(f"(?:{body})", ignore_case)

    @staticmethod
    def literal(text: str) -> Pattern:
        return Pattern(re.escape(text), False, text)

    def __add__(self, other: Pattern) -> Pattern:
        whole = not glob_regex(self.prefix) != self.regex
        return Pattern(self.regex + other.regex, self.ignore_case or other.ignore_case, self.prefix + other.prefix if whole else self.prefix)

    @property
    def java(self) -> str:
        return f"{'(?i)' if self.ignore_case else ''}^(?s:{self.regex})$"

    def matches(self, column: Column) -> Column:
        """The whole value matches."""
        return column.rlike(self.java)

    def matches_text(self, text: str) -> bool:
        return re.fullmatch(self.regex, text, re.DOTALL | (re.IGNORECASE if self.ignore_case else 0)) is not None

    def may_be_below(self, directory: Column) -> Column:
        """Something in the directory, or deeper, may match, judged by the literal prefix."""
        within = F.concat(F.when(directory == "/", F.lit("")).otherwise(directory), F.lit("/"))
        return within.startswith(self.prefix) | F.lit(self.prefix).startswith(within)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


@dataclass
class Selector:
    """Which paths to take: names, paths to include, paths to exclude; relative patterns are meant below base_dir."""

    base_dir: str = "/"
    names: Sequence[str] = ()
    paths: Sequence[str] = ()
    exclude: Sequence[str] = ()
    ignore_case: bool = False
    regex: bool = False
    _made: dict[str, list[Pattern]] = field(default_factory=dict, repr=False)

    def patterns(self, kind: str) -> list[Pattern]:
        if kind not in self._made:
            make = Pattern.regular if self.regex else Pattern.glob
            found = [make(t, self.ignore_case) for t in getattr(self, kind)]
            if kind != "names":
                base = Pattern.literal(self.base_dir.rstrip("/") + "/")
                found = [p if t.startswith(("/", "**", "^/")) or (self.regex and t.startswith((".*", "^"))) else base + p for p, t in zip(found, getattr(self, kind), strict=True)]
            self._made[kind] = found
        return self._made[kind]

    def condition(self, path: Column, name: Column) -> Column:
        """The name matches one of the names, the path one of the paths, where such are given, and no exclusion."""
        take = F.lit(True)
        if self.names:
            take &= any_of([p.matches(name) for p in self.patterns("names")])
        if self.paths:
            take &= any_of([p.matches(path) for p in self.patterns("paths")])
        if self.exclude:
            take &= ~any_of([p.matches(path) for p in self.patterns("exclude")])
        return take

    def directory(self, directory: Column) -> Column:
        """Files below the directory may be selected. A directory goes only if that is out of the question."""
        take = any_of([p.may_be_below(directory) for p in self.patterns("paths")]) if self.paths else F.lit(True)
        for pattern, text in zip(self.patterns("exclude"), self.exclude, strict=True):
            if not self.regex and text.endswith("/**"):
                flag = "(?i)" if self.ignore_case else ""
                take &= ~directory.rlike(f"{flag}^(?s:{pattern.regex.removesuffix('/.*')}(?:/.*)?)$")
        return take


_TRAILING = re.compile(r"(?<!\\)\s+$")


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """A line of an ignore file: (regular expression below its folder, only folders, takes back); None for a comment.

    A rule with a slash before its end holds from the file's folder on, others at any depth.
    """
    line = _TRAILING.sub("", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    folder = line.endswith("/")
    line = line.rstrip("/") if folder else line
    anchored = "/" in line
    line = line.removeprefix("/")
    body = []
    for k, part in enumerate(parts := line.split("/")):
        last = k == len(parts) - 1
        if part == "**":
            body.append(".*" if last else "(?:.*/)?")
        else:
            body.append(glob_regex(part.replace("{", "\\{")) + ("" if last else "/"))
    return ("" if anchored else "(?:.*/)?") + "".join(body), folder, back


def ignored(rules: Sequence[tuple[str, Sequence[str]]], path: Column) -> Column:
    """One of the (folder, lines of its ignore file) rules ignores the file or one of the folders that it is in.

    Of one folder's rules the last that matches decides; rules of a deeper folder don't take back those of another.
    """
    levels = []
    for folder, lines in rules:
        base = re.escape(folder.rstrip("/") + "/")
        decided = F.lit(False)
        for line in lines:
            if (rule := ignore_rule(line)) is not None:
                regex, only_folder, back = rule
                decided = F.when(path.rlike(f"^(?s:{base}{regex}{'/.*' if only_folder else '(?:/.*)?'})$"), F.lit(not back)).otherwise(decided)
        levels.append(decided)
    return any_of(levels)
