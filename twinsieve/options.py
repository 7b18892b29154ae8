"""Options of the two queries: grouping, and what to do with the groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from .functions.digests import Algorithm
from .functions.patterns import Selector
from .functions.sizes import parse_datetime, parse_size

#: Prefixes and suffixes that are compared before whole contents, and the length from which suffixes are.
PREFIX, SUFFIX, SUFFIX_FROM = 4096, 4096, 65536
FORMATS = ("default", "fdupes", "csv", "json")
PRIORITIES = ("top", "bottom", "newest", "oldest", "most-recently-modified", "least-recently-modified", "most-recently-accessed", "least-recently-accessed", "most-recent-status-change", "least-recent-status-change", "most-nested", "least-nested")
OPERATIONS = ("remove", "symlink", "hardlink", "reflink", "move")


class OptionError(ValueError):
    """Options that don't go together, or a value that can't be read."""


@dataclass
class GroupOptions:
    """The first query: which files to take, what makes them equal, which groups to report."""

    roots: Sequence[str] = ()
    isolate: bool = False
    match_links: bool = False
    rf_over: int | None = None
    rf_under: int | None = None
    unique: bool = False
    min_size: int | str = 1
    max_size: int | str | None = None
    names: Sequence[str] = ()
    paths: Sequence[str] = ()
    exclude: Sequence[str] = ()
    ignore_case: bool = False
    regex: bool = False
    hidden: bool = False
    depth: int | None = None
    follow_links: bool = False
    symbolic_links: bool = False
    one_fs: bool = False
    no_ignore: bool = False
    hash_fn: Algorithm | str = Algorithm.SHA256
    skip_content_hash: bool = False
    prefix: int | str = PREFIX
    suffix: int | str = SUFFIX
    suffix_from: int | str = SUFFIX_FROM
    transform: object | None = None
    base_dir: str = "/"
    format: str = "default"

    def __post_init__(self) -> None:
        try:
            self.min_size = parse_size(self.min_size)
            self.max_size = None if self.max_size is None else parse_size(self.max_size)
            self.prefix, self.suffix, self.suffix_from = (parse_size(x) for x in (self.prefix, self.suffix, self.suffix_from))
            self.hash_fn = Algorithm.parse(self.hash_fn)
        except ValueError as e:
            raise OptionError(str(e)) from e
        if self.format not in FORMATS:
            raise OptionError(f"unknown format {self.format!r}; there are {', '.join(FORMATS)}")
        if sum(x is not None and x is not False for x in (self.rf_over, self.rf_under, self.unique)) > 1:
            raise OptionError("only one of rf_over, rf_under and unique can be given")
        if self.isolate and self.follow_links:
            raise OptionError("isolate and follow_links exclude each other")
        if self.isolate and len(self.roots) <= self.over:
            raise OptionError(f"with isolate there must be more roots than the replication factor, which is {self.over}")
        if self.depth is not None and self.depth < 0:
            raise OptionError("depth can't be negative")

    @property
    def over(self) -> int:
        """Groups with more replicas are reported, where over-replicated ones are asked for; 0 in the other modes."""
        return 0 if self.unique or self.rf_under is not None else 1 if self.rf_over is None else self.rf_over

    @property
    def under(self) -> int | None:
        """Groups with fewer replicas are reported, where those are asked for."""
        return 2 if self.unique else self.rf_under

    @property
    def prunable(self) -> bool:
        """Whether a group that is out at an early stage stays out: replicas only become fewer as groups divide."""
        return self.under is None

    @property
    def isolated(self) -> list[str]:
        return list(self.roots) if self.isolate else []

    def selector(self) -> Selector:
        return Selector(self.base_dir, self.names, self.paths, self.exclude, self.ignore_case, self.regex)

    @property
    def search(self) -> str:
        return "unique" if self.unique else "missing" if self.rf_under is not None else "redundant"


@dataclass
class DedupeOptions:
    """The second query: what to keep of each group."""

    rf_over: int = 1
    priority: Sequence[str] = ()
    keep_names: Sequence[str] = ()
    keep_paths: Sequence[str] = ()
    names: Sequence[str] = ()
    paths: Sequence[str] = ()
    isolated: Sequence[str] = ()
    match_links: bool = False
    no_check_size: bool = False
    modified_before: datetime | str | None = None
    ignore_case: bool = False
    target: str | None = None

    def __post_init__(self) -> None:
        if self.rf_over < 1:
            raise OptionError("at least one replica must stay")
        if unknown := [p for p in self.priority if p not in PRIORITIES]:
            raise OptionError(f"unknown priority {unknown[0]!r}; there are {', '.join(PRIORITIES)}")
        if isinstance(self.modified_before, str):
            try:
                self.modified_before = parse_datetime(self.modified_before)
            except ValueError as e:
                raise OptionError(str(e)) from e

    @classmethod
    def after(cls, group: GroupOptions, timestamp: datetime | None, **changes: object) -> DedupeOptions:
        """Options that the report of a grouping implies, and changes to them."""
        inherited: dict[str, object] = {"rf_over": max(1, group.over), "isolated": group.isolated, "match_links": group.match_links, "no_check_size": group.transform is not None, "modified_before": timestamp}
        return cls(**inherited | changes)
