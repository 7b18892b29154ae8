"""Command line: python -m twinsieve group ROOT... ; remove, link, dedupe and move read a report."""

from __future__ import annotations

import argparse
import os
import sys

from .functions.digests import Algorithm
from .functions.sizes import size_text
from .operators import dedupe, execute, reports
from .options import FORMATS, PRIORITIES, DedupeOptions, GroupOptions, OptionError
from .plans import api
from .session import local_session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="twinsieve", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    g = commands.add_parser("group", help="find groups of equal files and write a report")
    g.add_argument("roots", nargs="+")
    g.add_argument("-o", "--output", default="/dev/stdout")
    g.add_argument("-f", "--format", choices=FORMATS, default="default")
    g.add_argument("--transform")
    g.add_argument("--in-place", action="store_true")
    g.add_argument("--hash-fn", choices=[a.value for a in Algorithm], default=Algorithm.SHA256.value)
    for flag in ("isolate", "match-links", "unique", "hidden", "follow-links", "symbolic-links", "one-fs", "no-ignore", "ignore-case", "regex", "skip-content-hash"):
        g.add_argument(f"--{flag}", action="store_true")
    for number in ("rf-over", "rf-under", "depth"):
        g.add_argument(f"--{number}", type=int)
    for size, default in (("min-size", "1"), ("max-size", None)):
        g.add_argument(f"--{size}", default=default)
    for many in ("names", "paths", "exclude"):
        g.add_argument(f"--{many}", action="append", default=[])
    for name, words in (("remove", "delete"), ("link", "replace by links"), ("dedupe", "share blocks of"), ("move", "move away")):
        c = commands.add_parser(name, help=f"{words} what a report calls redundant; prints a script unless --execute is given")
        if name == "move":
            c.add_argument("target")
        if name == "link":
            c.add_argument("-s", "--soft", action="store_true")
        c.add_argument("report")
        c.add_argument("--execute", action="store_true")
        c.add_argument("-n", "--rf-over", type=int)
        c.add_argument("--priority", action="append", choices=PRIORITIES, default=[])
        for many in ("names", "paths", "keep-names", "keep-paths", "isolated"):
            c.add_argument(f"--{many}", action="append", default=[])
        c.add_argument("--modified-before")
        for flag in ("match-links", "no-check-size", "ignore-case"):
            c.add_argument(f"--{flag}", action="store_true")
    return out


def inherited(path: str, given: dict) -> dict:
    """Options that the report's own command implies, where they aren't given anew."""
    words = list(reports.read_head(path).command)
    if words[1:2] != ["group"]:
        return {}
    before = vars(parser().parse_args(words[1:]))
    out: dict = {}
    if given["rf_over"] is None:
        out["rf_over"] = max(1, before["rf_over"] or 1)
    if before["isolate"] and not given["isolated"]:
        out["isolated"] = [os.path.abspath(r) for r in before["roots"]]
    return out | {"match_links": given["match_links"] or before["match_links"], "no_check_size": given["no_check_size"] or before["transform"] is not None}


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    given = vars(parser().parse_args(argv))
    command = given.pop("command")
    spark = local_session()
    try:
        if command == "group":
            output, program, in_place = given.pop("output"), given.pop("transform"), given.pop("in_place")
            opts = GroupOptions(**given, transform=api.program(program, in_place) if program else None)
            api.report(spark, opts, output, ["twinsieve", *argv])
            return 0
        carry, path, soft = given.pop("execute"), given.pop("report"), given.pop("soft", False)
        operation = {"link": "symlink" if soft else "hardlink", "dedupe": "reflink"}.get(command, command)
        plan = api.plan_report(spark, path, operation, DedupeOptions(**{"rf_over": 1} | {k: v for k, v in given.items() if v is not None} | inherited(path, given)))
        if not carry:
            for row in dedupe.script(plan).toLocalIterator():
                print(row.line)
            total = dedupe.result(plan).first()
        else:
            done = execute.execute(plan)
            for row in done.filter("error IS NOT NULL").toLocalIterator():
                print(f"{row.source}: {row.error}", file=sys.stderr)
            total = dedupe.result(done.filter("error IS NULL"))
            total = total.first()
        print(f"{'Processed' if carry else 'Would process'} {total.processed_count} files and reclaim {size_text(total.reclaimed_space)} space", file=sys.stderr)
        return 0
    except (OptionError, FileNotFoundError, ValueError) as e:
        print(f"twinsieve: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
