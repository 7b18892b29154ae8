import json
import os
from datetime import UTC, datetime, timedelta

import pytest

from twinsieve.__main__ import main
from twinsieve.operators import dedupe, execute, reports
from twinsieve.options import DedupeOptions, GroupOptions
from twinsieve.plans import api
from twinsieve.sources import walker


def made(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def listed(spark, root, **options):
    return {os.path.relpath(r.path, os.path.realpath(root)) for r in walker.scan(spark, [str(root)], content=False, **options).collect()}


def test_walk(spark, tmp_path):
    root = tmp_path / "r"
    made(root, {"a": b"1", "d/b": b"2", "d/e/c": b"3", ".h": b"4", ".k/x": b"5", "_u": b"6"})
    made(tmp_path, {"out/z": b"7"})
    (root / "link").symlink_to("d/b")
    (root / "far").symlink_to(tmp_path / "out")
    (root / "d/cycle").symlink_to(root)
    plain = {"a", "d/b", "d/e/c", "_u"}
    assert listed(spark, root) == plain
    assert listed(spark, root, hidden=True) == plain | {".h", ".k/x"}
    assert listed(spark, root, depth=1) == {"a", "_u"} and listed(spark, root, depth=2) == {"a", "_u", "d/b"}
    assert listed(spark, root, follow_links=True) == plain | {"../out/z"}
    assert listed(spark, root, report_links=True) == plain | {"link"}
    assert listed(spark, root, one_fs=True) == plain
    rows = walker.scan(spark, [str(root), str(root / "a"), str(root / "d")]).collect()
    assert len(rows) == 4 and {bytes(r.content) for r in rows} == {b"1", b"2", b"3", b"6"} and all(r.len == 1 and r.is_file and r.inode for r in rows)
    with pytest.raises(FileNotFoundError):
        walker.scan(spark, [str(root / "none")])


def test_ignore_files(spark, tmp_path):
    made(tmp_path, {".gitignore": b"*.log\nfoo/\n", ".fdignore": b"*\n", "a.log": b"", "b": b"", "foo/x": b"", "d/foo": b"", "d/.fdignore": b"**/bar\n", "d/e/bar": b"", "d/c.log": b"", "d/e/ok": b""})
    assert listed(spark, tmp_path) == {"b", "d/foo", "d/e/ok"}
    assert len(listed(spark, tmp_path, no_ignore=True)) == 7


def test_binary_files_and_lists(spark, tmp_path):
    made(tmp_path, {"a/x": b"12", "y": b""})
    got = walker.binary_files(spark, str(tmp_path)).collect()
    assert {(os.path.basename(r.path), r.len, bytes(r.content)) for r in got} == {("x", 2, b"12")}
    lines = spark.createDataFrame([("a/b",), ("/c",), ("",), ("./d\r",), ("a/b",)], "value string")
    assert {r.path for r in walker.path_list(spark, lines, "/base").collect()} == {"/base/a/b", "/c", "/base/d"}


FILES = {"a": b"same", "d/b": b"same", "d/c d": b"same", "e": b"other1", "f": b"other2", "g": b"same length"}


def run(root, *words):
    return main([*words])


@pytest.mark.parametrize("form", ["default", "json"])
def test_group_then_plan(spark, tmp_path, form):
    root = tmp_path / "r"
    made(root, FILES)
    os.link(root / "a", root / "hard")
    header = api.report(spark, GroupOptions(roots=[str(root)], format=form), str(tmp_path / "report"))
    assert header.stats["group_count"] == 1 and header.stats["total_file_count"] == 4
    back, members = reports.read(spark, str(tmp_path / "report"))
    assert back.stats == header.stats and abs(back.timestamp - header.timestamp) < timedelta(milliseconds=2)
    assert {os.path.relpath(r.path, root) for r in members.collect()} == {"a", "d/b", "d/c d", "hard"}
    plan = api.plan_report(spark, str(tmp_path / "report"), "hardlink", DedupeOptions(modified_before=datetime.now(UTC) + timedelta(days=1)))
    done = execute.execute(plan).collect()
    assert {os.path.relpath(r.source, root) for r in done} == {"d/b", "d/c d"} and all(r.error is None for r in done)
    assert os.path.samefile(root / "a", root / "d/c d") and sorted(os.listdir(root / "d")) == ["b", "c d"]
    os.utime(root / "a", (4e9, 4e9))
    assert api.plan_report(spark, str(tmp_path / "report"), "remove", DedupeOptions()).count() == 0


def test_transformed_tree(spark, tmp_path):
    made(tmp_path, {"a": b"aa1", "b": b"aa23456", "c": b"bb"})
    found = api.group_tree(spark, GroupOptions(roots=[str(tmp_path)], transform=api.program("head -c 2"))).collect()
    assert {os.path.basename(r.path) for r in found} == {"a", "b"} and {r.file_len for r in found} == {2}


def test_actions(tmp_path):
    made(tmp_path, {"keep": b"x", "1": b"x", "2": b"x", "3": b"x"})
    p = lambda name: str(tmp_path / name)
    execute.carry_out("remove", p("1"), None, False, p("1.t"))
    execute.carry_out("remove", p("1"), None, False, p("1.t"))
    execute.carry_out("symlink", p("2"), p("keep"), False, p("2.t"))
    execute.carry_out("symlink", p("2"), p("keep"), False, p("2.t"))
    for rename in (True, False):
        execute.carry_out("move", p("3"), p("to/3"), rename, p("3.t"))
        execute.carry_out("move", p("3"), p("to/3"), rename, p("3.t"))
        os.rename(p("to/3"), p("3"))
    assert sorted(os.listdir(tmp_path)) == ["2", "3", "keep", "to"] and os.readlink(p("2")) == p("keep")
    made(tmp_path, {"to/3": b"y"})
    with pytest.raises(FileExistsError):
        execute.carry_out("move", p("3"), p("to/3"), True, p("3.t"))
    with pytest.raises(OSError):
        execute.carry_out("hardlink", p("3"), p("none"), False, p("3.t"))
    assert (tmp_path / "3").read_bytes() == b"x"


NAMES = ["/a", "/tab\there", "/cr\r", "/nl\nx", "/del\x7f", "/🙂 ü", "/ lead and trail ", '/qu"ote,s', "/back\\slash"]


@pytest.mark.parametrize("form", ["default", "json"])
def test_reports_round_trip(spark, tmp_path, form):
    groups = spark.createDataFrame([(100, "ab12", NAMES), (40, "cd34", ["/x"])], reports.GROUPS)
    header = reports.Header(command=["twinsieve", "group", "two words"], base_dir="/b", stats=dict.fromkeys(reports.STATS, 7))
    reports.write(groups, str(tmp_path / "r"), form, header)
    back, members = reports.read(spark, str(tmp_path / "r"))
    assert {(r.file_len, r.file_hash, r.path) for r in members.collect()} == {(100, "ab12", n) for n in NAMES} | {(40, "cd34", "/x")}
    assert (list(back.command), back.base_dir, back.stats) == (header.command, "/b", header.stats)


def test_other_forms_and_broken_reports(spark, tmp_path):
    groups = spark.createDataFrame([(100, "ab12", ["/a", '/q"u,o']), (40, "cd34", ["/x"])], reports.GROUPS)
    for form, want in (("csv", 'size,hash,count,files\n100,ab12,2,/a,"/q""u,o"\n40,cd34,1,/x\n'), ("fdupes", '/a\n/q"u,o\n\n/x\n\n')):
        reports.write(groups, str(tmp_path / form), form, reports.Header())
        assert (tmp_path / form).read_text() == want
        with pytest.raises(reports.ReportError):
            reports.read(spark, str(tmp_path / form))
    head = "".join(x + "\n" for x in reports.Header().lines())
    good = "ab12, 3 B (3 B) * 1:\n    /a\n"
    for tail in ("broken line\n    /b\ncd, 3 B (3 B) * 1:\n    /c\n", "\ncd, 3 B (3 B) * 1:\n    /c\n", "cd, 3 B (3 B) * 2:\n    /c\n"):
        (tmp_path / "t").write_text(head + good + tail)
        assert [r.path for r in reports.read(spark, str(tmp_path / "t"))[1].collect()] == ["/a"]
    (tmp_path / "crlf").write_bytes((head + good).replace("\n", "\r\n").encode())
    assert [r.path for r in reports.read(spark, str(tmp_path / "crlf"))[1].collect()] == ["/a"]
    (tmp_path / "bad").write_text("# Report by x 1\n# Time\n")
    with pytest.raises(reports.ReportError):
        reports.read(spark, str(tmp_path / "bad"))


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "r"
    made(root, FILES)
    assert main(["group", str(root), "-f", "json", "-o", str(tmp_path / "out.json")]) == 0
    assert [len(g["files"]) for g in json.loads((tmp_path / "out.json").read_text())["groups"]] == [3]
    later = (datetime.now(UTC) + timedelta(days=1)).isoformat()
    assert main(["remove", str(tmp_path / "out.json"), "--modified-before", later]) == 0
    said = capsys.readouterr()
    assert said.out.splitlines() == [f"rm {root}/d/b", f"rm '{root}/d/c d'"] and "Would process 2 files" in said.err
    assert main(["remove", str(tmp_path / "out.json"), "--modified-before", later, "--execute"]) == 0 and os.listdir(root / "d") == []
    assert main(["group", str(root / "none")]) == 1 and main(["group", str(root), "--unique", "--rf-over", "2"]) == 1


def test_script_order(spark):
    assert dedupe.sort_keys(["top", "newest"]) == [("created", False), ("place", False)] and dedupe.sort_keys(["newest", "top"]) == [("created", True), ("place", False)]


def test_a_report_implies_options(spark, tmp_path, capsys):
    made(tmp_path, {"r1/a": b"q", "r1/b": b"q", "r2/c": b"q", "r3/d": b"q"})
    roots = [str(tmp_path / f"r{k}") for k in (1, 2, 3)]
    assert main(["group", *roots, "--isolate", "--rf-over", "2", "-o", str(tmp_path / "out")]) == 0
    later = (datetime.now(UTC) + timedelta(days=1)).isoformat()
    assert main(["remove", str(tmp_path / "out"), "--modified-before", later]) == 0
    assert capsys.readouterr().out.splitlines() == [f"rm {tmp_path}/r3/d"]
    assert main(["move", str(tmp_path / "away"), str(tmp_path / "out"), "--modified-before", later, "--rf-over", "1", "--execute"]) == 0
    assert sorted(os.listdir(tmp_path / "r1")) == ["a", "b"] and (tmp_path / f"away{tmp_path}/r2/c").read_bytes() == b"q"
