import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinsieve.functions import digests, paths, sizes
from twinsieve.functions.blake import blake3, blake3_many
from twinsieve.functions.metro import metro128
from twinsieve.functions.patterns import Pattern, PatternError, Selector, ignored, literal_prefix
from twinsieve.operators import grouping
from twinsieve.operators.reports import join_arguments, quote_argument, split_arguments
from twinsieve.options import GroupOptions

GLOBS = [
    ("", [""], ["a"]),
    ("foo.jpg", ["foo.jpg"], ["fooxjpg"]),
    ("foo(bar)", ["foo(bar)"], ["foobar"]),
    ("foo\\*", ["foo*"], ["foox"]),
    ("foo???", ["foo123"], ["foo/23", "foo12"]),
    ("foo*", ["foo123", "foo"], ["foo/bar"]),
    ("foo/**/bar", ["foo/1/2/bar"], ["foo/bar2"]),
    ("[a-b.*?-]", ["a", ".", "*", "-"], ["c", "ab"]),
    ("[!a-b.*?-]", ["c"], ["a", "."]),
    ("[[&&x]", ["[", "&", "x"], ["y"]),
    ("{*.jpg,*.JPG}", ["foo.jpg", "foo.JPG"], ["foo.png"]),
    ("{a,{b,c}}", ["a", "b", "c"], ["d", "bc"]),
    ("a,b,c", ["a,b,c"], ["a"]),
    ("a|b", ["a|b"], ["a"]),
    ("{a,b,c", ["{a,b,c"], ["a"]),
    ("a,b}", ["a,b}"], ["a"]),
    ("{{a,b}", ["{a", "{b"], ["a"]),
    ("{{{a,b}}", ["{a", "{b"], ["a", "{{a"]),
    ("**/b", ["/b", "/a/b"], ["b"]),
    ("/a/**/c", ["/a/b1/c", "/a/b1/b2/c"], ["/a/c1"]),
    ("/a-?(foo|bar)", ["/a-", "/a-foo", "/a-bar"], ["/a-foobar"]),
    ("/a-*(foo|bar)", ["/a-", "/a-foo", "/a-foofoo", "/a-foobar"], ["/a-x"]),
    ("/a-+(foo|bar)", ["/a-foo", "/a-foofoo"], ["/a-"]),
    ("/a-@(foo|bar?(baz))", ["/a-foo", "/a-bar", "/a-barbaz"], ["/a-foobaz"]),
    ("/a/b?/*", ["/a/b1/c", "/a/b1/"], ["/a/b1", "/a/b/c"]),
    ("/a-!(foo|bar)", ["/a-baz", "/a-foo2"], ["/a-foo", "/a-bar"]),
]


def test_globs(spark):
    for glob, yes, no in GLOBS:
        p = Pattern.glob(glob)
        assert all(p.matches_text(t) for t in yes) and not any(p.matches_text(t) for t in no), glob
        rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", p.matches(F.col("t")).alias("m")).collect()
        assert [r.m for r in rows] == [True] * len(yes) + [False] * len(no), glob
    assert Pattern.glob("foo", True).matches_text("FOO") and not Pattern.glob("foo").matches_text("Foo")
    assert (Pattern.literal("/foo/") + Pattern.glob("*")).regex == Pattern.glob("/foo/*").regex
    assert literal_prefix("/a\\*/b*/c") == "/a*/b" and literal_prefix("/a-*/**") == "/a-"
    assert Pattern.regular("^a|b$").matches_text("b") and not Pattern.regular("a|b").matches_text("ab")
    with pytest.raises(PatternError):
        Pattern.regular("(")


def _chosen(spark, selector, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "p string")
    return {r.p for r in rows.filter(selector.condition(F.col("p"), paths.file_name(F.col("p")))).collect()}


def test_selectors(spark):
    assert _chosen(spark, Selector("/test"), ["/test/foo/bar", "/x"]) == {"/test/foo/bar", "/x"}
    assert _chosen(spark, Selector("/test", paths=["foo/**"]), ["/test/foo/bar", "/test/foo/bar/baz", "/bar", "/test/bar"]) == {"/test/foo/bar", "/test/foo/bar/baz"}
    assert _chosen(spark, Selector("/", paths=["/foo/**"], exclude=["/foo/b*/**"]), ["/foo/foo", "/foo/foo/foo", "/foo/bar/baz", "/test/bar"]) == {"/foo/foo", "/foo/foo/foo"}
    assert _chosen(spark, Selector("/", paths=["**/public-?.jpg"], exclude=["**/private-?.jpg"]), ["/public-1.jpg", "/foo/public-2.jpg", "/private-1.jpg", "/x.jpg"]) == {"/public-1.jpg", "/foo/public-2.jpg"}
    assert _chosen(spark, Selector("/Base", names=["*.TXT"], paths=["A/**"], ignore_case=True), ["/base/a/x.txt", "/base/b/x.txt"]) == {"/base/a/x.txt"}
    dirs = spark.createDataFrame([(d,) for d in ("/", "/test1", "/test2/bar", "/test3/foo", "/test3/foo/bar", "/other")], "d string")
    chosen = Selector("/", paths=["/test[1-9]/**"], exclude=["/test[1-9]/foo/**"])
    assert {r.d for r in dirs.filter(chosen.directory(F.col("d"))).collect()} == {"/", "/test1", "/test2/bar"}


def test_ignore_rules(spark):
    rows = spark.createDataFrame([(p,) for p in ("/r/a.log", "/r/b.txt", "/r/foo/x", "/r/d/bar", "/r/d/keep.log", "/r/foo.txt", "/r/e/only")], "p string")
    rules = [("/r", ["# comment", "*.log", "!keep.log", "foo/", "**/bar"]), ("/r/e", ["/only"])]
    assert {r.p for r in rows.filter(~ignored(rules, F.col("p"))).collect()} == {"/r/b.txt", "/r/d/keep.log", "/r/foo.txt"}


def test_paths(spark):
    P = F.col("p")
    rows = spark.createDataFrame([("/",), ("/a",), ("/a/b.c",), ("a/b",), ("..",)], "p string").select(
        "p", paths.depth(P).alias("depth"), paths.file_name(P).alias("name"), paths.parent(P).alias("parent"), paths.strip_prefix(F.lit("/a"), P).alias("below"), paths.join(F.lit("/x"), P).alias("joined"), paths.is_prefix_of(F.lit("/"), P).alias("rooted")
    )
    assert [tuple(r)[1:] for r in rows.collect()] == [
        (1, None, None, None, "/", True), (2, "a", "/", ".", "/a", True), (3, "b.c", "/a", "b.c", "/a/b.c", True), (2, "b", "a", None, "/x/a/b", False), (1, None, None, None, "/x/..", False),
    ]
    assert spark.range(1).select(paths.is_prefix_of(F.lit("/a"), F.lit("/ab"))).first()[0] is False
    order = spark.createDataFrame([(p,) for p in ("/a/z", "/z", "/a/b/c", "/B", "/a/b")], "p string").orderBy(*paths.order_key(P))
    assert [r.p for r in order.collect()] == ["/B", "/z", "/a/b", "/a/z", "/a/b/c"]


NAMES = ["plain", "two words", "it's", "tab\there", "line\nend\r", "\x01\x7f", "back\\slash", "$x;y", "ünï🙂", "a%b"]


def test_quoting(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "p string").select("p", paths.quote(F.col("p")).alias("q"), paths.escape(F.col("p")).alias("e")).collect()
    for r in rows:
        assert split_arguments(f"rm {r.q}") == ["rm", r.p] and r.q == quote_argument(r.p) and paths.unescape(r.e) == r.p
    assert {r.p: r.q for r in rows}["two words"] == "'two words'" and {r.p: r.q for r in rows}["plain"] == "plain"


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], max_codepoint=0x2FF), max_size=8), max_size=5))
def test_arguments_round_trip(words):
    assert split_arguments(join_arguments(words)) == words


def test_sizes(spark):
    assert [sizes.size_text(n) for n in (4, 1000, 1001, 16000, 12000, 10**9, 2250, 2350, 10**6 + 1)] == ["4 B", "1000 B", "1.0 KB", "16.0 KB", "12.0 KB", "1000.0 MB", "2.2 KB", "2.4 KB", "1.0 MB"]
    numbers = [0, 4, 999, 1000, 1001, 1049, 1050, 1150, 123456, 10**6, 10**9, 10**12 + 5, 2**62]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", sizes.format_size(F.col("n")).alias("t")).collect()
    assert all(r.t == sizes.size_text(r.n) for r in rows)
    assert [sizes.parse_size(t) for t in ("100", "100M", "1.5KB", "2KiB", "3 mib")] == [100, 10**8, 1500, 2048, 3 << 20]
    for bad in ("x", "-1", "4i", "1 XB"):
        with pytest.raises(ValueError):
            sizes.parse_size(bad)
    assert sizes.parse_datetime("2024-01-01 10:00:00 +0200").timestamp() == sizes.parse_datetime("2024-01-01T08:00:00Z").timestamp()


def test_digests(spark):
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert metro128(b"012345678901234567890123456789012345678901234567890123456789012").hex() == "c77ce2bfa4ed9f9b0548b2ac5074a297"
    data = [b"Test file 1", b"Test file 2", b"Test fil", b"", b"x" * 5000, None]
    df = spark.createDataFrame([(d,) for d in data], "c binary")
    for a in digests.Algorithm:
        got = [r[0] for r in df.select(digests.digest(F.col("c"), a)).collect()]
        stream = digests.Stream(a)
        for k in range(0, 5000, 999):
            stream.update(data[4][k : k + 999])
        assert stream.hexdigest() == got[4]
        assert got == [None if d is None else digests.in_python(a)(d).hex() for d in data] and len(set(got)) == 6
    assert digests.Algorithm.parse("xxhash") == digests.Algorithm.parse("XXHASH3") and digests.in_python(digests.Algorithm.SHA3_256)(b"a") == hashlib.sha3_256(b"a").digest()
    with pytest.raises(ValueError):
        digests.Algorithm.parse("crc")
    r = df.filter("length(c) > 9").select(digests.chunk(F.col("c"), 5, 3).alias("a"), digests.tail(F.col("c"), 4).alias("b"), digests.tail(F.col("c"), 9999).alias("d")).first()
    assert (bytes(r.a), bytes(r.b), bytes(r.d)) == (b"fil", b"le 1", b"Test file 1")
    x = spark.range(1).select(digests.xor(F.lit("00ff00ff12345678"), F.lit("ffff0000")).alias("x"), digests.first_number_key(F.lit("0102")).alias("k")).first()
    assert x.x == "ff0000ff00000000" and x.k == "00" * 14 + "0201"


def test_digests_hold_no_second_copy():
    """Contents go through BLAKE3 as they come, about a MB at a time."""
    taken = []
    contents = [bytes([k]) * 300_000 for k in range(40)]
    found = digests._blake3_many(taken.append(len(b)) or b for b in contents)
    first = next(found)
    assert len(taken) <= 5
    assert [first, *found] == blake3_many(contents) and len(taken) == 40
    assert list(digests._blake3_many(iter(()))) == []


def test_digests_in_small_batches(spark, monkeypatch):
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    files = spark.sql("SELECT '/' || id path, cast(repeat('x', 1000000) as binary) content FROM range(0, 20, 1, 1)")
    try:
        spark.conf.unset(size)
        grouping.with_content(files, GroupOptions(hash_fn="sha256"))
        assert spark.conf.get(size, None) is None
        rows = grouping.with_content(files, GroupOptions(hash_fn="blake3")).select("file_hash").distinct().collect()
        assert spark.conf.get(size) == "4m" and [r[0] for r in rows] == [blake3_many([b"x" * 1_000_000])[0].hex()]
        spark.conf.set(size, "1m")
        grouping.with_content(files, GroupOptions(hash_fn="blake3"))
        assert spark.conf.get(size) == "1m"
    finally:
        spark.conf.unset(size)
