import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from twinsieve.llm import packing as P
from twinsieve.llm import sorted_table as S
from twinsieve.llm import word_bpe as B
from twinsieve.session import stage_path

PATH = public_tokenizers.path(B.VOCABULARY)
TK = B.load(PATH)
TEXTS = [None, "", "The cat's Hat.", "x" * 30_000 + "!y" * 9000, "a b " * 9000, "The cat's Hat.", "naïve 漢字 🙂 <|endoftext|> İΑΣ é", "\x1c a\xa0b ́c"]


ENCODER = B.WordEncoder(PATH)


def plain(text, end):
    return [*TK.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab é1 \n\t'süS.-\x1c\xa0\x0b\x85漢éİΣ|<>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_encode_as_the_whole(text):
    encoder = ENCODER
    encoder.most = 5
    assert [x.tolist() for x in encoder.encode([text, None, text], 2)] == [plain(text, 2), [2], plain(text, 2)]


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(max_codepoint=0xFF), max_size=30))
def test_latin_words_encode_as_the_whole(text):
    assert [x.tolist() for x in ENCODER.encode([text], 2)] == [plain(text, 2)]


def test_parts_of_long_latin_texts_encode_as_the_whole(monkeypatch):
    text = "Thé cat's 12th hat, \t\n and MORE!! " * 40 + "x" * 300
    monkeypatch.setattr(B, "parts", lambda t, f=B.parts: f(t, 50))
    assert [x.tolist() for x in ENCODER.encode([text], 2)] == [plain(text, 2)]


def test_shards_hold_and_find_all(spark):
    rows = [((i * 7919) % 400, TEXTS[i % len(TEXTS)] if i % 50 == 0 else f"word{i} and more", "clash") for i in range(400)] + [(None, "no id", "x"), (5, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    manifest = S.write(df, stage_path(spark, "sst"), PATH, 2, shard_bytes=3000)
    assert manifest.count() > 3
    got = [tuple(r) for r in S.read(manifest).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array(plain(r[1], 2), "<u2").tobytes()))
    want, at = [], 0
    for i, t, _ in order:
        ids = np.array(plain(t, 2), "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    found = S.lookup(manifest, [None, 5, 77, 10_000, -3])
    texts = {i: t for i, t, _ in rows}
    assert [x.tolist() for x in found[77]] == [plain(texts[77], 2)] and found[10_000] == [] and found[-3] == []
    assert len(found[5]) == 2 and [x.tolist() for x in found[None]] == [plain("no id", 2)]
    assert S.read(S.write(df.limit(0), stage_path(spark, "sst"), PATH, 2)).count() == 0


def test_fill_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = Counter(rng.integers(1, 60, rng.integers(1, 9)).tolist())
        fill = P.best_fill(counts, 100)
        longest, sums = max(counts), {0}
        for k in (rest := Counter(counts) - Counter([max(counts)])):
            sums = {a + b * k for a in sums for b in range(rest[k] + 1)}
        cost = lambda s: 0 if s == 100 or s & (s - 1) == 0 else 100 - s
        total = sum(k * n for k, n in fill.items())
        assert all(n <= counts[k] for k, n in fill.items()) and fill[longest] and total <= 100
        assert cost(total) == min(cost(longest + s) for s in sums if longest + s <= 100)


def test_every_id_lies_in_one_piece(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 9 == 0 else "one two three " * (i * 37 % 900), 1) for i in range(300)] + [(None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    pieces = P.pack(df, PATH).collect()
    docs, windows = defaultdict(list), defaultdict(list)
    for r in pieces:
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for i, t, _ in rows:
        ids = np.array(plain(t, 1), "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(windows) == list(range(len(windows)))
    padding = 0
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= P.WINDOW
        padding += 0 if at & (at - 1) == 0 else P.WINDOW - at
    assert padding <= P.WINDOW
    assert P.pack(df.limit(0), PATH).count() == 0


def test_ids_of_other_types_and_wide_ids(spark):
    texts = [(k, f"word{k} and more") for k in range(60)]
    base = spark.createDataFrame(texts, "k int, text string")
    for kind in ("CAST(k AS SMALLINT)", "date_add(date'1969-12-20', k)", "timestamp_seconds(k - 30)", "concat('k', lpad(k, 3, '0'))"):
        df = base.selectExpr(f"{kind} AS doc_id", "text")
        manifest = S.write(df, stage_path(spark, "sst"), PATH, 70_000, shard_bytes=400)
        got = sorted(S.read(manifest).collect(), key=lambda r: r.start)
        assert manifest.count() > 2 and [r.doc_id for r in got] == [r.doc_id for r in df.orderBy("doc_id").collect()]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(plain(t, 70_000), "<u4").tobytes()) for _, t in texts]
