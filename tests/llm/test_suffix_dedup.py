import hashlib

import numpy as np

from twinsieve.llm import suffix_dedup as S


def brute(rows):
    """doc -> (bytes, removed places) by a set of all earlier 100-byte strings."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - S.LENGTH + 1):
            s = data[p : p + S.LENGTH]
            if s in seen:
                gone[p : p + S.LENGTH] = True
            seen.add(s)
        out[i] = data, gone
    return out


def expected(data, gone):
    kept = bytes(np.frombuffer(data, "u1")[~gone])
    runs = int((np.diff(np.concatenate([[0], gone.astype("i1")])) == 1).sum())
    return len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def corpus(rng, n):
    words = [f"wörd{k}" for k in range(60)]
    passages = [" ".join(rng.choice(words, k)) for k in (12, 14, 17, 40, 200)] + ["a" * 130, "ab" * 90, "line of words that is common to all, and long enough to hold an anchor.\n"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 6)):
            parts.append(" ".join(rng.choice(words, rng.integers(0, 30))))
            if rng.random() < 0.6:
                s = passages[rng.integers(len(passages))]
                a, b = sorted(rng.integers(0, len(s), 2))
                parts.append(s if rng.random() < 0.5 else s[a:b])
        out.append("".join(parts))
    return out + out[: n // 10]


def test_ties_of_a_multikey_sort():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 99, 3000).tolist()) + b"\0" * 200 + b"b\0" * 100
    at, group = rng.integers(0, len(data) - 21, 2500), rng.integers(0, 3, 2500)
    for length in (3, 8, 9, 16, 21):
        seen, want = {}, []
        for k, (g, a) in enumerate(zip(group, at, strict=True)):
            if (key := (g, data[a : a + length])) in seen:
                want.append(k)
            seen.setdefault(key, k)
        later, first = S.multikey_ties(data, at, group, length)
        assert sorted(later) == want
        assert sorted(first) == sorted({seen[(group[k], data[at[k] : at[k] + length])] for k in want})


def test_fragments_hold_every_suffix_once():
    rng = np.random.default_rng(2)
    docs = [bytes(rng.integers(97, 100, n).tolist()) for n in (0, 99, 100, 101, 700, 3000)] + [b"x" * 500, b"xy" * 300]
    starts = np.cumsum([0, *map(len, docs)])
    doc, at, count, _, _ = S.fragments(b"".join(docs), starts[:-1], starts[1:])
    assert count.min() >= 1 and count.max() <= S._SPAN
    got = sorted(p for a, c in zip(at, count, strict=True) for p in range(a, a + c))
    assert got == [p for a, b in zip(starts[:-1], starts[1:], strict=True) for p in range(a, b - 99)]
    assert all(starts[d] <= a and a + c + 99 <= starts[d + 1] for d, a, c in zip(doc, at, count, strict=True))


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [None, "", "short", "é" * 49 + "z", "é" * 50, "é" * 70, *corpus(rng, 160), "deep " * 4000]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) * 3, texts, strict=True)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, kept string, doc int").repartition(3)
    want = {i: expected(*x) for i, x in brute(rows).items()}
    for small in (False, True):
        if small:  # parts, divided anchors and many boundaries
            monkeypatch.setattr(S, "PART", 900)
            monkeypatch.setattr(S, "SORTED_BYTES", 3000)
            monkeypatch.setattr(S, "MOST_OF_ANCHOR", 5)
            spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.strip(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want
    assert S.strip(df.limit(0)).count() == 0


def test_rows_that_share_an_id_and_null_ids(spark):
    p, q = "one two three four five " * 6, "six seven eight nine ten " * 7
    rows = [(5, p), (5, p), (5, q), (None, q + "!"), (7, p + q), (None, q + "!")]
    got = S.strip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ranked = sorted({(i is not None, i or 0, hashlib.sha256(t.encode()).hexdigest(), t) for i, t in rows})
    by = {(r[1] if r[0] else None, r[3]): expected(*x) for r, x in zip(ranked, brute([(k, r[3]) for k, r in enumerate(ranked)]).values(), strict=True)}
    assert sorted(map(str, got)) == sorted(str(g) for g in got) and len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(i), *by[i, t]) for i, t in rows)


def test_texts_of_the_pipeline(spark):
    p = " ".join(f"naïve passage {k}" for k in range(12))
    df = spark.createDataFrame([(1, "a é" + p, "x", 9), (2, "bb é" + p + "end", "y", 9), (3, None, "z", None)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in S.kept_texts(df).collect()}
    assert got[1].text == "a é" + p and got[3].text is None and got[3].lang == "z"
    assert got[2].text == "bbend" and got[2].n_chars == 5
