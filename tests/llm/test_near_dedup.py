import re
from collections import Counter

import numpy as np

from twinsieve.llm import common as C
from twinsieve.llm import near_dedup as N
from twinsieve.llm.components import components


def brute(rows):
    """Classes by all pairs of weighted shingles."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    ids = sorted(sets)
    up = list(range(len(ids)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for x, a in enumerate(ids):
        for y in range(x):
            s, t = sets[a], sets[ids[y]]
            if s and t and (s & t).total() >= 0.8 * (s | t).total():
                p, q = root(x), root(y)
                up[max(p, q)] = min(p, q)
    return {a: ids[root(x)] for x, a in enumerate(ids)}


def corpus(rng, n):
    base = [[f"w{k}" for k in rng.integers(0, 400, rng.integers(30, 120))] for _ in range(n // 6)]
    base = [b * int(rng.integers(1, 4)) if k % 3 == 0 else b for k, b in enumerate(base)]
    out = []
    for _ in range(n):
        words = list(base[int(rng.integers(len(base)) ** 1.0 * rng.random())])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = f"new{rng.integers(10**6)}"
        out.append(" ".join(words))
    return out


def test_agreement_follows_weighted_similarity():
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 2**63, 400).astype("u8")
    a, b = rng.uniform(0.2, 3, 400), rng.uniform(0.2, 3, 400)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    x, y = N.signature(elements, a, 4000), N.signature(elements, b, 4000)
    assert abs((x == y).mean() - want) < 0.035
    part = elements[:300]
    assert abs((N.signature(part, None, 4000) == N.signature(elements, None, 4000)).mean() - 0.75) < 0.03
    for few in (1, 3):
        assert (N.signature(elements[:few]) == N.signature(elements[:few], np.ones(few))).all()


def test_parts_of_long_texts_give_the_same_shingles(monkeypatch):
    text = "one two, three_x four five six! " * 40
    whole = N.shingles(text, N.word_hashes())
    monkeypatch.setattr(N, "parts", lambda t, f=N.parts: f(t, 50))
    assert (N.shingles(text, N.word_hashes()) == whole).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 500 for k in range(500, 540)}, 2: 2, 3: 2}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [None, "", " ,, ", "short text", "short text", "Short, text!", "long one " * 30_000, *corpus(rng, 180)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, texts[3], 1), (9, texts[9], 1)], "doc_id long, text string, class_id int")
    for block in (512, 5):
        monkeypatch.setattr(N, "EXACT_BYTES", 700 * block)
        monkeypatch.setattr(N, "BUCKET_BLOCK", block)
        got = N.classes(df).collect()
        assert len(got) == len(rows) + 2
        assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute(rows)
        assert all(r.keep == (r.doc_id is None or r.doc_id == r.class_id) for r in got)
        if block == 512:
            assert N.classes(df.limit(0)).count() == 0


def test_weights_decide(spark):
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words), " ".join(words * 3), " ".join(words * 3 + words[:20]), " ".join(words + ["x"])]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute(list(enumerate(texts))) == {0: 0, 1: 1, 2: 1, 3: 0}


def test_ids_of_any_type_shared_ids_and_clashing_names(spark):
    rng = np.random.default_rng(6)
    texts = corpus(rng, 40)
    names = ["_id", "id", "doc", "tag", "same", "class", "class_id", "keep", "rep", "n", "turn", "_tag", "spans"]
    rows = [(f"k{i:03d}", t, *[i] * len(names)) for i, t in enumerate(texts)]
    rows += [(None, texts[0], *[7] * len(names)), (None, texts[0], *[7] * len(names)), ("k001", texts[1], *[0] * len(names)), ("k002", "another text of k002", *[1] * len(names)), ("k002", None, *[2] * len(names))]
    df = spark.createDataFrame(rows, "doc_id string, text string, " + ", ".join(f"{n} int" for n in names))
    want = {f"k{i:03d}": f"k{c:03d}" for i, c in brute(list(enumerate(texts))).items()}
    got = N.classes(df).collect()
    assert len(got) == len(rows) and sorted(got[0].asDict()) == ["class_id", "doc_id", "keep"]
    assert all(r.class_id == want[r.doc_id] for r in got if r.doc_id not in (None, "k002")) and all(r.class_id is None and r.keep for r in got if r.doc_id is None)
    left = N.one_of_each(df)
    assert left.columns == df.columns
    kept = [(r.doc_id, r.text, r._id) for r in left.collect()]
    expected = [(f"k{i:03d}", t, i) for i, t in enumerate(texts) if want[f"k{i:03d}"] == f"k{i:03d}"]
    expected = [(a, b, 0) if a == "k001" else (a, b, c) for a, b, c in expected]
    expected += [(None, texts[0], 7)] * 2 + [("k002", "another text of k002", 1), ("k002", None, 2)]
    assert sorted(map(repr, kept)) == sorted(map(repr, expected))
    days = df.limit(30).selectExpr("date_add(date'2020-01-01', _id) AS doc_id", "text")
    assert N.classes(days).filter("keep").count() == N.one_of_each(days).count() > 3
    unique = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(texts)], "doc_id smallint, text string, _id int, id int")
    assert {r.doc_id for r in N.one_of_each(unique).collect()} == {i for i, c in brute(list(enumerate(texts))).items() if i == c}


def test_a_large_key_is_linked_by_its_centre_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = {i: int(x) for i, x in enumerate(rng.choice([*range(0, 40), *range(100, 130), 500, 503], 150))}
    near = lambda values, a, rest: np.array([abs(int(values[a]) - int(values[b])) <= 2 for b in rest])
    rows = spark.createDataFrame([(7, i, 1) for i in points] + [(8, 900, 1)], "key long, id long, w long")
    values = spark.createDataFrame([(i, str(x).encode()) for i, x in points.items()] + [(900, b"1")], "id long, v binary")
    runs: list[list[int]] = []
    for x in sorted(set(points.values())):
        runs = [*runs[:-1], [*runs[-1], x]] if runs and x - runs[-1][-1] <= 2 else [*runs, [x]]
    groups = [[i for i, x in points.items() if x in run] for run in runs]
    want = {i: min(g) for g in groups if len(g) > 1 for i in g}
    for size in (1000, 20, 3):
        links = N._linked(rows, values, "key", "v", size, near)
        assert {r.id: r.root for r in components(links).collect()} == want


def test_only_rows_that_may_be_among_ids_meet_them(spark, monkeypatch):
    ids = spark.createDataFrame([(i,) for i in range(0, 4000, 10)], "doc long")
    rows = spark.createDataFrame([(i, "x", i, i) for i in range(4000)] + [(None, "y", 1, 2), (10, "z", 3, 4)], "doc_id int, at string, part int, `own` int")
    want = sorted((tuple(r) for r in rows.collect() if r.doc_id is None or r.doc_id % 10), key=str)
    for slots in (1 << 26, 1 << 15):  # the latter as if ids were too many for the map
        monkeypatch.setattr(C, "SLOTS", slots)
        maybe, others = C.told_apart(rows, ids, "doc_id")
        assert maybe.columns == others.columns == rows.columns and maybe.count() + others.count() == 4002
        assert {i for i in range(0, 4000, 10)} <= {r.doc_id for r in maybe.collect()} and maybe.count() < 500
        assert sorted((tuple(r) for r in C.without(rows, ids, "doc_id").collect()), key=str) == want
    assert C.without(rows, ids.limit(0), "doc_id").count() == 4002


def test_texts_without_a_link_stay_out_of_shuffles(spark, monkeypatch):
    """What may be linked alone reaches the links by weighted shingles."""
    met, linked = [], N._linked
    monkeypatch.setattr(N, "_linked", lambda rows, values, key, *rest: (met.append(values.count()) if key == "root" else None, linked(rows, values, key, *rest))[1])
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(60)]
    texts += [texts[0] + " more", texts[1] + " more"]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: c for i, c in got.items() if i != c} == {60: 0, 61: 1} and 4 <= met[0] < 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert N.one_of_each(docs).count() == 60


def test_signing_draws_few_ranks(monkeypatch):
    """Some ten ranks for each shingle of a usual text, not thirty, most of them in one go."""
    drawn, mix = [], N.mix
    monkeypatch.setattr(N, "mix", lambda x: drawn.append(x.size) or mix(x))
    elements = mix(np.arange(1, 481, dtype="u8"))
    one = N.signature(elements)
    assert sum(drawn) < 15 * len(elements)
    two = N.signature(mix(np.arange(481, 961, dtype="u8")))
    assert (N.band_keys(np.stack([one, two])) == [N.band_keys(one), N.band_keys(two)]).all()


def test_words_without_a_regular_expression():
    texts = ["", "A_b c9,d.E\x1cf\x00g\n\th", *map(chr, range(256)), "naïve Café-É ß x² 漢字, İa"]
    for text in [*texts, "x".join(texts), " ".join(texts[:130])]:
        assert C.word_runs(text) == re.findall(r"\w+", text.lower())


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Links up to a bound are joined up at once, to what the rounds make of them."""
    rng = np.random.default_rng(4)
    links = [*((int(x), int(y)) for x, y in rng.integers(0, 400, (180, 2))), *((1000 + k, 1001 + k) for k in range(60)), (7, 7), (2**40, 5), (5, 2**40)]
    edges = spark.createDataFrame(links, "a long, b long")
    by_rounds = sorted(map(tuple, components(edges, at_once=0).collect()))
    monkeypatch.setattr("twinsieve.llm.components._stars", None)
    found = components(edges)
    assert sorted(map(tuple, found.collect())) == by_rounds and found.columns == ["id", "root"]
    assert components(edges.limit(0)).count() == 0
