import math
import os
import re
import zlib

import numpy as np
import pytest

from twinsieve.llm import language_id as L
from twinsieve.llm import toxicity as T

WORDS = {"en": "the house and that river with green trees", "de": "das Häuschen und jener Fluß mit grünen Bäumen", "fr": "la maison où cette rivière avec des arbres élevés"}


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    langs = rng.choice(list(WORDS), n)
    return [(" ".join(rng.choice(WORDS[x].split(), 12)), str(x)) for x in langs]


def test_language_of_unseen_texts_and_odd_rows(spark):
    rows = [(i, t, x, 1.0) for i, (t, x) in enumerate(corpus(400, 1))]
    rows += [(900, None, "en", 1.0), (901, "", "de", 1.0), (902, "12 34 !", "fr", 1.0), (903, "la maison " * 60_000, None, 1.0), (None, "the river", "en", 1.0), (0, rows[0][1], rows[0][2], 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.train(df.filter(~L.held_out()))
    got = L.predict(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].lang_pred == x for i, _, x, _ in rows[:400]]) > 0.98
    assert [(by[k].lang_pred, by[k].score, by[k].accepted) for k in (900, 901, 902)] == [("und", 0.0, False)] * 3
    assert by[903].lang_pred == "fr" and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in L.accepted(df, model).collect()}.isdisjoint({900, 901, 902})
    assert L.accepted(df, model).columns == df.columns
    none = L.train(df.limit(0))
    assert none is None and L.predict(df.limit(3), none).first().lang_pred == "und" and L.predict(df.limit(0), model).count() == 0


def test_parts_of_a_long_text_count_every_ngram_once(monkeypatch):
    lower = L.letters()
    text = "ab cd " * 50
    whole = np.concatenate(list(L.subwords(text, lower)))
    monkeypatch.setattr(L, "PART", 60)
    assert len(whole) <= len(np.concatenate(list(L.subwords(text, lower)))) <= 1.4 * len(whole)


def test_pairs_count_where_terms_alone_do_not():
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        words = {f"w{k}" for k in rng.integers(0, 200, 20)} | ({"insult"} if a else set()) | ({"group"} if b else set())
        rows.append(np.array(sorted(map(T.term_hash, words))))
        labels.append(int(a == b))  # no marginal effect at all
    m = T.fit(rows[:2000], np.array(labels[:2000]), epochs=40)
    judge = T.Scorer(m)
    scores = np.array([T.probability(m, np.flatnonzero(np.isin(m.terms, r))) for r in rows[2000:]])
    assert np.mean((scores > 0.5) == np.array(labels[2000:])) > 0.9
    assert 0 < judge(None) == judge("") < 1


def test_a_rare_pair_of_words_that_tell_nothing_alone():
    """Two words in 7 of 100 rows each: always toxic together, never alone, all other rows at random."""

    def rows(seed, n):
        rng, out = np.random.default_rng(seed), []
        for u in rng.random(n):
            pair = {1, 2} if u < 0.02 else {1} if u < 0.07 else {2} if u < 0.12 else set()
            words = {f"w{k}" for k in rng.integers(0, 400, 25)} | {f"p{k}" for k in pair}
            out.append((np.array(sorted(set(map(T.term_hash, words)))), len(pair), int(len(pair) == 2 or not pair and rng.random() < 0.27)))
        return out

    fitted = rows(1, 12_000)
    m = T.fit([r for r, _, _ in fitted], np.array([y for _, _, y in fitted]))
    scores = [(k, T.probability(m, np.flatnonzero(np.isin(m.terms, r)))) for r, k, _ in rows(2, 3000)]
    assert np.mean([s for k, s in scores if k == 2]) > 0.8 and np.mean([s for k, s in scores if k == 1]) < 0.2


def test_toxicity_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    plain = [" ".join(rng.choice(WORDS["en"].split(), 15)) for _ in range(300)]
    rows = [(i, t + (" moron scum" if i % 5 == 0 else ""), 9) for i, t in enumerate(plain)] + [(900, None, 9), (901, "", 9), (902, "river trees " * 50_000 + "Moron scum", 9), (None, "river", 9), (0, plain[0], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(7, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = T.train(df.filter("doc_id > 0"), labels)
    got = T.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got if r.doc_id}
    assert all(by[i] == int(i % 5 == 0) for i in range(1, 300)) and by[902] == 1 and by[900] == by[901] == 0
    assert T.accepted(df, model).filter("doc_id = 902").count() == 0 and T.accepted(df, model).columns == df.columns
    assert T.score(df.limit(0), T.train(df.limit(0), labels)).count() == 0


SF = os.environ.get("TWINSIEVE_TEST_SF", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def learnt(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


def slow_counts(text):
    """Buckets of n-grams of letters, one after another."""
    line = "\0" + re.sub(r"\0+", "\0", "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\0" for c in text or "")).strip("\0") + "\0"
    found = {}
    for n in L.ORDERS if len(line) > 2 else ():
        for at in range(len(line) - n + 1):
            h = 0
            for j, c in enumerate(line[at : at + n]):
                h = (h * 0x100000001B3 + ord(c) + j + 1) % 2**64
            if n > 1 or line[at] != "\0":
                bucket = (h * 0x9E3779B97F4A7C15 % 2**64 >> 48) % L.BUCKETS
                found[bucket] = found.get(bucket, 0) + 1
    return found


@tables
def test_language_query_equals_a_slow_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    counts = {r.doc_id: slow_counts(r.text) for r in docs}
    rows = sorted((r.lang, r.doc_id) for r in docs if r.lang is not None and r.text is not None and learnt(r.doc_id))
    packed = {i: np.array(sorted(c.items()), "i8").reshape(-1, 2) for i, c in counts.items()}
    rows.sort(key=lambda x: (x[0], packed[x[1]][:, 0].astype("u2").tobytes() + packed[x[1]][:, 1].astype("u4").tobytes()))
    m = L.fit([tuple(packed[i].T) for _, i in rows], [y for y, _ in rows])
    got = {r.doc_id: r for r in L.query(spark, SF).collect()}
    assert set(got) == set(counts)
    for i, c in counts.items():
        assert got[i].held_out == (not learnt(i))
        if not c:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        total = sum(c.values())
        z = [(sum(float(m.scores[b][k]) * n for b, n in c.items()) / total + m.offset[k]) / m.temperature for k in range(len(m.languages))]
        e = [math.exp(x - max(z)) for x in z]
        assert got[i].lang_pred == m.languages[int(np.argmax(z))] and abs(got[i].score - max(e) / sum(e)) < 1e-6


@tables
def test_toxicity_query_equals_a_slow_version(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.toxic in (0, 1) and r.doc_id in texts and learnt(r.doc_id):
            toxic[r.doc_id] = max(r.toxic, toxic.get(r.doc_id, 0))
    terms = {i: np.array(sorted({zlib.crc32(w.encode()) % T.BUCKETS for w in re.findall(r"\w+", (t or "").lower())}), "i4") for i, t in texts.items()}
    rows = sorted((terms[i].tobytes(), y, i) for i, y in toxic.items())
    m = T.fit([terms[i] for _, _, i in rows], np.array([y for _, y, _ in rows], "i8"))
    at = {int(t): k for k, t in enumerate(m.terms)}
    got = {r.doc_id: r for r in T.query(spark, SF).collect()}
    assert set(got) == set(texts)
    for i in texts:
        own = [at[int(t)] for t in terms[i] if int(t) in at]
        z = m.offset + sum(float(m.weights[k]) for k in own)
        z += sum(float(m.factors[a].astype("f8") @ m.factors[b].astype("f8")) for n, a in enumerate(own) for b in own[:n])
        p = 1 / (1 + math.exp(-max(-40.0, min(40.0, m.scale * z + m.shift))))
        assert abs(got[i].score - p) < 1e-4 and got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (not learnt(i))


def test_training_gives_back_what_it_held(spark, monkeypatch):
    done = []
    for module in (L, T):
        monkeypatch.setattr(module, "give_back", lambda: done.append("given"))
        monkeypatch.setattr(module, "fit", lambda *a, f=module.fit: (f(*a), done.append("fitted"))[0])
    rows = [(i, f"{('the house and', 'das Haus und')[i % 2]} x{i % 7}", ("en", "de")[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    L.train(df)
    T.train(df, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert done == ["given", "fitted", "given"] * 2


def test_judging_holds_few_scores_at_once():
    """Scores of all n-grams of a text, 4 bytes for each language, once were held at a time."""
    import tracemalloc

    rng = np.random.default_rng(3)
    model = L.Model([f"l{k:03}" for k in range(200)], rng.normal(size=(L.BUCKETS, 200)).astype("f4"), np.zeros(200), 1.0, 0.5)
    text, lower = "".join(rng.choice(list("abcde fg"), 100_000)), L.letters()
    found = np.concatenate(list(L.subwords(text, lower)))
    p = L._softmax((np.bincount(found, minlength=L.BUCKETS) @ model.scores.astype("f8")) / len(found))
    tracemalloc.start()
    name, score = L.judge(text, model, lower)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert name == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-9
    assert peak < 4 * len(found) * 200 / 4


def test_rows_by_term_are_dealt_a_part_at_a_time():
    """The order of all terms, 8 bytes each and as many to sort by, once was held at a time."""
    import tracemalloc

    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 400, 4000)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    rows = T._Rows(np.concatenate([rng.choice(3000, n, replace=False) for n in sizes]).astype("i4"), ends, rng.permutation(4000))
    want = rows.doc[np.argsort(rows.at, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(rows.at, minlength=3000))])
    tracemalloc.start()
    got = rows.by_term(3000, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((x == y).all() for x, y in zip(got, want, strict=True))
    assert peak < 2 * 4 * len(rows.at)
