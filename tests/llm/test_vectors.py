import numpy as np
import pytest

from twinsieve.llm import graph_search as G
from twinsieve.llm import mtree as M
from twinsieve.llm import vectors as V


def brute(rows, queries, k, score):
    out = set()
    for i, q in queries:
        found = sorted(((-score(q, v), j) for j, v in rows if j != i))[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


def embeddings(rng, n, hot=0.3):
    x = rng.normal(0, 1, (n, 8)).astype("f4")
    x[rng.random(n) < hot] = x[0]
    return [(i, v.tolist(), 1) for i, v in enumerate(x)]


SCHEMA = "vec_id long, embedding array<float>, score int"
ODD = [(2000, None, 1), (2020, [1.0, None] * 4, 1), (2040, [float("nan")] * 8, 1), (2060, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]


@pytest.mark.parametrize("page", [8192, 60])
def test_top_k_equals_brute_force(spark, monkeypatch, page):
    monkeypatch.setattr(V, "PAGE", page)
    monkeypatch.setattr(M, "LEAF", 16)
    monkeypatch.setattr(V, "SEEDS", 50)
    rows = [*embeddings(np.random.default_rng(1), 400), (900, [0.5] * 5, 1), (901, [], 1), (902, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows + ODD + rows[:1], SCHEMA)
    ints = [(i, np.floor(64 * np.array(v + [0.0] * (8 - len(v)), "f4").astype("f8"))) for i, v, _ in rows]
    ints.append(ints[0])
    want = brute(ints, [x for x in ints if x[0] % 20 == 0], 20, lambda q, v: int(q @ v))
    assert {tuple(r) for r in M.top_k(df, "vec_id % 20 = 0").collect()} == want
    assert M.top_k(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_a_query_computes_few_products_where_vectors_form_groups():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (40, 8))
    x = (centres[rng.integers(40, size=8000)] + rng.integers(-20, 20, (8000, 8))).astype("i2")
    sp = V.Space(len(x), 8, float((x.astype("f8") ** 2).sum(1).max()), "i2", "f8")
    searcher = M.Searcher(M.Tree(np.arange(len(x)), x, sp).payload(), sp)
    for k in range(0, 8000, 400):
        searcher.computed = 0
        ids, scores = searcher.one(k, x[k].astype("f8"))
        s = x.astype("i8") @ x[k].astype("i8")
        s[k] = -(2**60)
        order = np.lexsort((np.arange(len(x)), -s))[:20]
        assert sorted(zip(ids, scores, strict=True)) == sorted(zip(order, s[order], strict=True))
        assert searcher.computed < 3000


def test_large_components_are_exact_or_refused(spark):
    df = spark.createDataFrame([(0, [2.0**22, 2.0**-6]), (1, [2.0**22, 0.5]), (2, [2.0**22, 0.25])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in M.top_k(df, "vec_id = 0").orderBy("rank").collect()]
    assert got == [(1, 2**56 + 32), (2, 2**56 + 16)]
    with pytest.raises(ValueError):
        M.top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"), "true")


@pytest.mark.parametrize("page", [8192, 20])
def test_recall_and_scores_of_the_graph(spark, monkeypatch, page):
    """In one page, and in 60."""
    monkeypatch.setattr(G, "PAGE", page)
    monkeypatch.setattr(G, "SEEDS", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (1500, 24)).astype("f4") * rng.uniform(0.5, 2, (1500, 1)).astype("f4")
    x[rng.random(1500) < 0.2] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + ODD + [(2080, [0.0] * 24, 1)], SCHEMA)
    got = G.nearest(df, "vec_id % 20 = 0").collect()
    f8 = x.astype("f8")
    assert len(got) == 75 * 20 and all(np.isclose(r.score, f8[r.query_id] @ f8[r.vec_id], rtol=1e-12) and r.query_id != r.vec_id for r in got)
    hits = 0
    for i in range(0, 1500, 20):
        s = f8 @ f8[i]
        s[i] = -1e9
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and len({r.vec_id for r in mine}) == 20
        hits += sum(r.score >= np.sort(s)[-20] - 1e-9 for r in mine)
    assert hits / 1500 > 0.95


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(i, [1.0, i + 0.5], 1) for i in range(5)] + [(0, [1.0, 0.5], 1)], SCHEMA)
    got = [(r.rank, r.vec_id) for r in G.nearest(df, "vec_id = 0").orderBy("rank").collect()]
    assert got == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert G.nearest(df.limit(0), "true").count() == 0
