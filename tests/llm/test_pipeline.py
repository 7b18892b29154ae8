import re

import numpy as np

import corpus_pipeline as P
from twinsieve.llm import language_id, toxicity
from twinsieve.llm.common import held_out

from test_near_dedup import brute as brute_classes
from test_suffix_dedup import brute as brute_repeats

WORDS = {"en": "the house and that river with green trees of summer", "de": "das Häuschen und jener Fluß mit grünen Bäumen im Sommer"}


def documents(rng):
    passage = " ".join(f"passage{k}" for k in range(30))
    rows = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        text = " ".join([*rng.choice(WORDS[lang].split(), 25), *(f"{lang}{k}" for k in rng.integers(0, 9999, 12))])
        text += " moron scum filth" if i % 6 == 0 else ""
        text += " " + passage if i % 10 == 3 else ""
        rows.append((i, text, lang, "s", len(text)))
    rows += [(300 + k, rows[k + 1][1] + " more", "en", "s", 1) for k in range(0, 40, 4)]
    rows = [*rows, (400, None, "en", "s", None), (401, "", "de", None, 0), (402, "12 34", None, "s", 5), (403, "the river " * 30_000, "en", "s", 9), (None, "the house and no id", "en", "s", 3)]
    return [(*r, r[0], 7, "x") for r in rows]


def test_each_stage_against_brute_force(spark, tmp_path):
    rows = documents(np.random.default_rng(1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id long, doc int, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(P.STAGES)
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=str)

    model, lower = language_id.train(docs.filter(~held_out())), language_id.letters()
    known = stages["language_id"](spark, docs, str(tmp_path)).cache()
    judged = {r[0]: language_id.judge(r[1], model, lower) for r in rows}
    assert got(known) == sorted((r for r in rows if judged[r[0]][0] != "und" and judged[r[0]][1] >= model.threshold), key=str)
    ids = {r.doc_id for r in known.collect()}
    assert ids >= {i for i in range(240)} and not ids & {400, 401, 402}

    clean = stages["toxicity"](spark, known, str(tmp_path)).cache()
    judge = toxicity.Scorer(toxicity.train(known, spark.read.parquet(f"{tmp_path}/labels.parquet").filter(~held_out())))
    assert got(clean) == sorted((tuple(r) for r in known.collect() if judge(r.text) < toxicity.THRESHOLD), key=str)
    assert not {r.doc_id for r in clean.collect()} & {i for i in range(240) if i % 6 == 0}

    single = stages["near_dedup"](spark, clean, str(tmp_path)).cache()
    by_class = brute_classes([(r.doc_id, r.text) for r in clean.collect() if r.doc_id is not None])
    assert got(single) == sorted((tuple(r) for r in clean.collect() if r.doc_id is None or by_class[r.doc_id] == r.doc_id), key=str)
    assert single.count() < clean.count()

    stripped = stages["suffix_dedup"](spark, single, str(tmp_path)).cache()
    order = sorted(single.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = {}
    for r, (data, gone) in zip(order, brute_repeats([(k, r.text) for k, r in enumerate(order)]).values(), strict=True):
        want[r.doc_id] = bytes(np.frombuffer(data, "u1")[~gone]).decode(errors="ignore")
    assert {r.doc_id: r.text for r in stripped.collect()} == want and stripped.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in stripped.collect())
    assert sum("passage29" in r.text for r in stripped.collect()) == 1 and re.search("passage29", want[3])

    pieces = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(want)
    assert all(sum(p.length for p in pieces if p.doc_id == i) == next(p.doc_tokens for p in pieces if p.doc_id == i) for i in want)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_each_stage_begins_with_executors_that_gave_back(spark, tmp_path):
    spark.createDataFrame([(i, "the house and that river", "en", "s", 24) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, context = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.sparkContext
    beans = context._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collected = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    for name, stage in P.STAGES:
        before = collected()
        context.setJobGroup(f"give back {name}", name)
        try:
            stage(spark, docs, str(tmp_path))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        tracker = context.statusTracker()
        first = tracker.getJobInfo(min(tracker.getJobIdsForGroup(f"give back {name}")))
        tasks = sum(tracker.getStageInfo(k).numTasks for k in first.stageIds)
        assert tasks == context.defaultParallelism and collected() > before, name
