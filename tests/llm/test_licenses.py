import re

from twinsieve.llm import licenses as L

BY = {name: texts[0] for name, texts in L.SENTENCES}


def test_every_sentence_has_a_trigger_and_one_identifier():
    texts = [s for _, t in L.SENTENCES for s in t]
    assert all(re.search(L.TRIGGER, s) for s in texts)
    assert all(len(re.split(L.LINES, s + ".\n")) <= 2 or ";" in s or re.match(r"\d\. ", s) for s in texts)


def test_rules_and_odd_rows(spark):
    wrapped = BY["mit-grant"].replace(" ", "\n", 9) + ":\n\n" + BY["mit-notice"] + ".\n\n" + BY["mit-warranty"] + "."
    bsd = BY["bsd-grant"] + ":\n" + "\n".join(BY[k] + "." for k in ("bsd-1", "bsd-2"))
    rows = {
        0: (None, ""), 1: ("", ""), 2: ("Some words.\nReleased under the MIT License.", "MIT"), 3: (wrapped, "MIT"),
        4: (bsd, "BSD-2-Clause"), 5: (bsd + "\n" + BY["bsd-3"] + ".", "BSD-3-Clause"),
        6: (BY["mit-notice"] + ". " + BY["mit-grant"], ""), 7: ("The license of this is unknown.", ""),
        8: ("word " * 100_000 + ". Licensed under CC BY-NC 4.0.\n# SPDX-License-Identifier: GPL-3.0-or-later", "CC-BY-NC-4.0,GPL-3.0-or-later"),
        9: ("LICENSED   under the Apache License, Version 2.0.", "Apache-2.0"),
    }
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in rows.items()] * 2, "doc_id long, text string, licenses string")
    got = L.scan(df).collect()
    assert len(got) == 2 * len(rows) and all(r.licenses == rows[r.doc_id][1] for r in got)
    assert {r.doc_id for r in got if r.mentions} == {2, 3, 4, 5, 6, 7, 8, 9}
    assert L.scan(df.limit(0)).count() == 0
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
