"""Needles in pages, looked for all at once."""

import random

from pyspark.sql import functions as F

from claimweave.operators import triage


def test_recall_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(triage, "BLOCK", 64)
    r = random.Random(5)
    text = lambda n: "".join(r.choice(["ab", "b", "é", " ", "₹", "a"]) for _ in range(n))
    pages = [(f"d{k % 3}", k, None if k == 7 else text(r.randint(0, 80)), r.choice([0.0, 2.0, 3.0])) for k in range(60)]
    needles = [(d, t[i : i + n]) for d, _, t, _ in pages[::4] if t for n in (1, 2, 5, 9, 40) for i in [r.randint(0, len(t))]] + [("d0", "absent"), ("d9", "a"), ("d1", ""), ("d1", None)]
    want = {b: 0 for b in (1, 4, None)}
    for d, needle in set(needles):
        ranked = sorted((-s, k, t) for e, k, t, s in pages if e == d)
        places = [i for i, (s, _, t) in enumerate(ranked, 1) if needle is not None and t is not None and needle in t and -s >= 1.5]
        for b in want:
            want[b] += bool(places) and (b is None or places[0] <= b)
    scored = spark.createDataFrame(pages, "doc_id string, page_no int, text string, score double")
    row = triage.triage_recall(scored, spark.createDataFrame(needles, "doc_id string, needle string"), budgets=tuple(want)).first()
    assert (row.found_1, row.found_4, row.found_all, row.known) == (*want.values(), len(set(needles)))


def test_texts_are_not_compared_needle_by_needle(spark):
    pages = spark.createDataFrame([("d", 1, "one two", 2.0)], "doc_id string, page_no int, text string, score double")
    found = triage.occurrences(pages, spark.createDataFrame([(b"two",)], "needle binary"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert [(r.page_no, r.needle) for r in found.where(F.col("needle").isNotNull()).collect()] == [(1, b"two")]
