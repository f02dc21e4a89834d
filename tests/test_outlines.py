"""Relations in outline: what is chosen without summaries and traces is what their traces say."""

from pyspark.sql import functions as F
from test_reconcile import CASES, claim, claims

from claimweave.operators import reconcile


def pairs(spark):
    """The cases of test_reconcile, each in a block of its own."""
    rows = []
    for k, (a, b, *_) in enumerate(CASES.values()):
        rows += [claim(f"a{k}", **{"subject": f"Subject {k}"} | a | {"measure": a.get("measure", "output")}), claim(f"b{k}", **{"doc": "d2", "subject": f"Subject {k}"} | b)]
    return claims(spark, rows)


def test_outcomes_are_those_of_the_trace(spark):
    made = pairs(spark)
    told = {(r.claim_a_id, r.claim_b_id): r for r in reconcile.reconcile(made).collect()}
    found = reconcile.outlined(made).collect()
    assert len(found) == len(told) == len(CASES)
    for r in found:
        full = told[r.claim_a_id, r.claim_b_id]
        assert (r.id, r.verdict, r.confidence, r.cross_doc) == (full.id, full.verdict, full.confidence, full.cross_doc)
        assert [(c.partition(":")[0], x) for c, x in r.outcomes.asDict().items() if x] == [(s.check, s.outcome) for s in full.trace]
    few = reconcile.outlined(made).where("verdict = 'contradicts'")
    assert {r.id: r for r in reconcile.in_full(few, made).collect()} == {r.id: r for r in told.values() if r.verdict == "contradicts"}


def test_a_condition_on_an_outcome_stays_above_the_rules(spark):
    """Where Spark moves it into the join, what it depends on is computed anew for each time that it's named."""
    found = reconcile.outlined(pairs(spark)).where(F.col("outcomes")["period-containment"] == "fail")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("period-containment" if "period-containment" in plan else "Filter") < plan.index("Generate explode")
    assert max(map(len, plan[plan.index("Join Inner") :].splitlines())) < 5_000
