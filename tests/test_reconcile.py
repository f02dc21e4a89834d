"""Each verdict on a pair of claims, and the pairs that are made."""

import datetime as dt

from pyspark.sql import functions as F

from claimweave.functions.schema import CLAIM, conform
from claimweave.operators import reconcile
from claimweave.plans.samples import finished

FIELDS = "id string, doc_id string, subject_raw string, measure_raw string, measure_key string, low double, high double, unit_raw string, period_label string, scope string, basis string, as_of date, estimate_type string, value_kind string, text_value string, page_no int, quote string, status string, confidence double, date_value date, bool_value boolean"


def claim(ident, doc="d1", subject="Norvale Limited", measure="output", value=None, high=None, unit="EUR million", period="2017", scope="consolidated", basis=None, as_of=None, estimate=None, kind=None, text=None, page=1, status="active", confidence=0.5, key=None, flag=None):
    kind = kind or ("text" if text is not None else "range" if high is not None else "number")
    return (ident, doc, subject, measure, key or measure.lower().replace(" ", "_"), value, value if high is None else high, unit if value is not None else None, period, scope, basis, as_of and dt.date.fromisoformat(as_of), estimate, kind, text, page, "q", status, confidence, None, flag)


def claims(spark, rows):
    return finished(spark.createDataFrame(rows, FIELDS)).withColumns({}) if rows else conform(spark.createDataFrame([], FIELDS), CLAIM)


def pair(spark, a, b, negative=()):
    rows = claims(spark, [claim("a", **a), claim("b", **{"doc": "d2"} | b)]).withColumn("pair_id", F.lit(1))
    keys = spark.createDataFrame([(k,) for k in negative], "measure_key string")
    found = reconcile.reconcile_pair(rows.where("id = 'a'"), rows.where("id = 'b'"), keys).collect()
    return found[0] if found else None


#: One case or more for each step of the decision list, in its order; a is of document d1, b of d2 unless it says otherwise.
CASES = {
    "no scale": (dict(value=70.0, unit="sacks"), dict(value=70.0), "underspecified", 0.4, ("unit", "blocked")),
    "other dimension": (dict(value=70.0, unit="tonnes"), dict(value=70.0), "underspecified", 0.4, ("unit", "blocked")),
    "other currency": (dict(value=70.0, unit="EUR bn"), dict(value=70.0, unit="GBP bn"), "underspecified", 0.4, ("unit", "blocked")),
    "no period": (dict(value=70.0), dict(value=70.0, period=None), "underspecified", 0.45, ("period", "blocked")),
    "period without dates": (dict(value=70.0, period="of late"), dict(value=70.0), "underspecified", 0.45, ("period", "blocked")),
    "other kinds": (dict(text="seventy"), dict(value=70.0), "underspecified", 0.4, ("value", "blocked")),
    "apart": (dict(value=70.0, period="H1 2017"), dict(value=12.0, period="2018 Q1"), "complementary", 0.9, ("period", "info")),
    "partly": (dict(value=70.0, period="2017"), dict(value=66.0, period="FY2018"), "complementary", 0.8, ("value", "info")),
    "part exceeds": (dict(value=88.0, period="2017 Q2"), dict(value=70.0, period="2017"), "contradicts", 0.85, ("period-containment", "fail")),
    "part fits": (dict(value=21.0, period="2017 Q2"), dict(value=70.0, period="2017"), "complementary", 0.9, ("period-containment", "pass")),
    "shares don't add up": (dict(value=34.0, unit="%", measure="market share", period="H2 2017"), dict(value=29.0, unit="%", measure="market share", period="2017"), "complementary", 0.9, ("period-containment", "info")),
    "rates by name": (dict(value=34.0, measure="operations", period="H2 2017"), dict(value=29.0, measure="operations", period="2017"), "complementary", 0.9, ("period-containment", "info")),
    "narrow scope exceeds": (dict(value=91.0, scope="standalone"), dict(value=90.0, scope="consolidated"), "contradicts", 0.8, ("scope-containment", "fail")),
    "narrow scope fits": (dict(value=14.0, scope="bakeries"), dict(value=90.0, scope="total"), "complementary", 0.88, ("scope-containment", "pass")),
    "two segments": (dict(value=14.0, scope="bakeries"), dict(value=33.0, scope="mills"), "complementary", 0.85, ("scope", "info")),
    "one scope": (dict(value=14.0, scope=None), dict(value=14.0, scope="bakeries"), "underspecified", 0.5, ("scope", "info")),
    "two bases": (dict(value=14.0, basis="restated"), dict(value=17.0, basis="provisional"), "complementary", 0.85, ("basis", "info")),
    "one basis": (dict(value=14.0), dict(value=14.0, basis="restated"), "underspecified", 0.45, ("basis", "blocked")),
    "rows of a page": (dict(value=14.0), dict(value=19.0, doc="d1"), "underspecified", 0.5, ("provenance", "blocked")),
    "pages of a document": (dict(value=14.0), dict(value=19.0, doc="d1", page=2), "contradicts", 0.85, ("value", "fail")),
    "said twice": (dict(value=14.0), dict(value=14.05, doc="d1"), "corroborates", 0.75, ("value", "pass")),
    "other scale": (dict(value=3.2, unit="EUR bn"), dict(value=3196.0, unit="€ million"), "corroborates", 0.9, ("unit", "pass")),
    "inside a range": (dict(value=11.5, high=16.0), dict(value=14.0), "corroborates", 0.9, ("value", "pass")),
    "outside a range": (dict(value=11.5, high=13.0), dict(value=14.0), "contradicts", 0.85, ("value", "fail")),
    "later figure": (dict(value=14.0, as_of="2018-03-09", estimate="estimate"), dict(value=19.0, as_of="2018-06-30"), "supersedes", 0.85, ("as_of", "info")),
    "later state": (dict(text="open", as_of="2016-02-11", period="as at February 11, 2016"), dict(text="shut for good", as_of="2017-09-05", period="as at September 5, 2017"), "supersedes", 0.85, ("as_of", "info")),
    "later final figure": (dict(value=14.0, as_of="2018-03-09"), dict(value=19.0, as_of="2018-06-30"), "contradicts", 0.85, ("value", "fail")),
    "truth values": (dict(kind="boolean", flag=False), dict(kind="boolean", flag=True), "contradicts", 0.85, ("value", "fail")),
    "no truth values": (dict(kind="boolean"), dict(kind="boolean"), "corroborates", 0.9, ("value", "pass")),
    "differ": (dict(value=14.0), dict(value=19.0), "contradicts", 0.85, ("value", "fail")),
}


def test_verdicts(spark):
    """Every case both ways round: the verdict doesn't depend on which claim comes first."""
    left, right = [], []
    for k, (a, b, *_) in enumerate(CASES.values()):
        left += [claim(f"a{k}", **a), claim(f"c{k}", **{"doc": "d2"} | b)]
        right += [claim(f"b{k}", **{"doc": "d2"} | b), claim(f"d{k}", **a)]
    at = lambda rows: claims(spark, rows).withColumn("pair_id", F.concat(F.when(F.substring("id", 1, 1).isin("a", "b"), "one").otherwise("two"), F.substring("id", 2, 9)))
    found = {(r.claim_a_id[0], int(r.claim_a_id[1:])): r for r in reconcile.reconcile_pair(at(left), at(right), spark.createDataFrame([], "measure_key string")).collect()}
    for k, (name, (_, _, verdict, confidence, (check, outcome))) in enumerate(CASES.items()):
        for way in "ac":
            r = found[way, k]
            assert (r.verdict, r.confidence) == (verdict, confidence), name
            assert (check, outcome) in {(s.check, s.outcome) for s in r.trace}, name


def test_negative_measures_are_not_contained(spark):
    a, b = dict(value=41.0, measure="cash flow"), dict(value=52.0, measure="cash flow", period="2017 Q3")
    assert pair(spark, a, b).verdict == "contradicts"
    assert pair(spark, a, b, ["cash_flow"]).verdict == "complementary"


def test_unlike_subjects_and_inactive_claims_give_nothing(spark):
    assert pair(spark, dict(value=1.0, subject="Harbour Trust of Arland"), dict(value=1.0, subject="Arland")) is None
    assert pair(spark, dict(value=1.0, status="quarantined"), dict(value=1.0)) is None


def test_blocks_caps_and_increments(spark):
    rows = [claim(f"{d}{i}", doc=d, value=float(i), confidence=i / 10, period=f"201{i}") for d in "xyz" for i in range(4)]
    rows += [claim("other", subject="Else", value=1.0), claim("gone", value=1.0, status="quarantined"), claim("none", subject=None, value=None, period=None)]
    all_ = claims(spark, rows)
    full = {(r.claim_a_id, r.claim_b_id): r.verdict for r in reconcile.reconcile(all_).collect()}
    assert len(full) == 12 * 11 // 2
    capped = reconcile.reconcile(all_, cap=3).collect()
    assert {r.claim_a_id for r in capped} | {r.claim_b_id for r in capped} == {"x3", "y3", "z3"}
    stored, seen = {}, all_.limit(0)
    for doc in ("z", "x", "y"):  # any order gives what the whole gives
        known = spark.createDataFrame([k for k in stored] or [], "claim_a_id string, claim_b_id string")
        found = reconcile.reconcile_incremental(all_.where(F.col("doc_id") == doc), seen, known).collect()
        stored |= {(r.claim_a_id, r.claim_b_id): r.verdict for r in found}
        seen = seen.unionByName(all_.where(F.col("doc_id") == doc))
    assert stored == full
    known = spark.createDataFrame([(b, a) for a, b in stored], "claim_a_id string, claim_b_id string")
    assert reconcile.reconcile_incremental(all_.where("doc_id = 'x'"), all_.where("doc_id <> 'x'"), known).isEmpty()
    assert reconcile.reconcile(all_.limit(0)).isEmpty()
