"""What a reader asks of the stored tables: the review queue, claims and relations with their documents, counts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.ground import dropped_qualifiers, report
from claimweave.operators.reconcile import display_value
from claimweave.sources.store import bounded, checkpointed

#: The order of review.
ORDER = ("contradicts", "corroborates", "supersedes", "complementary")


def review_rank(verdict: Column) -> Column:
    out = F.when(verdict == ORDER[0], 0)
    for k, name in enumerate(ORDER[1:], 1):
        out = out.when(verdict == name, k)
    return out.otherwise(len(ORDER))


def review_order() -> list[Column]:
    return [review_rank(F.col("verdict")), F.desc("cross_doc"), F.desc("confidence"), F.asc("id")]


def relations(stored: DataFrame, verdict: str | None = None, cross_doc: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of relations in the order of review, ties by id; limit up to 500."""
    if not 0 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be from 0 to 500, and offset not negative")
    found = stored if verdict is None else stored.where(F.col("verdict") == verdict)
    found = found if cross_doc is None else found.where(F.col("cross_doc") == cross_doc)
    return found.orderBy(*review_order()).offset(offset).limit(limit)


def relation(stored: DataFrame, ident: str) -> DataFrame:
    return stored.where(F.col("id") == ident)


def claim_view(claims: DataFrame) -> DataFrame:
    """Claims with their value as text and what was dropped from their qualifiers."""
    shown = claims.select(*(F.col(c).alias(f"a_{c}") for c in claims.columns)).withColumn("display", display_value("a"))
    flat = shown.select(*(F.col(f"a_{c}").alias(c) for c in claims.columns), "display")
    return flat.withColumn("dropped", F.map_filter(F.coalesce("extra", F.expr("cast(map() as map<string, string>)")), lambda k, _: F.startswith(k, F.lit("dropped_")))).drop("extra")


def claim(claims: DataFrame, ident: str) -> DataFrame:
    return claim_view(claims.where(F.col("id") == ident))


def claims_of_document(claims: DataFrame, doc_id: str) -> DataFrame:
    """All claims of a document, whatever their status."""
    return claims.where(F.col("doc_id") == doc_id)


def claims_by_id(claims: DataFrame, wanted: DataFrame) -> DataFrame:
    """The claims whose ids wanted (id) lists; unknown ids give no row, repeated ones one."""
    return claims.join(bounded(wanted.select("id").distinct()), "id", "left_semi")


def relation_view(found: DataFrame, claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations with both claims and their documents' file names."""
    named = claim_view(claims).join(documents.select("doc_id", "filename"), "doc_id", "left")
    side = lambda s: named.select(F.col("id").alias(f"claim_{s}_id"), F.struct(*(c for c in named.columns)).alias(f"claim_{s}"))
    return found.join(side("a"), "claim_a_id").join(side("b"), "claim_b_id")


def documents(stored: DataFrame) -> DataFrame:
    return stored.orderBy(F.desc("ingested_at"), "doc_id")


def quarantined(claims: DataFrame, limit: int = 50) -> DataFrame:
    if not 0 <= limit <= 500:
        raise ValueError("limit must be from 0 to 500")
    return claims.where("status = 'quarantined'").orderBy("id").limit(limit)


def registry(measures: DataFrame) -> DataFrame:
    return measures.select("*", F.size("surface_forms").alias("n_forms")).orderBy(F.desc("n_forms"), "key")


def registry_stats(measures: DataFrame, decisions: DataFrame) -> DataFrame:
    n = measures.agg(F.count("*").alias("measures"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases"))
    return n.withColumn("decisions", F.lit(decisions.count()))


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def summary(claims: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: claims by status, documents, relations, and those across documents."""
    c = claims.agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "quarantined").alias("quarantined"), F.count_distinct("doc_id").alias("documents"))
    r = stored.agg(F.count("*").alias("relations"), F.count_if("cross_doc").alias("cross_doc"))
    return c.withColumn("_one", F.lit(1)).join(r.withColumn("_one", F.lit(1)), "_one").drop("_one")


def met(found: DataFrame, check: str, outcomes: tuple[str, ...]) -> Column:
    """Whether the derivation has the check with one of the outcomes; found: relations, or their outlines (reconcile.outlines)."""
    if "trace" in found.columns:
        return F.exists("trace", lambda s: (s["check"] == check) & s["outcome"].isin(*outcomes))
    out = F.lit(False)
    for name in found.schema["outcomes"].dataType.names:
        if name.partition(":")[0] == check:
            out = out | F.coalesce(F.col("outcomes")[name].isin(*outcomes), F.lit(False))
    return out


def firsts(found: DataFrame, cases: dict[str, Column], preferred: dict[str, Column] | None = None) -> DataFrame:
    """Each case's first relation in the order of review, those that are preferred before the others: (case, relation columns).

    One pass over relations or their outlines; those that are in no case are left out before anything else is computed
    of them. Of outlines only the columns that are used are carried along.
    """
    better = F.lit(False)
    for name, condition in (preferred or {}).items():
        better = F.when(F.col("case") == name, condition).otherwise(better)
    fitting = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in cases.items())))
    fits = found.where(F.greatest(*(condition.cast("int") for condition in cases.values()), F.lit(0)) > 0).select("*", F.explode(fitting).alias("case"))
    kept = [c for c in found.columns if c != "outcomes"]
    order = F.struct(~better, review_rank(F.col("verdict")), ~F.col("cross_doc"), -F.col("confidence"), F.col("id"))
    return fits.groupBy("case").agg(F.min_by(F.struct(*kept), order).alias("r")).select("case", "r.*")


def pick(stored: DataFrame, verdict: str, cross_doc: bool | None = None, check: str | None = None, outcomes: tuple[str, ...] = ("pass", "info", "fail", "blocked"), fall_back: bool = False) -> DataFrame:
    """The first relation in the order of review whose trace has the check with one of the outcomes; with fall_back the first of all if none has."""
    found = stored.where(F.col("verdict") == verdict)
    found = found if cross_doc is None else found.where(F.col("cross_doc") == cross_doc)
    meets = met(stored, check, outcomes) if check else F.lit(True)
    order = review_order() if not fall_back else [F.desc(meets), *review_order()]
    return (found if fall_back else found.where(meets)).orderBy(*order).limit(1)


def picks(found: DataFrame, requests: dict[str, tuple[str, dict]]) -> DataFrame:
    """What pick() gives for each request (verdict, its other arguments), from one pass over relations or their outlines: (case, relation columns)."""
    cases, preferred = {}, {}
    for name, (verdict, asked) in requests.items():
        meets = met(found, asked["check"], asked.get("outcomes", ("pass", "info", "fail", "blocked"))) if asked.get("check") else F.lit(True)
        within = F.col("verdict") == verdict
        within = within if asked.get("cross_doc") is None else within & (F.col("cross_doc") == asked["cross_doc"])
        cases[name] = within if asked.get("fall_back") else within & meets
        if asked.get("fall_back"):
            preferred[name] = meets
    return firsts(found, cases, preferred)


def highlights(found: DataFrame) -> DataFrame:
    """One relation for each way that claims can relate, chosen by how it was derived: (case, relation columns).

    Each case's first relation in the order of review, from one pass over relations or their outlines.
    """
    verdict = lambda v: F.col("verdict") == v
    return firsts(found, {
        "corroborated across documents": verdict("corroborates") & F.col("cross_doc"), "contradicted": verdict("contradicts"), "part of a period": verdict("complementary") & met(found, "period-containment", ("pass",)),
        "another basis": verdict("complementary") & met(found, "basis", ("info",)), "another scope": verdict("complementary") & met(found, "scope", ("info",)),
    })


def quarantine_case(claims: DataFrame, documents: DataFrame, shown: int = 6, invented: int = 8) -> dict[str, DataFrame]:
    """What was not let through: counts with their rate, the first quarantined claims with their files, dropped qualifiers."""
    first = claim_view(quarantined(claims, shown)).join(documents.select("doc_id", "filename"), "doc_id", "left")
    return {"report": report(claims), "quarantined": first.withColumn("document", F.coalesce("filename", "doc_id")).drop("filename"), "invented_qualifiers": dropped_qualifiers(claims, invented)}


def contradictions(stored: DataFrame, claims: DataFrame, limit: int = 15) -> DataFrame:
    """The first contradictions in the order of review, each with what both claims say; those of unknown claims are left out."""
    first = relations(stored, "contradicts", limit=limit)
    shown = ["measure_raw", "display", "page_no", "doc_id", "period_label", "scope", "basis"]
    view = claim_view(claims_by_id(claims, first.select(F.explode(F.array("claim_a_id", "claim_b_id")).alias("id"))))
    side = lambda s: view.select(F.col("id").alias(f"claim_{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in shown))
    found = first.join(side("a"), "claim_a_id").join(side("b"), "claim_b_id")
    return found.orderBy(*review_order()).select("id", "claim_a_id", "claim_b_id", "cross_doc", *(f"{s}_{c}" for s in "ab" for c in shown))


def tallies(claims: DataFrame) -> DataFrame:
    """(audit, a, b, c, n): all that audit() counts about claims, from one pass over them and one shuffle of counts.

    Each claim becomes a row for each table that it counts in, and these are counted by what the table groups by.
    """
    text = F.lit(None).cast("string")
    row = lambda name, a, b=text, c=text: F.struct(F.lit(name).alias("audit"), a.cast("string").alias("a"), b.cast("string").alias("b"), c.cast("string").alias("c"))
    c, active = F.col, F.col("status") == "active"
    value = F.coalesce(F.round("canonical_low", 4).cast("string"), F.lit("none"))
    rows = F.array(
        row("by_status", c("status"), c("grounding"), c("value_kind")), F.when(active, row("missing_qualifiers", F.lit("n"))),
        *(F.when(active & c(q).isNull(), row("missing_qualifiers", F.lit(f"no_{q}"))) for q in MAY_MISS),
        F.when(active & c("period_label").isNotNull() & c("period_start").isNull(), row("unparsed_periods", c("period_label"))),
        F.when(active & c("low").isNotNull() & c("canonical_low").isNull(), row("unknown_units", F.coalesce("unit_raw", F.lit("(none)")))),
        F.when(active & (F.length("measure_key") < 22), row("generic_measures", c("measure_key"), value)),
    )
    dropped = F.filter(F.map_entries(F.coalesce("extra", F.expr("cast(map() as map<string, string>)"))), lambda e: F.startswith(e["key"], F.lit("dropped_")))
    marked = F.transform(dropped, lambda e: row("dropped_qualifiers", F.substring(e["key"], 9, 1_000), e["value"]))
    return claims.select(F.explode(F.concat(F.array_compact(rows), marked)).alias("x")).select("x.*").groupBy("audit", "a", "b", "c").agg(F.count("*").alias("n"))


#: Qualifiers whose absence audit() counts.
MAY_MISS = ("period_label", "scope", "basis", "as_of", "unit_raw")


def audit(claims: DataFrame, measures: DataFrame | None = None, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables that show where extraction went wrong; with the relations, also their contradictions and verdicts.

    The claims are scanned once for all of the counts, whose distinct rows are written, and once for the listing.
    """
    counted = checkpointed(tallies(claims))
    of = lambda name: counted.where(F.col("audit") == name)
    missing = [F.coalesce(F.sum(F.when(F.col("a") == name, F.col("n"))), F.lit(0)).alias(name) for name in ("n", *(f"no_{q}" for q in MAY_MISS))]
    out = {
        "by_status": of("by_status").select(F.col("a").alias("status"), F.col("b").alias("grounding"), F.col("c").alias("value_kind"), "n"),
        "missing_qualifiers": of("missing_qualifiers").agg(*missing),
        "dropped_qualifiers": of("dropped_qualifiers").select(F.col("a").alias("qualifier"), F.col("b").alias("value"), "n").orderBy(F.desc("n"), "qualifier", "value").limit(12),
        "unparsed_periods": of("unparsed_periods").select(F.col("a").alias("period_label"), "n").orderBy(F.desc("n"), "period_label").limit(15),
        "unknown_units": of("unknown_units").select(F.col("a").alias("unit"), "n").orderBy(F.desc("n"), "unit").limit(15),
        "generic_measures": of("generic_measures").groupBy(F.col("a").alias("measure_key")).agg(F.count("*").alias("values")).where(F.col("values") > 12).orderBy(F.desc("values"), "measure_key"),
        "quarantined": quarantined(claims, 20),
    }
    if measures is not None:
        out["merged_measures"] = registry(measures).where("n_forms > 1").limit(10)
    if stored is not None:
        out["contradictions"] = contradictions(stored, claims)
        out["verdicts"] = counts(stored, "verdict")
        out["cross_document"] = stored.agg(F.count_if("cross_doc").alias("relations_cross_doc"))
    return out
