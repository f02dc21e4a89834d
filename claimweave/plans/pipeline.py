"""Whole runs: ingesting files, rebuilding what was stored, correcting subjects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import periods
from claimweave.functions.schema import CLAIM, conform
from claimweave.functions.text import normalise_subject
from claimweave.functions.units import canonicalise, parse_unit
from claimweave.operators import extract, ground, reconcile, registry, triage
from claimweave.plans import changes
from claimweave.sources.pages import Parser, parse_text, read_documents
from claimweave.sources.store import Store, bounded, checkpointed, unseen_documents


@dataclass(frozen=True)
class Settings:
    model: str = "offline"
    min_score: float = triage.MIN_SCORE
    budget: int | None = None
    fiscal_start: int = periods.FISCAL_START
    cap: int | None = reconcile.BLOCK_CAP


def ingest(spark: SparkSession, store: Store, path: str, provider: Callable[[str], str | None] | None, parser: Parser = parse_text, glob: str = "*.txt", settings: Settings = Settings(), force: bool = False, decisions: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Read files, extract, ground and canonicalise their claims, compare them with the stored ones; returns a report.

    Documents that are stored are left out unless force is set; then their claims replace the old ones, those that they
    don't state any more go, and relations follow. Only such claims are written, and those whose measure's key changed.
    The provider is also asked which measure names are the same, once for each pair: its answers are stored.
    """
    documents, pages = read_documents(spark, path, parser, glob)
    new = documents if force else unseen_documents(documents, store)
    pages = checkpointed(pages.join(new.select("doc_id"), "doc_id", "left_semi"))
    scored = checkpointed(triage.score_pages(pages))
    chosen = triage.choose(scored, settings.min_score, settings.budget)

    cache = store.read("responses")
    profile_answers = checkpointed(extract.ask(extract.profile_requests(pages, settings.model), cache, provider, extract.no_profile))
    new = new.join(extract.profiles(profile_answers), "doc_id", "left").join(pages.groupBy("doc_id").agg(F.max("title").alias("title"), F.count("*").cast("int").alias("pages")), "doc_id", "left").withColumn("ingested_at", F.current_timestamp())
    new = checkpointed(new)
    page_answers = checkpointed(extract.ask(extract.page_requests(chosen, settings.model), cache, provider, extract.no_claims))
    rows, _ = extract.raw_claims(page_answers)
    store.upsert("responses", extract.replies(profile_answers).unionByName(extract.replies(page_answers)))

    claims = checkpointed(ground.ground(extract.build_claims(rows, new), pages))
    stored = store.read("claims")
    mine = bounded(new.select("doc_id"))
    of_mine = checkpointed(stored.join(mine, "doc_id", "left_semi"))  # of a forced run, or one that was cut off
    others = stored.select("id", "doc_id", "page_no", "measure_raw", "measure_key").join(mine, "doc_id", "left_anti")
    said = store.read("decisions") if decisions is None else store.read("decisions").unionByName(decisions.select("a", "b", "same"))
    names = checkpointed(registry.first_names(others.unionByName(claims.select(*others.columns))))
    measures, keys, questions = registry.resolve(names, said)
    if provider is not None and not (answers := checkpointed(registry.adjudicate(questions, registry.adjudicator(provider)))).isEmpty():
        store.upsert("decisions", answers)
        measures, keys, _ = registry.resolve(names, said.unionByName(answers))
    keys = checkpointed(keys)
    # A merge of names can bring stored claims together: those with another key than before change too.
    renamed = bounded(others.select("measure_raw", "measure_key").distinct().join(registry.with_keys(others.select("measure_raw").distinct(), keys).withColumnRenamed("measure_key", "_key"), "measure_raw").where(~F.col("measure_key").eqNullSafe(F.col("_key"))).select("measure_raw").distinct())
    moved = stored.join(mine, "doc_id", "left_anti").join(renamed, "measure_raw", "left_semi").select(*stored.columns)
    fresh = checkpointed(registry.with_keys(claims.unionByName(moved), keys))
    found = changes.apply(store, fresh, of_mine, settings.cap)

    store.upsert("documents", new)
    old_measures = store.read("measures")
    store.upsert("measures", checkpointed(measures.exceptAll(old_measures.select(*measures.columns))), gone=old_measures.join(bounded(measures.select("key")), "key", "left_anti"))
    return report(new, scored, fresh.join(mine, "doc_id", "left_semi"), found, settings.min_score, page_answers)


def report(documents: DataFrame, scored: DataFrame, claims: DataFrame, relations: DataFrame, min_score: float, answers: DataFrame | None = None) -> DataFrame:
    """One row about a run; pages_skipped are those that were chosen but got no valid response, calls what the model was asked for them."""
    parts = [documents.agg(F.count("*").alias("documents")), triage.coverage(scored, min_score), ground.report(claims), relations.agg(F.count("*").alias("relations"), F.count_if("cross_doc").alias("cross_doc"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("corroborates", "contradicts", "complementary", "supersedes", "underspecified")))]
    if answers is not None:
        calls = F.when(F.col("outcome").isin("repaired", "failed"), 2).when(F.col("outcome") == "first", 1).otherwise(0)
        parts.append(answers.agg(F.count_if(F.col("response").isNull()).alias("pages_skipped"), F.coalesce(F.sum(calls), F.lit(0)).alias("calls"), F.count_if(F.col("outcome") == "repaired").alias("repaired"), F.count_if(F.col("outcome") == "failed").alias("failed")))
    out = None
    for part in parts:
        row = part.withColumn("_one", F.lit(1))
        out = row if out is None else out.join(row, "_one")
    return out.drop("_one")


def reparsed(claims: DataFrame, fiscal_start: int = periods.FISCAL_START) -> DataFrame:
    """Parse period labels and units again. A label that says nothing now leaves the old period, a blank unit the old values."""
    units = claims.select("unit_raw").where("trim(unit_raw) <> ''").distinct().withColumn("_unit", parse_unit(F.col("unit_raw"))).withColumn("_has_unit", F.lit(True))
    dated = periods.with_period(claims.join(units, "unit_raw", "left"), "period_label", "_period", fiscal_start)
    again, unit = F.col("_period").isNotNull(), F.col("_has_unit").isNotNull()
    new = {
        "period_start": F.when(again, F.col("_period.start")).otherwise(F.col("period_start")), "period_end": F.when(again, F.col("_period.end")).otherwise(F.col("period_end")),
        "dimension": F.when(unit, F.col("_unit.dimension")).otherwise(F.col("dimension")), "currency": F.when(unit, F.col("_unit.currency")).otherwise(F.col("currency")),
        "canonical_low": F.when(unit, canonicalise(F.col("low"), F.col("_unit"))).otherwise(F.col("canonical_low")), "canonical_high": F.when(unit, canonicalise(F.col("high"), F.col("_unit"))).otherwise(F.col("canonical_high")),
    }
    return conform(dated.withColumns(new), CLAIM)


def rebuild(claims: DataFrame, pages: DataFrame | None = None, cap: int | None = reconcile.BLOCK_CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without a model: (claims grounded and parsed again, all their relations, counts of what changed).

    Claims of documents without pages keep their grounding. Measure keys stay; qualifiers that were dropped stay dropped.
    """
    checked = claims
    if pages is not None:
        there = pages.select("doc_id").distinct()
        active = claims.join(there, "doc_id", "left_semi").select(*claims.columns).withColumns({"status": F.lit("active"), "quarantine_reason": F.lit(None).cast("string")})
        checked = ground.ground(active, pages).unionByName(claims.join(there, "doc_id", "left_anti").select(*claims.columns))
    now = checkpointed(reparsed(checked))
    before = claims.select("id", *(F.col(c).alias(f"_{c}") for c in ("status", "period_start", "period_end", "canonical_low")))
    other = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    changed = now.join(before, "id").agg(F.count("*").alias("claims"), F.count_if(other("status")).alias("status_changed"), F.count_if(other("period_start") | other("period_end")).alias("period_changed"), F.count_if(other("canonical_low")).alias("unit_changed"))
    return now, reconcile.reconcile(now, cap), changed


def refresh_subjects(claims: DataFrame, documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Where a document's subject changes, claims that had the old one by inheritance get the new one."""
    old = documents.select(F.col("doc_id").alias("_doc"), F.col("subject").alias("_old"))
    new = profiles.select(F.col("doc_id").alias("_doc"), F.col("subject").alias("_new")).where("trim(_new) <> ''")
    joined = claims.join(old.join(new, "_doc"), F.col("doc_id") == F.col("_doc"), "left")
    stale = F.coalesce(normalise_subject(F.col("subject_raw")) == normalise_subject(F.col("_old")), F.lit(False)) & F.col("_new").isNotNull()
    out = joined.withColumn("subject_raw", F.when(stale, F.col("_new")).otherwise(F.col("subject_raw")))
    return out.withColumn("subject_key", normalise_subject(F.col("subject_raw"))).select(*claims.columns)
