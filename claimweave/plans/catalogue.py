"""The queries of the claim engine by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import periods, scope
from claimweave.functions.schema import CLAIM, DOCUMENT, conform
from claimweave.functions.text import normalise_measure, normalise_subject
from claimweave.functions.units import canonicalise, parse_unit
from claimweave.operators import extract, ground, reconcile, registry, triage
from claimweave.plans import oracles as sql
from claimweave.plans import changes, paging, pipeline, views
from claimweave.plans.samples import balance_claims, event_claims, ledger_claims, order_answers, revenue_claims, ruled_pairs, table
from claimweave.sources.pages import page_lookup, read_text_documents
from claimweave.sources.store import Store, checkpointed, merged, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(sql.UNITS)
def q_units_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts in units that change from part to part."""
    units = F.array(*(F.lit(u) for u, *_ in sql.UNIT_ROWS))
    priced = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("value"), F.get(units, (F.col("p_partkey") % len(sql.UNIT_ROWS)).cast("int")).alias("unit_raw"))
    parsed = priced.select("unit_raw").distinct().withColumn("u", parse_unit(F.col("unit_raw")))
    return priced.join(parsed, priced["unit_raw"].eqNullSafe(parsed["unit_raw"])).select("p_partkey", "u.dimension", "u.base", "u.currency", canonicalise(F.col("value"), F.col("u")).alias("canonical"))


@query(sql.PERIODS)
def q_period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written as periods in nine ways, and parsed."""
    d, fy = F.col("day"), F.year(F.add_months("day", 9)).cast("string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    year, half = F.year(d).cast("string"), F.when(F.month(d) <= 6, "1").otherwise("2")
    forms = [
        F.concat(F.lit("FY"), fy), F.concat(F.lit("Q"), F.quarter(F.add_months(d, 9)).cast("string"), F.lit(" FY"), fy), F.concat(year, F.lit("Q"), F.quarter(d).cast("string")), year,
        F.concat(F.lit("as at "), F.date_format(d, "MMMM d, yyyy")), F.concat(F.lit("quarter ended "), F.date_format(d, "d MMM yyyy")), F.concat(F.lit("H"), half, F.lit(" "), year),
        F.concat((fy.cast("int") - 1).cast("string"), F.lit("-"), F.substring(fy, 3, 2)), F.concat(F.lit("April-"), F.date_format(d, "MMMM yyyy")),
    ]
    labelled = orders.withColumn("label", F.get(F.array(*forms), (F.col("o_orderkey") % len(forms)).cast("int")))
    return periods.with_period(labelled, "label").select("o_orderkey", F.col("period.start").cast("string").alias("start"), F.col("period.end").cast("string").alias("end"))


@query(sql.RELATES)
def q_period_relate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of an order's date to its fiscal quarter."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    fy = F.year(F.add_months("day", 9)).cast("string")
    labelled = orders.select("o_orderkey", F.concat(F.lit("FY"), fy).alias("a"), F.when(F.col("o_orderkey") % 2 == 0, F.year("day").cast("string")).otherwise(F.concat(F.lit("Q"), F.quarter(F.add_months("day", 9)).cast("string"), F.lit(" FY"), fy)).alias("b"))
    both = periods.with_period(periods.with_period(labelled, "a", "pa"), "b", "pb")
    return both.select("o_orderkey", periods.relate(F.col("pa"), F.col("pb")).alias("rel"), periods.relate(F.col("pb"), F.col("pa")).alias("reverse"))


@query(sql.SCOPES)
def q_scope_relate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' market segments as scopes, against named scopes."""
    names = F.array(*(F.lit(s) for s in sql.SCOPE_NAMES))
    pairs = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("a"), F.get(names, (F.col("c_custkey") % len(sql.SCOPE_NAMES)).cast("int")).alias("b"))
    return pairs.select("c_custkey", scope.relate_scope(F.col("a"), F.col("b")).alias("rel"), scope.relate_scope(F.col("b"), F.lit("Consolidated")).alias("to_group"))


@query(sql.PAIRS)
def q_reconcile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(revenue_claims(spark, sf_dir)).select("claim_a_id", "claim_b_id", "verdict", "confidence", "cross_doc")


@query(sql.VERDICTS)
def q_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.counts(reconcile.reconcile(revenue_claims(spark, sf_dir)), "verdict")


@query(sql.NEGATIVE)
def q_negative_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.negative_measures(balance_claims(spark, sf_dir))


@query(sql.VIOLATIONS)
def q_containment_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters stated three times too high: those above their year."""
    claims = revenue_claims(spark, sf_dir)
    raised = claims.withColumns({c: F.when(F.col("doc_id") == "C", 3 * F.col(c)).otherwise(F.col(c)) for c in ("low", "high", "canonical_low", "canonical_high")})
    return reconcile.outlined(raised).where(F.col("outcomes")["period-containment"] == "fail").select("claim_a_id", "claim_b_id", "verdict")


@query(sql.CAPPED)
def q_block_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.capped(reconcile.with_blocks(revenue_claims(spark, sf_dir)), 20).select("id", "block_subject", "block_measure")


@query(sql.SUPERSEDES)
def q_supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(event_claims(spark, sf_dir)).select("claim_a_id", "claim_b_id", "verdict", "confidence")


@query(sql.INCREMENTAL)
def q_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarters as a new document; each first quarter was compared with its year before, and stored either way round."""
    claims = revenue_claims(spark, sf_dir)
    old, new = claims.where("doc_id <> 'C'"), claims.where("doc_id = 'C'")
    year, first = (df.select(F.col("id").alias(x), "subject_key", "period_start", F.month("period_end").alias(f"m_{x}")) for df, x in ((old.where("doc_id = 'A'"), "y"), (new, "q")))
    known = year.join(first, ["subject_key", "period_start"]).where("m_q = 6")
    even = F.pmod(F.xxhash64("y"), F.lit(2)) == 0
    seen = known.select(F.when(even, F.col("y")).otherwise(F.col("q")).alias("claim_a_id"), F.when(even, F.col("q")).otherwise(F.col("y")).alias("claim_b_id"))
    return reconcile.reconcile_incremental(new, old, seen).select("claim_a_id", "claim_b_id", "verdict")


@query(sql.REVIEW)
def q_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.relations(reconcile.reconcile(revenue_claims(spark, sf_dir)), limit=200).select("id", "claim_a_id", "claim_b_id", "verdict", "confidence", "cross_doc")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their sources."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "text")


@query(sql.SCORES)
def q_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.score_pages(_pages(spark, sf_dir)).select("page_no", "score")


@query(sql.TOP_PAGES)
def q_triage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.choose(triage.score_pages(_pages(spark, sf_dir)), budget=5).select("doc_id", "page_no")


@query(sql.COVERAGE)
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.coverage(triage.score_pages(_pages(spark, sf_dir)), by=("doc_id",))


@query(sql.PRINTED)
def q_printed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = F.when(F.col("page_no") % 3 == 0, F.concat("text", F.lit("\n\n "), (F.col("page_no") % 10000).cast("string"), F.lit(" \n"))).otherwise(F.col("text"))
    return _pages(spark, sf_dir).select("page_no", triage.printed_page(numbered).alias("printed_page"))


def _quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quotes from anywhere in each document: as they stand, with wider spaces, too short, with a gap and a foreign word, and invented."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), "text")
    number, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    at = (number * 7919 % F.greatest(F.length(text) - 150, F.lit(1)) + 1).cast("int")
    part = lambda start, n: F.substring(text, start, F.lit(n))
    kinds = [part(at, 60), F.replace(part(at, 60), F.lit(" "), F.lit("  ")), part(at, 5), F.concat(part(at, 40), F.lit(" zqxzq "), part(at + 60, 40)), F.concat(F.lit("zq"), F.md5("doc_id"), F.lit(" zq"), F.sha1("doc_id"))]
    quote = F.get(F.array(*kinds), (number % 5).cast("int"))
    claims = pages.select(F.col("doc_id").alias("id"), "doc_id", F.when(number % 37 == 0, 2).otherwise(1).alias("page_no"), quote.alias("quote"), F.lit("Group").alias("scope"), F.lit("audited").alias("basis"), F.when(number % 2 == 0, "forecast").alias("estimate_type"))
    return conform(claims, CLAIM), pages


@query(sql.GROUNDING)
def q_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("grounding") == "exact", F.col("char_start").cast("long")).otherwise(-1)
    return ground.ground(*_quotes(spark, sf_dir), highlight=False).select("id", "grounding", "status", place.alias("char_start"))


@query(sql.ANCHORS)
def q_quote_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each quote is highlighted: in whole if it is exact, else by the longest block that it shares with its page."""
    place = [F.col(c).cast("long").alias(c) for c in ("char_start", "char_end")]
    return ground.ground(*_quotes(spark, sf_dir), highlight=True).select("id", "grounding", *place)


#: Words in a row that a document must share with a passage to be checked for it, and the most shingles to broadcast.
SHINGLE, BROADCAST_SHINGLES = 8, 1_000_000


def _words(text: str) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _shingles(text: str, lengths: list[int]) -> Column:
    """All runs of words of these lengths in a whole text, which is split only once."""
    runs = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return F.flatten(F.transform(F.array(_words(text)), lambda w: F.concat(*(F.coalesce(runs(w, n), F.array().cast("array<string>")) for n in lengths))))


def passages_in(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of items and docs (id, text) that share a run of SHINGLE words anywhere; a shorter passage is one run."""
    sized = items.withColumn("n", F.least(F.lit(SHINGLE), F.size(_words("text")))).where("n > 0")
    lengths = sorted(r.n for r in sized.select("n").distinct().collect())  # SHINGLE values at most
    if not lengths:
        return items.select("item_id").limit(0).crossJoin(docs.select("doc_id").limit(0))
    of_items = checkpointed(sized.select("item_id", "n", F.explode(_shingles("text", lengths)).alias("shingle")).where(F.size(F.split("shingle", " ")) == F.col("n")).select("item_id", "shingle").distinct())
    if of_items.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES:
        of_items = F.broadcast(of_items)
    return docs.select("doc_id", F.explode(_shingles("text", lengths)).alias("shingle")).join(of_items, "shingle").select("item_id", "doc_id").distinct()


@query()
def q_grounding_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages without their third word, against the documents that share a run of words with them."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    elided = F.array_join(F.filter(F.split("text", " "), lambda _, i: i != 2), " ")
    quotes = items.select("item_id", elided.alias("quote"))
    found = passages_in(items, docs).join(quotes, "item_id").select(F.concat_ws("-", "item_id", "doc_id").alias("id"), "doc_id", F.lit(1).alias("page_no"), "quote").dropDuplicates(["id"])
    pages = docs.select("doc_id", F.lit(1).alias("page_no"), "text")
    return ground.ground(conform(found, CLAIM), pages).select("id", "grounding")


@query(sql.QUALIFIERS)
def q_qualifier_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifiers against part names that end in one of their spellings."""
    endings = F.array(*(F.lit(x) for x, *_ in sql.QUALIFIER_ROWS))
    values = F.array(*(F.lit(x[1]) for x in sql.QUALIFIER_ROWS))
    k = (F.col("p_partkey") % len(sql.QUALIFIER_ROWS)).cast("int")
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.get(endings, k)).alias("page"), F.get(values, k).alias("value"))
    return named.select("p_partkey", ground.qualifier_supported(F.col("value"), F.col("page")).alias("supported"))


@query(sql.MEASURES)
def q_measure_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalise_measure(F.concat(F.lit("FY24 Adjusted "), "p_name", F.lit(" ("), "p_type", F.lit("), Q1"))).alias("norm"))


@query(sql.SUBJECTS)
def q_subject_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Mr. "), "c_name")).otherwise(F.concat("c_name", F.lit(" Pvt. Ltd.")))
    return table(spark, sf_dir, "customer").select("c_custkey", normalise_subject(name).alias("norm"))


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))


@query(sql.CANDIDATES)
def q_trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name's two most alike ones."""
    forms = registry.named(_part_names(spark, sf_dir))
    return registry.candidates(forms, forms).select("norm", "candidate", F.round("similarity", 6).alias("similarity"), "rank")


@query(sql.MERGED)
def q_registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as they are and with their words turned round: each pair is one measure."""
    names = _part_names(spark, sf_dir)
    turned = names.select(F.array_join(F.reverse(F.split("name", " ")), " ").alias("name"), (F.col("ord") + 1_000_000_000).alias("ord"))
    measures, keys, _ = registry.resolve(names.unionByName(turned))
    return keys.select("name", "key")


@query(sql.LISTED)
def q_registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of q_registry_merge, written to JSON files, read again and listed."""
    names = _part_names(spark, sf_dir)
    turned = names.select(F.array_join(F.reverse(F.split("name", " ")), " ").alias("name"), (F.col("ord") + 1_000_000_000).alias("ord"))
    folder = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    registry.save_json(folder, registry.resolve(names.unionByName(turned))[0], spark.createDataFrame([], "a string, b string, same boolean"))
    return views.registry(registry.load_json(spark, folder)[0]).select("key", "canonical_name", "n_forms")


@query(sql.SUMMARY)
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = revenue_claims(spark, sf_dir)
    return views.summary(claims, reconcile.reconcile(claims))


@query(sql.MISSING)
def q_audit_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.audit(revenue_claims(spark, sf_dir).unionByName(balance_claims(spark, sf_dir)))["missing_qualifiers"]


@query(sql.GENERIC)
def q_audit_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.audit(balance_claims(spark, sf_dir))["generic_measures"]


@query(sql.STATUS)
def q_audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    grounded = ground.ground(*_quotes(spark, sf_dir), highlight=False)
    return views.audit(grounded)["by_status"].select("status", "grounding", "n")


@query(sql.GROUNDING_REPORT)
def q_grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.report(ground.ground(*_quotes(spark, sf_dir), highlight=False))


@query(sql.DROPPED)
def q_dropped_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.dropped_qualifiers(ground.ground(*_quotes(spark, sf_dir), highlight=False))


@query(sql.HIGHLIGHTS)
def q_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.highlights(reconcile.outlined(revenue_claims(spark, sf_dir))).select("case", "claim_a_id", "claim_b_id")


@query(sql.REFRESHED)
def q_refresh_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = revenue_claims(spark, sf_dir)
    old = spark.createDataFrame([("A", "SUPPLIER#000000001 Ltd")], "doc_id string, subject string")
    new = spark.createDataFrame([("A", "Renamed Works")], "doc_id string, subject string")
    return pipeline.refresh_subjects(claims, old, new).select("id", "subject_raw", "subject_key")


@query(sql.REBUILT)
def q_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose parsed columns were lost, parsed again from their labels."""
    claims = revenue_claims(spark, sf_dir)
    blank = claims.withColumns({c: F.lit(None).cast(claims.schema[c].dataType) for c in ("period_start", "period_end", "canonical_low", "canonical_high", "dimension", "currency")})
    return pipeline.reparsed(blank).select("id", F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"), "canonical_low", "dimension", "currency")


@query(sql.SALVAGED)
def q_json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn numbers in JSON in four wrappings."""
    body = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}"))
    k = F.col("conv_id") % 4
    wrapped = F.when(k == 0, body).when(k == 1, F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```\nend"))).when(k == 2, F.concat(F.lit("x "), body, F.lit(" y"))).otherwise("none")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get_json_object(extract.salvage_json(wrapped), "$.turn").alias("found"))


@query(sql.RECALL)
def q_triage_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of some documents, and words that none holds, among the pages that a budget leaves of each source."""
    pages = _pages(spark, sf_dir)
    needle = F.when(F.col("page_no") % 2 == 0, F.substring("text", 5, 24)).otherwise(F.concat(F.lit("absent "), F.col("page_no").cast("string")))
    needles = pages.where("page_no % 101 = 0 and length(text) > 40").select("doc_id", needle.alias("needle"))
    return triage.triage_recall(triage.score_pages(pages), needles, budgets=(5, 20, None))


@query(sql.BUILT)
def q_claim_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from responses on orders: valid, wrapped, damaged, without a quote, with too many claims; what they leave out is inherited."""
    answers, documents = order_answers(spark, sf_dir)
    rows, _ = extract.raw_claims(answers)
    shown = extract.build_claims(rows, documents)
    return shown.select("doc_id", "page_no", "measure_raw", "value_kind", "low", "high", "unit_raw", "dimension", "subject_raw", "scope", F.col("date_value").cast("string").alias("date_value"), F.col("period_start").cast("string").alias("period_start"), F.col("as_of").cast("string").alias("as_of"), "confidence")


@query(sql.REJECTED)
def q_rejected_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.raw_claims(order_answers(spark, sf_dir)[0])[1].select("doc_id", "page_no")


@query(sql.RULED)
def q_decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of claims that differ in one respect after the other, so that each rule of the verdict decides some."""
    a, b, negative = ruled_pairs(spark, sf_dir)
    return reconcile.reconcile_pair(a, b, negative).select("claim_a_id", "claim_b_id", "verdict", "confidence")


@query(sql.UPSERTED)
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were stored, changed twice and added to: file names stay as they were first."""
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    row = lambda df, tag: conform(df.select(F.col("k").cast("string").alias("doc_id"), F.concat(F.lit(f"{tag}-"), F.col("k").cast("string")).alias("filename"), F.concat(F.lit(f"{tag} "), "s").alias("title")), DOCUMENT)
    changes = [first, first.where("k % 3 = 0"), first.where("k % 5 = 0").unionByName(first.where("k % 7 = 0").withColumn("k", F.col("k") + 1_000_000))]
    return merged([row(df, f"v{n}") for n, df in enumerate(changes)], "documents").select("doc_id", "filename", "title")


@query(sql.BY_ID)
def q_claims_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").select(F.concat(F.lit("A-"), F.col("n_nationkey").cast("string"), F.lit("-FY1996")).alias("id"))
    return views.claims_by_id(revenue_claims(spark, sf_dir), wanted).select("id", "doc_id", "low")


@query(sql.CONTRADICTIONS)
def q_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contradictions between years and quarters that are stated three times too high."""
    claims = revenue_claims(spark, sf_dir)
    raised = checkpointed(claims.withColumns({c: F.when(F.col("doc_id") == "C", 3 * F.col(c)).otherwise(F.col(c)) for c in ("low", "high", "canonical_low", "canonical_high")}))
    return views.contradictions(reconcile.reconcile(raised), raised).select("claim_a_id", "claim_b_id", "a_measure_raw", "a_doc_id", "b_doc_id", "a_period_label", "b_period_label", "a_scope", "b_scope")


@query(sql.DECIDED)
def q_registry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, and each with a word more: every other pair was decided to be the same measure."""
    names = _part_names(spark, sf_dir)
    longer = names.select(F.concat("name", F.lit(" net")).alias("name"), (F.col("ord") + 1_000_000_000).alias("ord"))
    decisions = names.select(F.col("name").alias("a"), F.concat("name", F.lit(" net")).alias("b"), (F.col("ord") % 2 == 0).alias("same"))
    _, keys, _ = registry.resolve(names.unionByName(longer), decisions)
    return keys.select("name", "key")


@query(sql.LOOKED_UP)
def q_page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that labels cite, some of which don't exist."""
    pages = _pages(spark, sf_dir).withColumn("printed_page", triage.printed_page(F.col("text")))
    cited = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled")).join(pages.select(F.col("page_no").alias("p"), F.col("doc_id").alias("source")), F.col("labelled") == F.col("p")).select(F.col("source").alias("doc_id"), (F.col("p") + F.when(F.col("p") % 4 == 0, 10_000_000).otherwise(0)).alias("page_no"))
    return page_lookup(cited, pages).select("doc_id", "page_no", F.length("text").cast("long").alias("chars"))


@query(sql.QUARANTINED)
def q_quarantine_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quarantined claims with the names of their documents."""
    claims, pages = _quotes(spark, sf_dir)
    documents = pages.where("doc_id % 2 = 0").select("doc_id", F.concat("doc_id", F.lit(".txt")).alias("filename"))
    return views.quarantine_case(ground.ground(claims, pages, highlight=False), documents)["quarantined"].select("id", "document", "grounding", "quarantine_reason")


@query(sql.PROFILES)
def q_profile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the profiles of conversations, whose first three turns are shown."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text")
    shown = extract.profile_requests(pages, "model", most_chars=None)
    return shown.select("doc_id", (F.length("prompt") - len(extract.PROFILE_PROMPT)).cast("long").alias("chars"))


@query(sql.PICKED)
def q_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of two requests the relation that a reader is shown."""
    found = views.picks(reconcile.outlined(revenue_claims(spark, sf_dir)), {
        "part": ("complementary", {"check": "period-containment", "outcomes": ("pass",)}),
        "same within": ("corroborates", {"cross_doc": False, "fall_back": True}), "same across": ("corroborates", {"cross_doc": True}),
    })
    return found.select(F.substring("case", 1, 4).alias("case"), "claim_a_id", "claim_b_id")


@query(sql.FOLLOWED)
def q_relations_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored relations after an ingest, another one, changed values, deleted claims, and a measure that turns negative later.

    Suppliers with an odd number state their revenue, the others their net result. They are those of a full run.
    """
    number = F.split("id", "-")[1].cast("long")
    even = number % 2 == 0
    claims = checkpointed(revenue_claims(spark, sf_dir).withColumns({"measure_raw": F.when(even, "Net result").otherwise(F.col("measure_raw")), "measure_key": F.when(even, "net_result").otherwise(F.col("measure_key"))}))
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    times = lambda factor: {c: factor * F.col(c) for c in ("low", "high", "canonical_low", "canonical_high")}
    changes.apply(store, claims.where("doc_id <> 'C'"))
    changes.apply(store, claims.where("doc_id = 'C'"))
    changes.apply(store, claims.where((F.col("doc_id") == "B") & (number % 7 == 0)).withColumns(times(1.5)).unionByName(claims.where((F.col("doc_id") == "C") & (number % 3 < 2)).withColumns(times(3.0))))
    changes.apply(store, claims.limit(0), claims.where((F.col("doc_id") == "C") & (number % 5 == 0)))
    loss = claims.where("measure_key = 'net_result'").orderBy("id").limit(1).withColumns({"id": F.lit("loss"), "subject_raw": F.lit("Elsewhere"), **times(-1.0)})
    changes.apply(store, loss)
    return store.read("relations", wanted=["verdict", "confidence", "cross_doc"]).select("claim_a_id", "claim_b_id", "verdict", "confidence", "cross_doc")


@query(sql.ASKED)
def q_request_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each page's request ended, by a stand-in for a model that answers by the length of the page; whole pages are shown.

    Replies for each fourth document are in the cache. By the length modulo 5, the stand-in's replies are valid, prose
    and then valid, without quotes twice, missing, or valid in a fence.
    """
    valid = '{"claims": [{"measure": "m", "quote": "q"}]}'
    requests = checkpointed(extract.page_requests(_pages(spark, sf_dir).withColumn("printed_page", F.lit(None).cast("string")), "stand-in", most_chars=None))
    cache = requests.where("page_no % 4 = 0").select("key", F.lit(valid).alias("response"))

    def provider(prompt: str) -> str | None:
        page, _, repair = prompt.removeprefix(extract.CLAIM_PROMPT).partition(extract.REPAIR_PROMPT)
        return (valid, valid if repair else "I can't.", '{"claims": [{"measure": "m"}]}', None, f"```json\n{valid}\n```")[len(page) % 5]

    return extract.ask(requests, cache, provider, extract.no_claims).select("page_no", "outcome", F.col("response").isNotNull().alias("answered"))


@query(sql.AUDITED)
def q_audit_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counting tables of the audit, from one pass over claims that have every fault."""
    found = views.audit(ledger_claims(spark, sf_dir))
    long = lambda name, a, n, b=F.lit(None), c=F.lit(None): found[name].select(F.lit(name).alias("audit"), a.cast("string").alias("a"), b.cast("string").alias("b"), c.cast("string").alias("c"), n.cast("long").alias("n"))
    col, n = F.col, F.col("n")
    missing = found["missing_qualifiers"].select(F.explode(F.array(*(F.struct(F.lit(x).alias("a"), col(x).alias("n")) for x in ("n", *(f"no_{q}" for q in views.MAY_MISS))))).alias("x"))
    parts = [
        long("by_status", col("status"), n, col("grounding"), col("value_kind")), missing.select(F.lit("missing_qualifiers"), "x.a", F.lit(None).cast("string"), F.lit(None).cast("string"), col("x.n").cast("long")),
        long("dropped_qualifiers", col("qualifier"), n, col("value")), long("unparsed_periods", col("period_label"), n), long("unknown_units", col("unit"), n), long("generic_measures", col("measure_key"), col("values")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query(sql.PAGED)
def q_deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages from the middle of the review queue: the first by its offset, the next by the cursor that the first ends with."""
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    found = reconcile.outlined(revenue_claims(spark, sf_dir)).drop("outcomes")
    paging.write_pages(found, path, file_rows=10_000)
    one = checkpointed(paging.page_at(spark, path, paging.total(spark, path) // 2, 100))
    cursor = one.orderBy(*(F.desc(k) for k in paging.KEYS)).first()
    two = paging.page_after(spark, path, cursor, 100)
    shown = ["id", "claim_a_id", "claim_b_id", "verdict", "confidence", "cross_doc"]
    return one.select(F.lit(1).alias("page"), *shown).unionByName(two.select(F.lit(2).alias("page"), *shown))


@query(sql.FROM_FILES)
def q_pages_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are written as text files with form feeds between them, and read again by chunks of 100,000 bytes."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.option("lineSep", "\f").text(folder)
    _, pages = read_text_documents(spark, folder, chunk=100_000)
    return pages.where("text <> ''").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("pages"), F.max(F.length("text")).cast("long").alias("chars"))
