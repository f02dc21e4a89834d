"""From model responses to claims. The model is a function that is given prompts; all else is done here by columns.

Requests are rows with a key. Responses that the cache table holds are joined; only the others are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import periods
from claimweave.functions.schema import CLAIM, conform
from claimweave.functions.units import canonicalise, parse_unit
from claimweave.sources.store import checkpointed

#: What a model is shown and may answer, unless a call says otherwise; None lifts a limit.
CLAIMS_PER_PAGE, PAGE_CHARS, PROFILE_PAGES, PROFILE_CHARS = 20, 9_000, 3, 9_000
RAW_CLAIM = "struct<subject: string, measure: string, value_kind: string, value: string, value_high: string, unit: string, text_value: string, date_value: string, bool_value: string, period: string, scope: string, basis: string, as_of: string, estimate_type: string, quote: string, confidence: string>"
PROFILE = "publisher string, subject string, doc_type string, as_of_date string, default_period string, default_scope string, default_unit string, default_currency string"

CLAIM_PROMPT = "List the factual claims on this page as JSON: an object with a list named claims, of at most 20 objects. Each names its subject and measure, gives the value with its unit, period, scope, basis and estimate type as the page states them, and quotes the words that state it. Leave out what the page does not state.\n\n"
PROFILE_PROMPT = "Describe the document that begins so as a JSON object: publisher, subject (whom its figures are about), doc_type, as_of_date, and the default_period, default_scope, default_unit and default_currency that hold where a page states none.\n\n"


#: Stands before what was wrong with a reply when it is asked for again.
REPAIR_PROMPT = "\n\nThe last reply to this can't be used: "
REPAIR_END = ". Reply with JSON of the form that was asked for, and nothing else."


def request_key(prompt: Column, model: str, **options) -> Column:
    """A hash of all that a response depends on."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("prompt"), *(F.lit(str(v)).alias(k) for k, v in sorted(options.items())))), 256)


def no_json(response: Column) -> Column:
    """What is wrong with a reply that should hold JSON; null if nothing is."""
    return F.when(salvage_json(response).isNull(), "there is no JSON in it")


def no_profile(response: Column) -> Column:
    found = salvage_json(response)
    return F.when(found.isNull(), "there is no JSON in it").when(~F.startswith(F.ltrim(found), F.lit("{")), "the JSON is no object")


def no_claims(response: Column) -> Column:
    """What is wrong with a page's reply: it must list claims that all have a measure and a quote."""
    listed = F.from_json(salvage_json(response), f"claims array<{RAW_CLAIM}>")["claims"]
    return no_profile(response).when(listed.isNull(), "there is no list named claims").when(~F.forall(listed, _full), "a claim lacks its measure or its quote")


def _full(c: Column) -> Column:
    return (F.trim(F.coalesce(c["measure"], F.lit(""))) != "") & (F.trim(F.coalesce(c["quote"], F.lit(""))) != "")


def ask(requests: DataFrame, cache: DataFrame, provider: Callable[[str], str | None] | None, problem: Callable[[Column], Column] = no_json) -> DataFrame:
    """(key, prompt, ...) with response and outcome: from cache, else from provider, which runs in the tasks.

    problem: from a reply to what is wrong with it, null if it is valid. An invalid reply is asked for once more, with
    what was wrong in the prompt. outcome is cached, first or repaired for valid responses; failed if the second reply
    is invalid too or missing; unanswered if there is no reply, or no provider: then the response is null. Requests of
    one key are asked for once. replies() has what is to be kept.
    """
    held = requests.join(cache.select("key", F.col("response").alias("_held")).dropDuplicates(["key"]), "key", "left")
    state = lambda said, kind: F.when(F.col("_held").isNotNull(), "cached").otherwise(F.coalesce(kind, F.lit("unanswered")))
    if provider is None:
        return held.withColumns({"response": F.col("_held"), "outcome": state(None, F.lit(None).cast("string"))}).drop("_held")
    missing = checkpointed(requests.join(cache.where("response is not null"), "key", "left_anti").select("key", "prompt").dropDuplicates(["key"]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "answer": [provider(p) for p in frame["prompt"]]})

    replies = lambda asked: checkpointed(asked.mapInPandas(run, "key string, answer string")).withColumn("wrong", problem(F.col("answer")))
    first = checkpointed(replies(missing))
    bad = first.where("answer is not null and wrong is not null").select("key", "wrong")
    again = missing.join(bad, "key").select("key", F.concat("prompt", F.lit(REPAIR_PROMPT), "wrong", F.lit(REPAIR_END)).alias("prompt"))
    second = replies(again).select("key", F.when(F.col("wrong").isNull(), F.col("answer")).alias("answer"), F.when(F.col("answer").isNotNull() & F.col("wrong").isNull(), "repaired").otherwise("failed").alias("kind"))
    good = first.where("answer is not null and wrong is null").select("key", "answer", F.lit("first").alias("kind"))
    found = held.join(checkpointed(good.unionByName(second)), "key", "left")
    return found.withColumns({"response": F.coalesce("_held", "answer"), "outcome": state(F.col("answer"), F.col("kind"))}).drop("_held", "answer", "kind")


def replies(answered: DataFrame) -> DataFrame:
    """(key, response) of fresh valid responses: what enters the cache."""
    return answered.where(F.col("outcome").isin("first", "repaired")).select("key", "response").dropDuplicates(["key"])


def salvage_json(text: Column) -> Column:
    """The JSON in a response, as text: all of it, a fenced block, from the first { to the last }, or from [ to ]; else null."""
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    outer = lambda a, b: F.regexp_extract(text, rf"(?s)(\{a}.*\{b})", 1)
    return F.coalesce(*(valid(F.nullif(t, F.lit(""))) for t in (clean, fenced, outer("{", "}"), outer("[", "]"))))


def _start(text: Column, most: int | None) -> Column:
    return text if most is None else F.substring(text, 1, most)


def profile_requests(pages: DataFrame, model: str, most_pages: int = PROFILE_PAGES, most_chars: int | None = PROFILE_CHARS) -> DataFrame:
    """One request for each document, with the text of its first pages."""
    first = pages.where(F.col("page_no") <= most_pages).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    prompt = F.concat(F.lit(PROFILE_PROMPT), _start(F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n"), most_chars))
    return first.select("doc_id", prompt.alias("prompt"), request_key(prompt, model).alias("key"))


def profiles(answered: DataFrame) -> DataFrame:
    """(doc_id, profile columns); a response that isn't an object gives an empty profile."""
    p = F.from_json(salvage_json(F.col("response")), PROFILE)
    return answered.select("doc_id", p.alias("p")).select("doc_id", "p.*").withColumn("as_of_date", lenient_date(F.col("as_of_date")))


def page_requests(pages: DataFrame, model: str, most_chars: int | None = PAGE_CHARS) -> DataFrame:
    prompt = F.concat(F.lit(CLAIM_PROMPT), _start(F.coalesce("text", F.lit("")), most_chars))
    return pages.select("doc_id", "page_no", "printed_page", prompt.alias("prompt"), request_key(prompt, model).alias("key"))


def lenient_date(text: Column) -> Column:
    """The date that the first ten characters are, else null."""
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")


def raw_claims(answered: DataFrame, most: int | None = CLAIMS_PER_PAGE) -> tuple[DataFrame, DataFrame]:
    """(claims, rejected responses). A page's response counts if it lists claims that all have a measure and a quote; the first most of a page are taken."""
    listed = F.from_json(salvage_json(F.col("response")), f"claims array<{RAW_CLAIM}>")["claims"]
    read = checkpointed(answered.withColumn("_claims", listed).withColumn("_valid", F.coalesce(F.forall("_claims", _full), F.lit(False))))
    rows = read.where("_valid").select("doc_id", "page_no", "printed_page", F.posexplode("_claims" if most is None else F.slice("_claims", 1, most)).alias("ordinal", "c"))
    return rows, read.where("response is not null and not _valid").select("doc_id", "page_no", "response")


def _number(text: Column) -> Column:
    """JSON's true counts as 1 and false as 0."""
    return F.coalesce(F.when(text == "true", F.lit(1.0)), F.when(text == "false", F.lit(0.0)), text.try_cast("double"))


def build_claims(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims from raw ones, which inherit what they don't state from their document's profile.

    Numbers need a value; two different ones are a range, in either order. Unknown kinds are numbers if there is a
    value, else texts. A claim whose period names a day that doesn't exist is rejected. Ids are hashes of document,
    page, place and quote, so extracting a page again gives the same ids.
    """
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    profile = documents.select(F.col("doc_id"), F.col("subject").alias("p_subject"), *(F.col(f"default_{x}").alias(f"p_{x}") for x in ("period", "scope", "unit")), F.col("as_of_date").alias("p_as_of"))
    joined = rows.join(profile, "doc_id", "left")
    value, high = _number(F.col("c.value")), _number(F.col("c.value_high"))
    kind = F.when(F.lower("c.value_kind").isin("number", "range", "text", "boolean", "date"), F.lower("c.value_kind")).when(value.isNotNull(), "number").otherwise("text")
    # Written here: it is read twice, and one stage with all that follows would be too large to compile.
    base = checkpointed(joined.withColumns({"_low": value, "_high": F.coalesce(high, value), "_kind": kind}))
    numeric = F.col("_kind").isin("number", "range")
    base = base.where(~numeric | F.col("_low").isNotNull()).withColumns({
        "low": F.when(numeric, F.least("_low", "_high")), "high": F.when(numeric, F.greatest("_low", "_high")), "value_kind": F.when(numeric, F.when(F.col("_low") != F.col("_high"), "range").otherwise("number")).otherwise(F.col("_kind")),
        "unit_raw": F.when(numeric, F.coalesce(said(F.col("c.unit")), "p_unit")), "period_label": F.coalesce(said(F.col("c.period")), "p_period"),
    })
    units = base.select("unit_raw").where("unit_raw is not null").distinct().withColumn("_unit", parse_unit(F.col("unit_raw")))
    dated = periods.with_period(base.join(units, "unit_raw", "left"), "period_label", "_period").where(~periods.is_impossible(F.col("period_label")))
    confidence = F.least(F.greatest(F.coalesce(F.col("c.confidence").try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    out = dated.select(
        F.substring(F.sha2(F.concat_ws("|", "doc_id", F.col("page_no").cast("string"), F.col("ordinal").cast("string"), "c.quote"), 256), 1, 16).alias("id"), "doc_id", "page_no", "printed_page",
        F.coalesce(said(F.col("c.subject")), "p_subject", F.lit("unknown")).alias("subject_raw"), F.trim("c.measure").alias("measure_raw"), "value_kind", "low", "high", "unit_raw",
        F.col("_unit.dimension").alias("dimension"), F.col("_unit.currency").alias("currency"), canonicalise(F.col("low"), F.col("_unit")).alias("canonical_low"), canonicalise(F.col("high"), F.col("_unit")).alias("canonical_high"),
        F.when(F.col("value_kind") == "text", F.coalesce(said(F.col("c.text_value")), said(F.col("c.value")))).alias("text_value"), F.when(F.col("value_kind") == "date", F.coalesce(lenient_date(F.col("c.date_value")), lenient_date(F.col("c.value")))).alias("date_value"),
        F.when(F.col("value_kind") == "boolean", F.coalesce(F.col("c.bool_value").try_cast("boolean"), F.col("c.value").try_cast("boolean"))).alias("bool_value"), "period_label", F.col("_period.start").alias("period_start"), F.col("_period.end").alias("period_end"),
        F.coalesce(said(F.col("c.scope")), "p_scope").alias("scope"), said(F.col("c.basis")).alias("basis"), F.coalesce(lenient_date(F.col("c.as_of")), "p_as_of").alias("as_of"), said(F.col("c.estimate_type")).alias("estimate_type"),
        F.col("c.quote").alias("quote"), confidence.alias("confidence"),
    )
    return conform(out, CLAIM)
