"""Checking claims against the pages that they cite: is the quote there, and are the qualifiers?"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from claimweave.functions.text import with_norm_text

MIN_QUOTE, MIN_COVERAGE = 8, 0.85
TOKEN = r"(?U)([\w][\w.,%/&'-]*)"
# How pages write each qualifier.
ALIASES = {
    "adjusted": ("adjusted", "adj.", "adj ", "normalised", "normalized"), "reported": ("reported", "as reported", "reported basis"), "restated": ("restated", "restatement"),
    "audited": ("audited",), "unaudited": ("unaudited",), "provisional": ("provisional",), "consolidated": ("consolidated", "consolidation", "group"),
    "standalone": ("standalone", "stand-alone", "stand alone", "separate", "parent"), "projection": ("projection", "projected", "forecast", "expected"),
    "estimate": ("estimate", "estimated", "advance estimate"), "actual": ("actual", "actuals"),
}
QUALIFIERS = ("scope", "basis", "estimate_type")


def _tokens(quote: Column) -> Column:
    return F.regexp_extract_all(quote, F.lit(TOKEN), F.lit(1))


def _walk(quote: Column, page: Column) -> Column:
    """struct<matched, cursor, first>: characters of the quote's tokens that the page holds in this order, the place
    behind the last of them and that of the first, counted from 1; missing tokens are passed over."""
    start = F.struct(F.lit(0).alias("matched"), F.lit(1).alias("cursor"), F.lit(0).alias("first"))

    def step(state: Column, token: Column) -> Column:
        at = F.call_function("locate", token, page, state["cursor"])
        moved = F.struct((state["matched"] + F.length(token)).alias("matched"), (at + F.length(token)).alias("cursor"), F.when(state["first"] == 0, at).otherwise(state["first"]).alias("first"))
        return F.when(at > 0, moved).otherwise(state)

    return F.aggregate(_tokens(quote), start, step)


def token_coverage(quote: Column, page: Column) -> Column:
    """The share of the quote's tokens, by length, that the page holds in this order."""
    total = F.aggregate(_tokens(quote), F.lit(0), lambda n, t: n + F.length(t))
    return F.coalesce(F.try_divide(_walk(quote, page)["matched"], total), F.lit(0.0))


def token_span(quote: Column, page: Column) -> Column:
    """struct<char_start, char_end> from the first token that the page holds to the end of the last."""
    walked = _walk(quote, page)
    return F.struct((walked["first"] - 1).cast("int").alias("char_start"), (walked["cursor"] - 1).cast("int").alias("char_end"))


def grounding(quote: Column, text: Column, norm_quote: Column, norm_text: Column) -> Column:
    """unverifiable (too short to show anything), exact, fuzzy, gapped or not_found; the costly test comes last."""
    clean = F.regexp_replace(F.coalesce(quote, F.lit("")), r"(?U)^\s+|\s+$", "")
    return (
        F.when(F.length(clean) < MIN_QUOTE, "unverifiable")
        .when(F.contains(text, clean), "exact")
        .when((norm_quote != "") & F.contains(norm_text, norm_quote), "fuzzy")
        .when(token_coverage(norm_quote, norm_text) >= MIN_COVERAGE, "gapped")
        .otherwise("not_found")
    )


def qualifier_supported(value: Column, norm_text: Column) -> Column:
    """The page has the qualifier, or another spelling of it or of one of its words."""
    v = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    tokens = F.array_union(F.array(v), F.split(v, r"(?U)\s+"))
    known = F.lit(False)
    for name, aliases in ALIASES.items():
        on_page = F.lit(False)
        for alias in aliases:
            on_page = on_page | F.contains(norm_text, F.lit(alias))
        known = known | (F.arrays_overlap(tokens, F.array(*(F.lit(x) for x in {name: None, **dict.fromkeys(aliases)}))) & on_page)
    return F.coalesce((v != "") & (F.contains(norm_text, v) | known), F.lit(False))


def longest_block(quote: str, text: str) -> tuple[int, int]:
    """(place in text, length) of the longest block that both hold; of equal ones the first in quote, then in text.

    If they share a block they share shorter ones too, so the length is found by halving.
    """
    place = lambda n: next((at for i in range(len(quote) - n + 1) if (at := text.find(quote[i : i + n])) >= 0), -1)
    low, high = 0, len(quote)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if place(middle) >= 0 else (low, middle - 1)
    return place(low), low


@F.pandas_udf(StructType().add("char_start", IntegerType()).add("char_end", IntegerType()))
def anchor(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    """The place of the longest common block of at least 8 characters, to highlight quotes that aren't exact; else null."""
    found = []
    for q, t in zip(quote, text, strict=True):
        at, size = longest_block(q, t) if q and t else (0, 0)
        found.append((at, at + size) if size >= MIN_QUOTE else (None, None))
    return pd.DataFrame(found, columns=["char_start", "char_end"]).astype("Int32")


def ground(claims: DataFrame, pages: DataFrame, highlight: bool = True) -> DataFrame:
    """Set grounding, offsets, status, reason and qualifiers of claims by their pages (doc_id, page_no, text).

    A claim whose page isn't there, whose quote isn't on it or is too short to verify is quarantined with a reason. A
    scope, basis or estimate type that the page doesn't say becomes null and is kept in extra as dropped_<name>.
    Pages are unique by doc_id and page_no. highlight also looks for offsets of quotes that aren't exact: those of the
    longest block that quote and page share, or for gapped quotes without one, from the first token that was found to
    the end of the last, in the folded text.
    """
    page = with_norm_text(pages.select(F.col("doc_id").alias("_doc"), F.col("page_no").alias("_page"), F.col("text").alias("_text")), "_text", "_norm")
    quoted = with_norm_text(claims.withColumn("_quote", F.coalesce("quote", F.lit(""))), "_quote", "_norm_quote")
    joined = quoted.join(page, (F.col("doc_id") == F.col("_doc")) & (F.col("page_no") == F.col("_page")), "left")
    clean = F.regexp_replace("_quote", r"(?U)^\s+|\s+$", "")
    found = joined.withColumn("grounding", F.when(F.col("_page").isNotNull(), grounding(F.col("_quote"), F.col("_text"), F.col("_norm_quote"), F.col("_norm"))))
    good = F.coalesce(F.col("grounding").isin("exact", "fuzzy", "gapped"), F.lit(False))
    reason = (
        F.when(F.col("_page").isNull(), F.concat(F.lit("cited page "), F.coalesce(F.col("page_no").cast("string"), F.lit("?")), F.lit(" not in document")))
        .when(F.col("grounding") == "unverifiable", F.concat(F.lit("evidence too short to verify: '"), F.substring(clean, 1, 60), F.lit("'")))
        .when(F.col("grounding") == "not_found", F.concat(F.lit("quote not found on the page it cites: '"), F.substring("_quote", 1, 120), F.lit("'")))
    )
    at = F.call_function("locate", clean, F.col("_text")) - 1
    exact = F.col("grounding") == "exact"
    out = found.withColumns({"char_start": F.when(exact, at).cast("int"), "char_end": F.when(exact, at + F.length(clean)).cast("int"), "status": F.when(reason.isNull(), F.col("status")).otherwise("quarantined"), "quarantine_reason": reason})
    bad = {q: good & (F.coalesce(F.col(q), F.lit("")) != "") & ~qualifier_supported(F.col(q), F.col("_norm")) for q in QUALIFIERS}
    out = out.withColumns({f"_bad_{q}": b for q, b in bad.items()})
    dropped = F.map_filter(F.map_from_arrays(F.array(*(F.lit(f"dropped_{q}") for q in QUALIFIERS)), F.array(*(F.when(F.col(f"_bad_{q}"), F.col(q)) for q in QUALIFIERS))), lambda _, v: v.isNotNull())
    extra = F.coalesce("extra", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    extra = F.map_concat(F.map_filter(extra, lambda k, _: ~F.map_contains_key(dropped, k)), dropped)
    out = out.withColumns({"extra": extra, **{q: F.when(~F.col(f"_bad_{q}"), F.col(q)) for q in QUALIFIERS}})
    if highlight:
        sought = lambda c: F.when(F.col("grounding").isin("fuzzy", "gapped"), F.col(c))
        out = out.withColumn("_anchor", anchor(sought("_quote"), sought("_text")))
        out = out.withColumn("_span", F.when((F.col("grounding") == "gapped") & F.col("_anchor.char_start").isNull(), token_span(F.col("_norm_quote"), F.col("_norm"))))
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_anchor.{c}"), F.col(f"_span.{c}")) for c in ("char_start", "char_end")})
    return out.select(*claims.columns)


def report(grounded: DataFrame) -> DataFrame:
    """One row: counts by outcome, the rate of claims that are neither absent nor unverifiable, and dropped qualifiers."""
    is_ = lambda s: F.count_if(F.col("grounding") == s)
    dropped = F.size(F.filter(F.map_keys("extra"), lambda k: F.startswith(k, F.lit("dropped_"))))
    bad = is_("not_found") + is_("unverifiable")
    return grounded.agg(
        F.count("*").alias("total"), is_("exact").alias("exact"), is_("fuzzy").alias("fuzzy"), is_("gapped").alias("gapped"), is_("not_found").alias("not_found"), is_("unverifiable").alias("unverifiable"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"), F.coalesce(F.sum(dropped), F.lit(0)).alias("qualifiers_dropped"),
        F.round(F.coalesce(F.try_divide(F.count("*") - bad, F.count("*")), F.lit(0.0)), 4).alias("grounding_rate"),
    )


def dropped_qualifiers(claims: DataFrame, most: int | None = None) -> DataFrame:
    """(qualifier, value, n) of qualifiers that pages didn't support, the most frequent first."""
    out = claims.select(F.explode("extra").alias("key", "value")).where("key like 'dropped!_%' escape '!'").groupBy(F.expr("substring(key, 9)").alias("qualifier"), "value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "qualifier", "value")
    return out if most is None else out.limit(most)
