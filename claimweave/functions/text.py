"""Text functions as column expressions: folding page text, measure, subject and scope names, similarity of names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
QUALIFIER_WORDS = ("adjusted", "adj", "reported", "restated", "audited", "unaudited", "provisional", "estimated", "projected", "normalised", "normalized", "consolidated", "standalone")
COMPANY_SUFFIXES = ("limited", "ltd", "private", "pvt", "plc", "inc", "incorporated", "corporation", "corp", "llp", "company", "co")
HONORIFICS = ("mr", "mrs", "ms", "dr", "shri", "smt", "prof")
#: Quotes, hyphens and dashes to their ASCII forms; the no-break space and the byte order mark.
FOLDED = str.maketrans({"\u2010": "-", "\u2011": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " ", "﻿": None})


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    """Compatibility composition, for which Spark has no function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(FOLDED))


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def needs_folding(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[^\x00-\x7F]"))


def fold_ascii(text: Column) -> Column:
    return F.lower(squeeze(text))


def with_norm_text(df, text_col: str = "text", out: str = "norm_text"):
    """Add the folded text. Only rows with characters beyond ASCII go through Python."""
    return df.withColumn(out, fold_ascii(F.when(needs_folding(F.col(text_col)), _fold(F.when(needs_folding(F.col(text_col)), F.col(text_col)))).otherwise(F.col(text_col))))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def normalise_measure(name: Column) -> Column:
    """A measure's name without periods, punctuation and qualifiers; if nothing is left, with them."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    plain = lambda s: words(F.regexp_replace(s, "[^a-z0-9 ]+", " "))
    kept = F.filter(plain(F.regexp_replace(lower, r"(?U)\b(fy\s?\d{2,4}|q[1-4]|h[12]|(?:19|20)\d{2})\b", " ")), lambda w: ~w.isin(*QUALIFIER_WORDS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(plain(lower)), " ")


def normalise_subject(name: Column) -> Column:
    """A subject's name without an honorific before it, punctuation and company suffixes; if nothing is left, as it is."""
    raw = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", "")
    plain = F.regexp_replace(F.lower(F.regexp_replace(raw, rf"(?iU)^\s*({'|'.join(HONORIFICS)})\.?\s+", "")), "[^a-z0-9 ]+", " ")
    out = F.array_join(words(F.regexp_replace(plain, rf"\b({'|'.join(COMPANY_SUFFIXES)})\b", " ")), " ")
    return F.coalesce(F.nullif(out, F.lit("")), F.lower(raw))  # out is computed once, which a condition on it would not


def normalise_scope(scope: Column) -> Column:
    """Null if nothing is left."""
    return F.nullif(F.array_join(words(F.regexp_replace(F.lower(scope), "[^a-z0-9 ]+", " ")), " "), F.lit(""))


def trigrams(text: Column) -> Column:
    """Distinct windows of three characters of the text with two spaces before and after it."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def bag(text: Column) -> Column:
    return F.array_distinct(words(text))


def similarity(a: Column, b: Column) -> Column:
    """The larger of the Jaccard similarities of trigrams and of words; 0 if a side is empty."""
    return similarity_of_sets((a, trigrams(a), bag(a)), (b, trigrams(b), bag(b)))


def similarity_of_sets(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """The same for texts whose trigrams and distinct words are there already: each side is (text, trigrams, words)."""
    both = F.size(F.array_intersect(a[2], b[2]))
    close = F.greatest(jaccard(a[1], b[1]), F.coalesce(F.try_divide(both, F.size(a[2]) + F.size(b[2]) - both), F.lit(0.0)))
    return F.when((F.coalesce(a[0], F.lit("")) == "") | (F.coalesce(b[0], F.lit("")) == ""), 0.0).when(a[0] == b[0], 1.0).otherwise(close)


def display_general(x: Column) -> Column:
    """Up to six significant digits without zeros at the end; from a million on, or below a ten-thousandth, with an exponent."""
    wide = F.format_string("%.5e", x)
    exponent = F.regexp_extract(wide, r"e([+-]\d+)$", 1).try_cast("int")
    trimmed = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    plain = trimmed(F.element_at(F.array(*(F.format_string(f"%.{d}f", x) for d in range(11))), F.greatest(F.lit(1), 6 - exponent)))
    return F.when((exponent < -4) | (exponent >= 6), F.concat(trimmed(F.regexp_extract(wide, r"^(.*)e", 1)), F.regexp_extract(wide, r"e.*$", 0))).otherwise(plain)


def display_number(x: Column) -> Column:
    """Two decimals with thousands marked, zeros at the end left out."""
    shown = F.format_number(x, 2)
    return F.when(F.contains(shown, F.lit(".")), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)
