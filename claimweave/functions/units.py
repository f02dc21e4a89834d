"""Units of measurement: what a written unit measures and how its numbers scale to a base unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SCALES = {
    "hundred": 1e2, "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lac": 1e5, "lakhs": 1e5, "million": 1e6, "mn": 1e6, "mln": 1e6, "m": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9, "trillion": 1e12, "tn": 1e12,
}
CURRENCIES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "rupee": "INR", "$": "USD", "usd": "USD", "us$": "USD", "dollar": "USD", "dollars": "USD",
    "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP",
}
BASIS_POINTS = r"\b(bps|basis points?)\b"
PERCENT = r"(%|\bper\s?cent\b|\bpercent\b|\bpercentage\b)"
TONNES = r"\b(tons?|tonnes?|mt)\b"
KILOGRAMS = r"\bkg\b|\bkilograms?\b"
COUNTED = r"\b(shipments?|parcels?|units?|customers?|employees?|people|persons?|consignments?|orders?|clients?|stores?|centres?|centers?|vehicles?)\b"

UNIT = "struct<dimension: string, scale: double, base: string, currency: string>"


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def parse_unit(raw: Column) -> Column:
    """UNIT of a written unit; null if it is blank or not recognised, so its claims can't be compared.

    The first rule that fits decides: basis points, per cent, currency, mass, a counted noun, a scale word alone.
    Currency and scale are the first words of the text that name one; a currency's sign counts wherever it stands, also
    "rs." at the end of a longer word. Currencies are never converted.
    """
    text = F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    has = lambda pattern: F.rlike(text, F.lit(f"(?U){pattern}"))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"[a-z₹$€£]+\.?|%"), F.lit(0)), lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    first = lambda known: F.get(F.filter(F.transform(tokens, lambda t: F.try_element_at(_map(known), t)), lambda v: v.isNotNull()), 0)
    sign = F.coalesce(*(F.when(F.contains(text, F.lit(s)), c) for s, c in CURRENCIES.items() if not s.isalpha()))
    currency, scale = F.coalesce(first(CURRENCIES), sign), F.coalesce(first(SCALES), F.lit(1.0))
    unit = lambda dimension, scale, base, currency=F.lit(None): F.struct(F.lit(dimension).alias("dimension"), scale.cast("double").alias("scale"), base.alias("base"), currency.cast("string").alias("currency"))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", None)
        .when(has(BASIS_POINTS), unit("percent", F.lit(0.01), F.lit("percent")))
        .when(has(PERCENT), unit("percent", F.lit(1.0), F.lit("percent")))
        .when(currency.isNotNull(), unit("currency", scale, currency, currency))
        .when(has(TONNES), unit("mass", scale, F.lit("tonnes")))
        .when(has(KILOGRAMS), unit("mass", scale * 0.001, F.lit("tonnes")))
        .when(has(COUNTED) | first(SCALES).isNotNull(), unit("count", scale, F.lit("items")))
        .cast(UNIT)
    )


def comparable(a: Column, b: Column) -> Column:
    """Two parsed units measure the same in the same base unit."""
    return F.coalesce((a["dimension"] == b["dimension"]) & (a["base"] == b["base"]), F.lit(False))


def canonicalise(value: Column, unit: Column) -> Column:
    return value * unit["scale"]
