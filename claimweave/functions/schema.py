"""The tables' columns: claims are flat rows, their qualifiers and evidence columns beside the value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIM = """id string, doc_id string, page_no int, printed_page string, subject_raw string, subject_key string, measure_raw string, measure_key string,
value_kind string, low double, high double, unit_raw string, dimension string, currency string, canonical_low double, canonical_high double,
text_value string, date_value date, bool_value boolean, period_label string, period_start date, period_end date, scope string, basis string,
as_of date, estimate_type string, extra map<string, string>, quote string, grounding string, char_start int, char_end int,
confidence double, status string, quarantine_reason string"""
STEP = "struct<check: string, outcome: string, detail: string>"
RELATION = f"id string, claim_a_id string, claim_b_id string, verdict string, confidence double, summary string, trace array<{STEP}>, cross_doc boolean"
DOCUMENT = """doc_id string, filename string, path string, sha256 string, title string, pages int, publisher string, subject string, doc_type string,
as_of_date date, default_period string, default_scope string, default_unit string, default_currency string, ingested_at timestamp"""
MEASURE = "key string, canonical_name string, aliases array<string>, surface_forms array<string>"

#: What a claim holds if nothing else is said.
DEFAULTS = {"extra": "map()", "confidence": "0.5D", "status": "'active'", "page_no": "0"}


def columns(ddl: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ddl)]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of ddl in their order and types; missing ones take their default, or null."""
    out = []
    for name, kind in columns(ddl):
        value = F.col(name) if name in df.columns else F.expr(DEFAULTS.get(name, "null"))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)
