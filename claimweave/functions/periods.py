"""Written periods to closed intervals of dates, and how two intervals lie to each other."""

from __future__ import annotations

import calendar
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their short forms to numbers.
MONTHS = {name.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, name in enumerate(names) if name}
FISCAL_START = 4
PERIOD = "struct<label: string, start: date, end: date>"

_MONTH = "(" + "|".join(sorted(MONTHS, key=lambda m: (-len(m), m))) + ")"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_DATE = rf"(?:{_DAY}\s+{_MONTH}|{_MONTH}\s+{_DAY}),?\s*(\d{{4}})"
# The forms of periods, in the order in which they are tried.
ENDED = rf"(?iU)\b(year|quarter|half[\s-]?year|month)\s+ended\b\s*(?:on\s+)?{_DATE}"
AS_OF = rf"(?iU)\bas\s+(?:at|on|of)\b\s*{_DATE}"
FISCAL_QUARTER = r"(?iU)\bQ([1-4])\s*FY\s*(\d{2,4})\b"
QUARTER = r"(?iU)\b(\d{4})\s*Q([1-4])\b"
FISCAL_HALF = r"(?iU)\bH([12])\s*FY\s*(\d{2,4})\b"
FISCAL_YEAR = r"(?iU)\bFY\s*(\d{2,4})(?:\s*[-/–]\s*(\d{2,4}))?\b"
SPAN = r"(?U)\b((?:19|20)\d{2})\s*[-/–]\s*(\d{2,4})\b"
MONTH_RANGE = rf"(?iU)\b{_MONTH}\s*(?:[-–—]|to)\s*{_MONTH}[,\s]+(\d{{4}})\b"
HALF = r"(?iU)\bH([12])\s*((?:19|20)\d{2})\b"
YEAR = r"(?U)\b((?:19|20)\d{2})\b"


def _date(y: Column, m: Column, d: Column) -> Column:
    """Null if there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def _first(y: Column, m: Column) -> Column:
    return _date(y, m, F.lit(1))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class _Groups:
    """The groups of a match, numbered from 1; null where a group took no part."""

    def __init__(self, parts: Column) -> None:
        self.parts = parts

    def str(self, group: int) -> Column:
        return F.nullif(F.get(self.parts, F.lit(group - 1)), F.lit(""))

    def int(self, group: int) -> Column:
        return self.str(group).try_cast("int")

    def month(self, *groups: int) -> Column:
        known = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
        return F.try_element_at(known, F.lower(F.coalesce(*(self.str(g) for g in groups))))


def _form(text: Column, pattern: str, dates) -> Column:
    """dates(groups) of the pattern's first match in the text, null if there is none; the text is searched once."""
    split = "\u0001".join(f"${k}" for k in range(1, re.compile(pattern[pattern.index(")") + 1 :]).groups + 1))
    matched = lambda m: F.when(m != "", _let(F.split(F.regexp_replace(m, pattern, split), "\u0001"), lambda g: dates(_Groups(g))))
    return _let(F.regexp_extract(text, pattern, 0), matched)


def _year(y: Column, century: Column | int = 2000) -> Column:
    return F.when(y >= 1000, y).otherwise(y + century)


def fiscal_quarters(end_year: Column, first: Column | int, last: Column | int, start: int) -> tuple[Column, Column]:
    """From the first to the last quarter of the fiscal year that ends in end_year."""
    begins = _first(end_year - (1 if start > 1 else 0), F.lit(start))
    lit = lambda q: q if isinstance(q, Column) else F.lit(q)
    return F.add_months(begins, 3 * (lit(first) - 1)), F.last_day(F.add_months(begins, 3 * lit(last) - 1))


def _dates(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _forms(text: Column, fiscal_start: int) -> list[Column]:
    """(start, end) by each form in the order in which they are tried, null where it doesn't occur."""

    def ended(g: _Groups) -> Column:
        kind = F.regexp_replace(F.lower(g.str(1)), "[ -]", "")
        length = F.when(kind == "year", 12).when(kind == "quarter", 3).when(kind == "month", 1).otherwise(6)
        end = _date(g.int(6), g.month(3, 4), F.coalesce(g.int(2), g.int(5)))
        return _let(end, lambda e: _dates(F.add_months(F.trunc(e, "month"), 1 - length), e))

    def as_of(g: _Groups) -> Column:
        return _let(_date(g.int(5), g.month(2, 3), F.coalesce(g.int(1), g.int(4))), lambda d: _dates(d, d))

    def fiscal_year(g: _Groups) -> Column:
        def of(y1: Column) -> Column:
            y2 = _year(g.int(2), (y1 / 100).cast("int") * 100)
            return _let(F.when(y2.isNull(), y1).when(y2 <= y1, y1 + 1).otherwise(y2), lambda y: _dates(*fiscal_quarters(y, 1, 4, fiscal_start)))

        return _let(_year(g.int(1)), of)

    def span(g: _Groups) -> Column:
        s1 = g.int(1)
        return _let(_year(g.int(2), (s1 / 100).cast("int") * 100), lambda s2: F.when(s2 == s1 + 1, _dates(*fiscal_quarters(s2, 1, 4, fiscal_start))))

    def months(g: _Groups) -> Column:
        m1, m2, year = g.month(1), g.month(2), g.int(3)
        return _dates(_first(year, m1), F.last_day(_first(year + F.when(m2 < m1, 1).otherwise(0), m2)))

    quarter = lambda g: _dates(_first(g.int(1), 3 * g.int(2) - 2), F.last_day(_first(g.int(1), 3 * g.int(2))))
    half = lambda g: _dates(_first(g.int(2), 6 * g.int(1) - 5), F.last_day(_first(g.int(2), 6 * g.int(1))))
    year = lambda g: _dates(_first(g.int(1), F.lit(1)), _date(g.int(1), F.lit(12), F.lit(31)))
    fiscal_quarter = lambda g: _dates(*fiscal_quarters(_year(g.int(2)), g.int(1), g.int(1), fiscal_start))
    fiscal_half = lambda g: _dates(*fiscal_quarters(_year(g.int(2)), 2 * g.int(1) - 1, 2 * g.int(1), fiscal_start))
    tried = [(ENDED, ended), (AS_OF, as_of), (FISCAL_QUARTER, fiscal_quarter), (QUARTER, quarter), (FISCAL_HALF, fiscal_half), (FISCAL_YEAR, fiscal_year), (SPAN, span), (MONTH_RANGE, months), (HALF, half), (YEAR, year)]
    return [_form(text, pattern, dates) for pattern, dates in tried]


def parse_period(label: Column, fiscal_start: int = FISCAL_START) -> Column:
    """PERIOD of a written period: null if it is blank, without dates if it isn't understood.

    The first form that occurs in the label decides. Labels that mix forms are read by one of them alone, so "Q4
    FY2023-24" is the last quarter of FY2023 and "9M FY24" the whole of FY24; a fiscal year is named for its end.
    An impossible date, such as 30 February, has no dates either: is_impossible() tells them apart.
    """

    def read(text: Column) -> Column:
        found = F.coalesce(*_forms(text, fiscal_start))
        return F.when(F.coalesce(text, F.lit("")) != "", _let(found, lambda p: F.struct(text.alias("label"), p["start"].alias("start"), p["end"].alias("end"))))

    return _let(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""), read).cast(PERIOD)


def is_impossible(label: Column) -> Column:
    """The label names a day that doesn't exist; a claim with it is rejected."""
    found = parse_period(label)
    return F.coalesce((F.rlike(label, F.lit(ENDED)) | F.rlike(label, F.lit(AS_OF))) & found["end"].isNull(), F.lit(False))


def with_period(df, label_col: str, out: str = "period", fiscal_start: int = FISCAL_START):
    """Parse each distinct label once and join the result back."""
    labels = df.select(F.col(label_col).alias("_label")).where("_label is not null").distinct()
    parsed = labels.withColumn(out, parse_period(F.col("_label"), fiscal_start))
    return df.join(parsed, F.col(label_col) == F.col("_label"), "left").drop("_label")


#: How a period can lie to another one.
RELATIONS = ("equals", "contains", "during", "before", "after", "overlaps")


def relate(a: Column, b: Column, names: Sequence = RELATIONS) -> Column:
    """How period a lies to period b: equals, contains, during, before, after or overlaps; null if a date is missing.

    names: what to call them.
    """
    equals, contains, during, before, after, overlaps = names
    return (
        F.when(a["start"].isNull() | a["end"].isNull() | b["start"].isNull() | b["end"].isNull(), None)
        .when((a["start"] == b["start"]) & (a["end"] == b["end"]), equals)
        .when((a["start"] <= b["start"]) & (a["end"] >= b["end"]), contains)
        .when((b["start"] <= a["start"]) & (b["end"] >= a["end"]), during)
        .when(a["end"] < b["start"], before)
        .when(b["end"] < a["start"], after)
        .otherwise(overlaps)
    )
