"""Periods, units, scopes and names, one table of cases each."""

import calendar
import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimweave.functions import periods, scope, text, units

def day(year, month, last=False):
    """The first or the last day of a month; months beyond 12 are of later years."""
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    return dt.date(year, month, calendar.monthrange(year, month)[1] if last else 1)


def written(year):
    """(label, start, end) of each form, made from the calendar for the fiscal year that ends in year."""
    begins, short = year - 1, f"{year % 100:02d}" if year >= 2000 else str(year)  # two digits are of this century
    rows = [(f"FY{year}", day(begins, 4), day(year, 3, True)), (f"fy {short}", day(begins, 4), day(year, 3, True)), (f"FY{begins}/{year % 100:02d}", day(begins, 4), day(year, 3, True)), (f"{begins} - {year % 100:02d}", day(begins, 4), day(year, 3, True)), (str(year), day(year, 1), day(year, 12, True))]
    rows += [(f"Q{q} FY {year}", day(begins, 3 * q + 1), day(begins, 3 * q + 3, True)) for q in (1, 2, 3, 4)] + [(f"{year} Q{q}", day(year, 3 * q - 2), day(year, 3 * q, True)) for q in (1, 2, 3, 4)]
    rows += [(f"H{h} FY{short}", day(begins, 6 * h - 2), day(begins, 6 * h + 3, True)) for h in (1, 2)] + [(f"h{h} {year}", day(year, 6 * h - 5), day(year, 6 * h, True)) for h in (1, 2)]
    for length, months in (("year", 12), ("quarter", 3), ("half year", 6), ("half-year", 6), ("month", 1)):
        for month in (2, 8, 11):
            end, name = day(year, month, True), calendar.month_name[month]
            forms = (f"the {length} ended {end.day} {name} {year}", f"{length} ended on {calendar.month_abbr[month]} {end.day}, {year}")
            rows += [(form, day(year - 1, month + 13 - months), end) for form in forms]
    for month, date in ((5, 19), (10, 3)):
        rows += [(f"as {word} {calendar.month_name[month]} {date}{th}, {year}", dt.date(year, month, date), dt.date(year, month, date)) for word, th in (("at", "th"), ("on", ""), ("of", ""))]
    rows += [(f"{calendar.month_name[m]}{dash}{calendar.month_abbr[n]} {year}", day(year, m), day(year + (n < m), n, True)) for m, n, dash in ((2, 7, " – "), (6, 6, " to "), (10, 1, "-"))]
    return rows


#: Labels that are read by one of the forms that they mix, by a rule that doesn't fit, or not at all.
ODD_PERIODS = [
    ("ten months ended August 14, 2018", day(2018, 1), day(2018, 12, True)), ("1999-00", day(1999, 1), day(1999, 12, True)), ("FY1999-00", day(1999, 4), day(2000, 3, True)), ("FY97", day(2096, 4), day(2097, 3, True)),
    ("Q3 FY2017-18", day(2016, 10), day(2016, 12, True)), ("as of June 31, 2019", None, None), ("since the last count", None, None),
]
PERIODS = [row for year in (1996, 2012, 2031) for row in written(year)] + ODD_PERIODS


def one(spark, frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_periods(spark):
    frame = spark.createDataFrame([(label,) for label, *_ in PERIODS] + [("",), ("  ",), (None,)], "label string")
    got = {r[0]: (r[1], r[2], r[3]) for r in periods.with_period(frame, "label").select("label", "period.label", "period.start", "period.end").collect()}
    for label, start, end in PERIODS:
        assert got[label] == (label, start, end), label
    assert got[""][0] is None and got["  "][0] is None and got[None][0] is None
    assert one(spark, frame.where(periods.is_impossible(F.col("label"))), "label") == [("as of June 31, 2019",)]


def test_fiscal_start_is_a_parameter(spark):
    frame = spark.createDataFrame([("FY2019",), ("Q3 FY19",)], "label string")
    for start, want in ((1, [day(2019, 1), day(2019, 12, True), day(2019, 7), day(2019, 9, True)]), (10, [day(2018, 10), day(2019, 9, True), day(2019, 4), day(2019, 6, True)])):
        assert [d for r in one(spark, frame.select(periods.parse_period(F.col("label"), start).alias("p")), "p.start", "p.end") for d in r] == want


@pytest.mark.parametrize(
    ("a", "b", "rel", "back"),
    [("FY2012", "year ended 31 Mar 2012", "equals", "equals"), ("H2 2015", "2015 Q3", "contains", "during"), ("2015 Q4", "Q4 FY2016", "before", "after"), ("H1 FY2016", "2015", "during", "contains"), ("2016", "FY2016", "overlaps", "overlaps"), ("as at May 2, 2015", "May-June 2015", "during", "contains"), ("some time ago", "2015", None, None), ("", "2015", None, None)],
)
def test_period_relations(spark, a, b, rel, back):
    frame = spark.createDataFrame([(a, b)], "a string, b string").select(periods.parse_period(F.col("a")).alias("a"), periods.parse_period(F.col("b")).alias("b"))
    assert one(spark, frame, periods.relate(F.col("a"), F.col("b")), periods.relate(F.col("b"), F.col("a"))) == [(rel, back)]


#: Each currency's spellings with scale words before, after or without them; then the rules that come before and after currencies.
MONEY = {"INR": ("rupees", "INR", "Rs", "₹"), "USD": ("dollars", "USD", "$"), "EUR": ("eur", "€"), "GBP": ("GBP", "£")}
UNITS = [(f"{word} {scale}".strip(), "currency", base, times) for base, names in MONEY.items() for word in names for scale, times in (("", 1.0), ("thousand", 1e3), ("lakhs", 1e5), ("mln", 1e6), ("Crores", 1e7), ("bn", 1e9), ("trillion", 1e12))]
UNITS += [(f"{scale} of {word}", "currency", base, times) for base, names in MONEY.items() for word in names for scale, times in (("million", 1e6), ("lac", 1e5))]
UNITS += [
    ("basis point", "percent", "percent", 0.01), ("bps of GBP", "percent", "percent", 0.01), ("PERCENT", "percent", "percent", 1.0), ("percentage of sales", "percent", "percent", 1.0), ("% of dollars", "percent", "percent", 1.0),
    ("thousand tons", "mass", "tonnes", 1e3), ("MT", "mass", "tonnes", 1.0), ("kg", "mass", "tonnes", 0.001), ("million kilograms", "mass", "tonnes", 1e3), ("vehicles", "count", "items", 1.0), ("lakh stores", "count", "items", 1e5), ("hundred", "count", "items", 1e2), ("k", "count", "items", 1e3),
    ("9 hrs.", "currency", "INR", 1.0), ("furlongs", None, None, None), ("per head and night", None, None, None), ("", None, None, None), (" \t ", None, None, None), (None, None, None, None),
]


def test_units(spark):
    frame = spark.createDataFrame([(k, u) for k, (u, *_) in enumerate(UNITS)], "k int, raw string").withColumn("u", units.parse_unit(F.col("raw"))).orderBy("k")
    assert one(spark, frame, "u.dimension", "u.base", "u.scale") == [u[1:] for u in UNITS]


def test_unit_values(spark):
    frame = spark.createDataFrame([(46.7, "lakh rupees", 4.67, "INR million"), (31.0, "basis points", 0.31, "percent"), (2.5, "thousand tons", 2_500_000.0, "kg")], "x double, u string, y double, v string").withColumns({"u": units.parse_unit(F.col("u")), "v": units.parse_unit(F.col("v"))})
    rows = one(spark, frame, units.canonicalise(F.col("x"), F.col("u")), units.canonicalise(F.col("y"), F.col("v")), units.comparable(F.col("u"), F.col("v")))
    for x, y, same in rows:
        assert same and x == pytest.approx(y, rel=1e-3)


@pytest.mark.parametrize(
    ("a", "b", "rel"),
    [("consolidated", "Consolidated", "same"), (None, None, "same"), ("consolidated", "standalone", "subsumes"), ("standalone", "consolidated", "subsumed_by"), ("Cold Storage", "Air Freight", "disjoint"), ("cold storage north", "cold storage", "subsumed_by"), ("consolidated", None, "unknown"), (None, "standalone", "unknown"), ("consolidated", "Cold Storage", "subsumes"), ("Cold Storage", "total", "subsumed_by"), ("consolidated", "group", "unknown"), ("consolidated", "consolidated basis", "subsumes"), ("consolidated", "total", "unknown"), ("standalone", "a segment", "unknown")],
)
def test_scopes(spark, a, b, rel):
    assert one(spark, spark.createDataFrame([(a, b)], "a string, b string"), scope.relate_scope(F.col("a"), F.col("b"))) == [(rel,)]


@pytest.mark.parametrize(("a", "b", "rel"), [(None, None, "same"), ("Adjusted", "adjusted ", "same"), ("reported", "audited", "different"), ("adjusted", None, "unknown"), ("reported", None, "same")])
def test_bases(spark, a, b, rel):
    assert one(spark, spark.createDataFrame([(a, b)], "a string, b string"), scope.relate_basis(F.col("a"), F.col("b"))) == [(rel,)]


def test_measure_names(spark):
    names = [("Total Income", "total income"), ("FY24 Adjusted Tonnage", "tonnage"), ("Q4 FY24 fees from storage", "fees from storage"), ("Adjusted", "adjusted"), (None, "")]
    frame = spark.createDataFrame([(n,) for n, _ in names], "n string")
    assert [r[0] for r in one(spark, frame, text.normalise_measure(F.col("n")))] == [x for _, x in names]


def test_subject_names(spark):
    names = [("Norvale Limited", "norvale"), ("Norvale Ltd", "norvale"), ("Dr. Ines Holm Okafor", "ines holm okafor"), ("Company", "company"), (None, "")]
    frame = spark.createDataFrame([(n,) for n, _ in names], "n string")
    assert [r[0] for r in one(spark, frame, text.normalise_subject(F.col("n")))] == [x for _, x in names]


@pytest.mark.parametrize(("a", "b", "low", "high"), [("revenue from storage", "revenue from haulage", 0.45, 0.99), ("open orders", "lost orders", 0, 0.4499), ("revenue from storage", "total income", 0, 0.4499), ("harbour trust of arland", "arland", 0, 0.5999), ("profit before tax", "tax before profit", 1, 1), ("aaaa", "aaaaa", 1, 1), ("", "x", 0, 0), ("x", "x", 1, 1)])
def test_similarity(spark, a, b, low, high):
    (found,) = one(spark, spark.createDataFrame([(a, b)], "a string, b string"), text.similarity(F.col("a"), F.col("b")))[0]
    assert low <= found <= high


def test_page_text_is_folded(spark):
    frame = text.with_norm_text(spark.createDataFrame([("ﬁscal  “Year”\n–end",), ("Plain\t Text ",), (None,), ("day\u2010by\u2011day \u2212 4",)], "text string"))
    assert [r[0] for r in one(spark, frame, "norm_text")] == ['fiscal "year" -end', "plain text", None, "day-by-day - 4"]


def test_display(spark):
    frame = spark.createDataFrame([(5310.0,), (53098.2,), (0.5,), (100.0,)], "x double")
    assert [r[0] for r in one(spark, frame, text.display_number(F.col("x")))] == ["5,310", "53,098.2", "0.5", "100"]
