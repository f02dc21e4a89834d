"""Claims that the driver's tables state: the catalogue's queries run on these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import periods
from claimweave.functions.schema import CLAIM, conform
from claimweave.functions.text import normalise_measure, normalise_subject
from claimweave.functions.units import canonicalise, parse_unit
from claimweave.sources.store import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finished(claims: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Parse units and periods and set the keys of claims that hold raw labels. Distinct labels are parsed once; carry: other columns to keep."""
    units = claims.select("unit_raw").where("unit_raw is not null").distinct().withColumn("_unit", parse_unit(F.col("unit_raw")))
    with_units = claims.join(units, "unit_raw", "left")
    dated = periods.with_period(with_units, "period_label", "_period") if "period_label" in claims.columns else with_units.withColumn("_period", F.lit(None).cast(periods.PERIOD))
    out = dated.withColumns({
        "dimension": F.col("_unit.dimension"), "currency": F.col("_unit.currency"), "canonical_low": canonicalise(F.col("low"), F.col("_unit")), "canonical_high": canonicalise(F.col("high"), F.col("_unit")),
        "period_start": F.col("_period.start"), "period_end": F.col("_period.end"), "subject_key": normalise_subject(F.col("subject_raw")),
    })
    if "measure_key" not in claims.columns:
        out = out.withColumn("measure_key", F.substring(F.replace(normalise_measure(F.col("measure_raw")), F.lit(" "), F.lit("_")), 1, 60))
    return checkpointed(conform(out, ", ".join([CLAIM, *(f"{c} {out.schema[c].dataType.simpleString()}" for c in carry)])))


def revenue_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's revenue as three documents state it: by fiscal year in INR million and in Rs. Cr, and by quarter.

    Sums are decimals, so they don't depend on the order of rows. The quarters' are written, as all three documents and
    their distinct labels are made from them.
    """
    net = (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    sold = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"), net.alias("net"))
    turned = F.add_months("day", 9)  # a fiscal year that starts in April is a year from here
    sums = checkpointed(sold.select("l_suppkey", F.year(turned).alias("fy"), F.quarter(turned).alias("q"), "net").groupBy("l_suppkey", "fy", "q").agg(F.sum("net").alias("net")))
    years = sums.groupBy("l_suppkey", "fy").agg(F.sum("net").alias("net"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat("s_name", F.lit(" Limited")).alias("subject_raw"))

    def stated(sums: DataFrame, doc: str, label, unit: str, per: int, digits: int) -> DataFrame:
        value = F.round(F.col("net").cast("decimal(20,4)") * F.lit(f"{1 / per:.7f}").cast("decimal(8,7)"), digits).cast("double")
        return sums.select("l_suppkey", F.concat_ws("-", F.lit(doc), F.col("l_suppkey").cast("string"), label).alias("id"), F.lit(doc).alias("doc_id"), label.alias("period_label"), value.alias("low"), value.alias("high"), F.lit(unit).alias("unit_raw"))

    fy = F.concat(F.lit("FY"), F.col("fy").cast("string"))
    all_ = stated(years, "A", fy, "INR million", 1_000_000, 6).unionByName(stated(years, "B", fy, "Rs. Cr", 10_000_000, 4)).unionByName(stated(sums, "C", F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(" "), fy), "Rs. Cr", 10_000_000, 7))
    return finished(all_.join(names, "l_suppkey").withColumns({"measure_raw": F.lit("Revenue"), "value_kind": F.lit("number"), "scope": F.lit("consolidated")}).drop("l_suppkey"))


def balance_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances of customers and suppliers, by market segment as the measure's name."""
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("subject_raw"), F.concat(F.lit("balance "), F.lower("c_mktsegment")).alias("measure_raw"), F.col("c_acctbal").alias("low"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supp-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("subject_raw"), F.lit("balance supplier").alias("measure_raw"), F.col("s_acctbal").alias("low"))
    return finished(customers.unionByName(suppliers).withColumns({"doc_id": F.lit("balances"), "value_kind": F.lit("number"), "high": F.col("low"), "unit_raw": F.lit("USD"), "period_label": F.lit(None).cast("string")}))


def ledger_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances with what goes wrong in extraction: unknown units, periods without dates, missing and dropped qualifiers, quarantine."""
    k = F.col("c_custkey")
    text = lambda n, at, value: F.when(k % n == at, F.lit(value))
    return finished(table(spark, sf_dir, "customer").select(
        F.concat(F.lit("ledger-"), k.cast("string")).alias("id"), F.lit("ledger").alias("doc_id"), F.col("c_name").alias("subject_raw"), F.concat(F.lit("balance "), F.lower("c_mktsegment")).alias("measure_raw"),
        F.lit("number").alias("value_kind"), F.col("c_acctbal").alias("low"), F.col("c_acctbal").alias("high"), F.coalesce(text(7, 0, "florins"), text(9, 0, "guilders"), F.lit("USD")).alias("unit_raw"),
        F.coalesce(text(10, 0, "in the time under review"), text(10, 1, "FY2024")).alias("period_label"), text(2, 0, "group").alias("scope"), text(5, 0, "audited").alias("basis"), text(4, 0, "2024-05-01").cast("date").alias("as_of"),
        F.when(k % 11 == 0, "quarantined").otherwise("active").alias("status"), F.when(k % 11 == 0, "not_found").when(k % 3 == 0, "exact").otherwise("fuzzy").alias("grounding"),
        F.when(k % 13 == 0, F.create_map(F.lit("dropped_scope"), F.lit("standalone"), F.lit("page"), F.lit("7"))).alias("extra"),
    ))


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user was last seen doing on a day, as a state with the day as its as-of date."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "ts", "event_id", "event_type")
    last = events.groupBy("user_id", "day").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    return finished(last.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("id"), F.concat(F.lit("day "), F.col("day").cast("string")).alias("doc_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject_raw"), F.lit("last action").alias("measure_raw"), F.lit("text").alias("value_kind"), F.col("e.event_type").alias("text_value"),
        F.col("day").alias("as_of"), F.concat(F.lit("as at "), F.date_format("day", "MMMM d, yyyy")).alias("period_label"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("string").alias("unit_raw"),
    ))


def order_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(responses on orders as pages of ten documents, the documents' profiles).

    An order states its price, a range without a unit and its date; one in 13 states its price 25 times, one in 7 has a
    claim without a quote, one in 11 no JSON, and one in 5 wraps it in prose. Each third date is of a day that isn't one.
    """
    orders = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    text = lambda x: F.lit(x).cast("string")
    names = ("subject", "measure", "value_kind", "value", "value_high", "unit", "date_value", "period", "scope", "quote", "confidence")
    claim = lambda **c: F.struct(*((c[n] if n in c else text(None)).alias(n) for n in names))
    fy = F.concat(F.lit("FY"), F.year(F.add_months("day", 9)).cast("string"))
    price = claim(measure=text("order price"), value_kind=text("number"), value=F.col("o_totalprice").cast("string"), unit=text("USD"), period=fy, scope=text("group"), quote=text("the price"), confidence=text("0.75"), subject=F.when(F.col("o_orderkey") % 2 == 0, "Buyer Ltd"))
    span = claim(measure=text(" discount "), value_kind=text("range"), value=text("5"), value_high=text("2.5"), quote=text("two to five"), confidence=text("7"))
    placed = claim(measure=text("order date"), value_kind=text("date"), date_value=F.concat(F.col("day").cast("string"), F.lit("T00:00")), quote=F.when(F.col("o_orderkey") % 7 != 0, "placed on").otherwise(" "), period=F.when(F.col("o_orderkey") % 3 == 0, "as at 30 February 2024"))
    many = F.when(F.col("o_orderkey") % 13 == 0, F.array_repeat(price, 25)).otherwise(F.array(price, span, placed))
    body = F.to_json(F.struct(many.alias("claims")))
    response = F.when(F.col("o_orderkey") % 11 == 0, "no claims here").when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("As asked:\n"), body, F.lit("\nDone."))).otherwise(body)
    answers = orders.select(F.concat(F.lit("D"), (F.col("o_custkey") % 10).cast("string")).alias("doc_id"), F.col("o_orderkey").cast("int").alias("page_no"), text(None).alias("printed_page"), response.alias("response"))
    documents = spark.range(10).select(F.concat(F.lit("D"), F.col("id").cast("string")).alias("doc_id"), F.concat(F.lit("House "), F.col("id").cast("string")).alias("subject"), F.lit("2024").alias("default_period"), F.lit("total").alias("default_scope"), F.lit("per cent").alias("default_unit"), F.expr("date'2024-05-01'").alias("as_of_date"))
    return answers, documents


def ruled_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, measures that go negative): pairs of claims on parts, whose fields turn with the part's number modulo 20."""
    k = F.col("p_partkey") % 20
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    at = lambda cases, other: F.coalesce(*(F.when(k == n, F.lit(v)) for n, v in cases.items()), F.lit(other))

    def side(x: str, value, unit, period, scope, basis=None, as_of=None, estimate=None, kind=None, text=None, page=None) -> DataFrame:
        null = F.lit(None).cast("string")
        kinds = kind if kind is not None else F.lit("number")
        number = F.when(kinds == "number", value)
        return finished(parts.select(
            F.concat(F.lit(f"{x}-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("pair_id"), F.when((k == 14) | (x == "a"), "P").otherwise("Q").alias("doc_id"), F.lit(1).alias("page_no"),
            F.concat(F.lit("part "), F.when((k == 19) & F.lit(x == "b"), F.lit("of something else")).otherwise(F.col("p_partkey").cast("string"))).alias("subject_raw"), F.when(k == 18, "loss").otherwise("amount").alias("measure_raw"),
            kinds.alias("value_kind"), number.alias("low"), number.alias("high"), F.when(kinds == "number", unit).alias("unit_raw"), (text if text is not None else null).alias("text_value"), period.alias("period_label"), scope.alias("scope"),
            (basis if basis is not None else null).alias("basis"), (as_of if as_of is not None else null).cast("date").alias("as_of"), (estimate if estimate is not None else null).alias("estimate_type"),
        ), carry=("pair_id",))

    price = F.col("price")
    a = side("a", price, at({0: "florins"}, "INR million"), F.when(k != 2, F.lit("FY2024")), at({9: "standalone", 10: "Retail"}, "consolidated"), basis=at({12: "reported"}, None).cast("string"), as_of=F.when(k == 16, "2024-05-01"), estimate=F.when(k == 16, "forecast"))
    b_kind = at({4: "text"}, "number")
    b_value = F.when(k.isin(7, 8, 18), price / 4).when(k.isin(17, 6), price * 2).when(k.isin(14, 16, 13), price * 3).when(k == 11, price).otherwise(price * 1.001)
    b_value = F.when(k == 7, price * 4).when(k == 18, price * 4).otherwise(b_value)
    b = side("b", b_value, at({1: "USD million"}, "INR million"), at({3: "in the time under review", 5: "FY2023", 6: "2024", 7: "Q4 FY2024", 8: "Q4 FY2024", 18: "Q4 FY2024"}, "FY2024"), F.when(k != 11, at({10: "Wholesale"}, "consolidated")), basis=at({12: "adjusted", 13: "adjusted"}, None).cast("string"), as_of=F.when(k == 16, "2024-11-01"), kind=b_kind, text=F.when(k == 4, "none"))
    return a, b, spark.createDataFrame([("loss",)], "measure_key string")
