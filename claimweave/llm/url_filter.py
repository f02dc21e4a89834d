"""URL verdicts by host rules, and for what no rule decides by the ratio of two character language models.

URLs that a rule allows or blocks train one model each: counts of characters after contexts of 0 to ORDER - 1
characters, each order interpolated with the one below it by Witten-Bell smoothing, so a context that was never seen
falls back to its longest known end. A URL's score is the mean log likelihood ratio of its characters; the verdict's
threshold is the one that separates held-out rule-judged URLs best. Everything is DataFrame expressions: counts come
from one aggregation of windows of ORDER characters, and the models are columns of the table of distinct windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.common import bounded, cut, table

ORDER, HELD_OUT, SYMBOLS = 5, 5, 256
START, END = "\x02", "\x03"
#: (host, path, verdict), as the query's contract fixes them.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def windows(url: Column, order: int = ORDER) -> Column:
    """For each character and the end mark, it and the order - 1 characters before it."""
    chars = F.split(F.concat(F.lit(START * (order - 1)), url, F.lit(END)), "")
    return F.transform(F.sequence(F.lit(0), F.size(chars) - order), lambda i: F.concat(*(F.get(chars, i + k) for k in range(order))))


def likelihood_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(w, good, bad) counts of windows to (w, llr): each window's log ratio of its last character's probabilities.

    A probability is (count + kinds * lower order's) / (context's count + kinds), with kinds the different
    characters seen after the context; below order 1 all SYMBOLS characters are equally likely.
    """
    lower = None
    for k in range(1, order + 1):
        grams = counts.groupBy(F.substring("w", order - k + 1, k).alias("g")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = Window.partitionBy(F.substring("g", 1, k - 1))
        if lower is not None:
            below = lower.select(F.col("g").alias("lower"), F.col("p_good").alias("q_good"), F.col("p_bad").alias("q_bad"))
            grams = grams.withColumn("lower", F.substring("g", 2, k - 1)).join(below, "lower")
        else:
            grams = grams.withColumns({"q_good": F.lit(1 / SYMBOLS), "q_bad": F.lit(1 / SYMBOLS)})
        p = {}
        for c in ("good", "bad"):
            total, kinds = F.sum(c).over(context), F.count_if(F.col(c) > 0).over(context)
            p[f"p_{c}"] = F.when(total > 0, (F.col(c) + kinds * F.col(f"q_{c}")) / (total + kinds)).otherwise(F.col(f"q_{c}"))
        lower = grams.withColumns(p).select("g", "p_good", "p_bad")
    return lower.select(F.col("g").alias("w"), F.round(F.log("p_good") - F.log("p_bad"), 9).cast("decimal(20,9)").alias("llr"))


def threshold(held: DataFrame) -> float:
    """(score, good) to the multiple of 0.01 from which on URLs are accepted: the one with the largest sum of both classes' hit rates, the least if several; 0 if a class is missing."""
    bins = held.groupBy(F.floor(F.col("score") * 100).alias("b")).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("n"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 0.01 of score
    all_ = Window.partitionBy(F.lit(0))
    below = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    rated = bins.select("b", below("n").alias("lost"), below("g").alias("missed"), F.sum("g").over(all_).alias("good"), F.sum("n").over(all_).alias("bad"))
    best = rated.where("good > 0 and bad > 0").orderBy(F.desc(F.expr("lost * good - missed * bad")), "b").first()
    return best["b"] / 100 if best else 0.0


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """(id_col, host, path, rule, verdict, score), one row for each row of pages.

    A null URL, or one without ://, has an empty host and path and no rule; it is scored by its characters, a null as
    an empty URL. Repeated rows get equal verdicts; null ids stay; without allowed or blocked URLs in the table the
    scores are those of the counts that there are, against a threshold of 0. A score equal to the threshold allows. Very
    long URLs are scored whole, their score being a mean over characters; an empty table gives no rows. Other columns
    are not read.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    # Distinct URLs are few bytes, but each becomes a row for each character: keep them on all partitions.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = cut(base.groupBy("url").agg(F.any_value("ruled").alias("ruled"), F.count("*").alias("n")).repartition(parts, "url"))
    trained = lambda verdict: F.when(~held & (F.col("ruled") == verdict), F.col("n")).otherwise(0)
    spread = urls.select("url", trained("allow").alias("good"), trained("block").alias("bad"), F.explode(windows(F.col("url"), order)).alias("w"))
    counts = cut(spread.groupBy("w").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    ratios = bounded(cut(likelihood_ratios(counts, order)), 1_000_000)
    scored = spread.select("url", "w").join(ratios, "w").groupBy("url").agg((F.sum("llr").cast("double") / F.count("*")).alias("score"))
    scored = cut(scored)
    t = threshold(urls.where(held & F.col("ruled").isNotNull()).join(scored, "url").select("score", (F.col("ruled") == "allow").alias("good")))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= t, "allow").otherwise("block"))
    return base.join(scored, "url").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
