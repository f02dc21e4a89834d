"""Mixing sources to target weights down a tree of domains, languages and sources.

Budgets go from the root down. Each node's budget is dealt to its children by weight; a child that can't use its
share, even by repeating its texts up to max_epochs times, keeps what it can use, and its siblings get the rest by
their weights. A node asks its own parent for no more than its subtree can use, so a shortage leaves a subtree only
when all siblings in it are exhausted. A leaf's budget is then filled from seeded epochs: each epoch is an order of
the leaf's texts by a hash of seed, epoch and id; whole epochs first, then a prefix of the next one by tokens.

No leaf is sorted as a whole: tokens are summed by ranges of the hash, and only the range that holds a leaf's cut is
ordered. All arithmetic is on integers, so the result doesn't depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.common import WORD, bounded, cut, table

BIG = "decimal(38,0)"
#: Leading hex digits of the hash that name a range: 4,096 ranges to a leaf.
RANGE = 3


def _on(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[f"r_{n}"]) for n in names))


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"r_{n}" for n in names})


def deal(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add quota to children (parent..., name, can, weight, budget): budget is dealt by weight, to none more than can.

    A child is full if, with all children of a lower can/weight full too, its share of the rest reaches what it can
    use. Children of weight 0 or less, or of no weight, get nothing.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy((F.col("can").cast("double") / F.col("weight").cast("double")), F.col(name).asc_nulls_first())
    big = lambda c: F.col(c).cast(BIG)
    before = F.coalesce(F.sum("can").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = children.where("weight > 0").withColumns({"before": before, "onward": onward})
    ranked = ranked.withColumn("full", (big("can") * big("onward")).cast(BIG) <= ((big("budget") - big("before")) * big("weight")).cast(BIG))
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("can"))).over(group), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    share = F.expr(f"cast((cast(budget as {BIG}) - cast(used as {BIG})) * cast(weight as {BIG}) as {BIG}) div open")
    return ranked.withColumns({"used": used, "open": open_}).withColumn("quota", F.when(F.col("full"), F.col("can")).otherwise(share).cast("long")).drop("before", "onward", "full", "used", "open")


def leaf_quotas(leaves: DataFrame, levels: list[str], weights: DataFrame, budget: Column, max_epochs: int) -> DataFrame:
    """(levels..., tokens) to (levels..., tokens, quota). weights: (level, node, weight); nodes without one weigh 1."""
    can = leaves.withColumn("can", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(budget, F.lit(0)).cast("long")).first()[0]
    above = None
    for k, name in enumerate(levels):
        nodes = can.groupBy(*levels[: k + 1]).agg(F.sum("can").alias("can"))
        own = bounded(cut(weights.where(F.col("level") == name).select(F.col("node").alias("w_node"), F.col("weight").cast("long").alias("w"))), 200_000)
        weighed = nodes.join(own, nodes[name].cast("string") == own["w_node"], "left").withColumn("weight", F.coalesce("w", F.lit(1))).drop("w", "w_node")
        found = weighed.join(above, _on(weighed, above, levels[:k])).withColumnRenamed("r_budget", "budget") if k else weighed.withColumn("budget", F.lit(total).cast("long"))
        dealt = deal(found.select(*levels[: k + 1], "can", "weight", "budget"), levels[:k], name)
        above = _named(dealt.select(*levels[: k + 1], F.col("quota").alias("r_budget")), levels[: k + 1])
    return leaves.join(above, _on(leaves, above, levels), "left").select(*levels, "tokens", F.coalesce("r_budget", F.lit(0)).alias("quota"))


def _place(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))


def mixed(docs: DataFrame, levels: dict[str, Column], tokens: Column, weights: DataFrame, share: float = 1.0, max_epochs: int = 4, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(doc, levels..., tokens, copies) for the texts in the mixture; doc holds docs' own columns, whatever their names.

    levels: the tree's levels from the top, each with an expression on docs; share: the mixture's tokens as a share of
    all tokens. copies: how often the text occurs, once for each epoch that takes it. A null level is a node of its
    own; null ids share one place in each order; rows of one leaf with the same id are taken together or not at all;
    null token counts are 0. Texts without tokens cost nothing and go with the prefix that they stand in; those of a
    leaf without any tokens are taken once. Repeated rows are rows of one id, and very long texts rows of many tokens.
    Ties, equal places in an order, are of equal ids alone. An empty table gives no rows.
    """
    names = list(levels)
    if taken := {"doc", "id", "tokens", "copies", "quota", "epochs", "rest", "h", "range", "border"} & set(names):
        raise ValueError(f"levels can't be named {sorted(taken)}")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), *(c.cast("string").alias(n) for n, c in levels.items()), F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens"))
    narrow = cut(rows.drop("doc"))
    leaves = narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    budget = F.floor(F.sum("tokens") * F.lit(f"{share:.6f}").cast("decimal(18,6)"))
    quotas = cut(leaf_quotas(cut(leaves), names, weights, budget, max_epochs))
    some = F.col("tokens") > 0
    plan = quotas.select(*names, F.when(some, F.expr("quota div tokens")).otherwise(0).alias("epochs"), F.when(some, F.expr("quota % tokens")).otherwise(0).alias("rest"))
    plan = _named(cut(plan), names)

    # A text's place in its leaf's last, partial epoch; the plan has a row for each leaf.
    small = bounded(plan, 200_000)
    placed = narrow.join(small, _on(narrow, small, names)).withColumn("h", _place(seed)).withColumn("range", F.substring("h", 1, RANGE))
    ranges = cut(placed.groupBy(*names, "range").agg(F.sum("tokens").alias("sum"), F.max("rest").alias("rest")))
    leaf = Window.partitionBy(*names).orderBy("range")
    upto = ranges.withColumn("upto", F.sum("sum").over(leaf))
    border = _named(upto.where("upto > rest").groupBy(*names).agg(F.min(F.struct("range", F.expr("upto - sum").alias("before"))).alias("border")).select(*names, F.col("border.range").alias("cut_range"), F.col("border.before").alias("before")), names)
    border = bounded(cut(border), 200_000)
    inside = placed.join(border, _on(placed, border, names) & (F.col("range") == F.col("cut_range")))
    run = F.sum("tokens").over(Window.partitionBy(*names).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("run", run + F.col("before")).where("run <= rest").groupBy(*names).agg(F.max("h").alias("last_h"))
    cuts = border.join(_named(last, names).withColumnsRenamed({f"r_{n}": f"s_{n}" for n in names}), reduce(lambda a, b: a & b, (F.col(f"r_{n}").eqNullSafe(F.col(f"s_{n}")) for n in names)), "left").drop(*(f"s_{n}" for n in names), "before")
    whole = plan.withColumnsRenamed({f"r_{n}": n for n in names})
    full_plan = whole.join(cuts, _on(whole, cuts, names), "left").drop(*(f"r_{n}" for n in names))
    decided = _named(cut(full_plan.select(*names, "epochs", "cut_range", "last_h")), names)
    decided = bounded(decided, 200_000)
    out = rows.join(decided, _on(rows, decided, names)).withColumn("h", _place(seed))
    # Only a leaf without any tokens has no range that exceeds its rest: all of it is in the prefix.
    in_prefix = F.col("cut_range").isNull() | (F.substring("h", 1, RANGE) < F.col("cut_range")) | F.coalesce(F.col("h") <= F.col("last_h"), F.lit(False))
    copies = (F.col("epochs") + F.coalesce(in_prefix, F.lit(False)).cast("long")).alias("copies")
    return out.select("doc", *names, "tokens", copies).where("copies > 0")


#: The tree of the query: domains by the sources' numbers, then languages, then sources; all other nodes weigh 1.
WEIGHTS = {("domain", "d0"): 3, ("domain", "d1"): 2, ("domain", "d2"): 1, ("lang", "en"): 5}


def tree_levels() -> dict[str, Column]:
    return {"domain": F.concat(F.lit("d"), (F.expr("try_cast(substring(source, 4) as int)") % 3).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    weights = spark.createDataFrame([(*k, w) for k, w in WEIGHTS.items()], "level string, node string, weight long")
    return mixed(docs, tree_levels(), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)), weights)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark, table(spark, sf_dir, "documents")).select("doc.doc_id", "domain", "lang", "source", "tokens", "copies")


def _oracle() -> str:
    levels = ["domain", "lang", "source"]
    parts = [r"""d AS (SELECT doc_id, 'd' || (TRY_CAST(substr(source, 4) AS INT) % 3)::VARCHAR AS domain, lang, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
q0 AS (SELECT sum(tokens)::BIGINT AS quota FROM leaves)"""]
    weight = {"domain": "CASE n.domain WHEN 'd0' THEN 3 WHEN 'd1' THEN 2 ELSE 1 END", "lang": "CASE n.lang WHEN 'en' THEN 5 ELSE 1 END", "source": "1"}
    for k, name in enumerate(levels, 1):
        own, up = ", ".join(levels[:k]), ", ".join(levels[: k - 1])
        by = f"PARTITION BY {up} " if up else ""
        on = " AND ".join(f"n.{x} IS NOT DISTINCT FROM q.{x}" for x in levels[: k - 1]) or "true"
        parts.append(f"""n{k} AS (SELECT {own}, sum(tokens * 4)::HUGEINT AS can FROM leaves GROUP BY ALL),
b{k} AS (SELECT n.*, {weight[name]}::HUGEINT AS w, q.quota::HUGEINT AS budget FROM n{k} n JOIN q{k - 1} q ON {on}),
o{k} AS (SELECT *, coalesce(sum(can) OVER ({by}ORDER BY can::DOUBLE / w::DOUBLE, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER ({by}ORDER BY can::DOUBLE / w::DOUBLE, {name} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM b{k}),
f{k} AS (SELECT *, can * onward <= (budget - before) * w AS ful FROM o{k}),
q{k} AS (SELECT {own}, (CASE WHEN ful THEN can ELSE ((budget - coalesce(sum(can) FILTER (ful) OVER ({by.strip()}), 0)) * w) // (sum(w) FILTER (NOT ful) OVER ({by.strip()})) END)::BIGINT AS quota FROM f{k})""")
    parts.append("""p AS (SELECT l.*, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest
  FROM leaves l JOIN q3 q ON l.domain IS NOT DISTINCT FROM q.domain AND l.lang IS NOT DISTINCT FROM q.lang AND l.source IS NOT DISTINCT FROM q.source),
h AS (SELECT d.*, p.epochs, p.rest, md5('1|' || p.epochs::VARCHAR || '|' || coalesce(d.doc_id::VARCHAR, 'null')) AS h
  FROM d JOIN p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS run FROM h)
SELECT doc_id, domain, lang, source, tokens, (epochs + (run <= rest)::BIGINT)::BIGINT AS copies FROM c WHERE epochs + (run <= rest)::BIGINT > 0""")
    return "WITH " + ",\n".join(parts)


ORACLE = _oracle()
