"""Connected components of an edge table by alternating star operations, without gathering any node's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import cut, tidy


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hang each node's larger neighbours (or, small, its smaller ones and itself) onto its least neighbour.

    edges: (hi, lo) with hi > lo. A node's least neighbour is computed by partial aggregation and joined back, so a
    hub's edges stay rows; the join's sides are plain shuffles, which Spark splits where a hub makes them skewed.
    """
    pairs = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if not small:
        pairs = pairs.union(edges.select("lo", "hi"))
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("m"))
    found = pairs.join(least, pairs["u"] == least["w"])
    if small:
        out = found.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.select("w", "m"))
    else:
        out = found.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return out.where("hi <> lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): each linked node with the least node that it reaches.

    Links of a node to itself and links with a null end say nothing; repeated links count once; no links, no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    seen = state(now)
    while seen[0]:
        now = cut(_stars(_stars(now, small=False), small=True))
        tidy(edges.sparkSession)
        last, seen = seen, state(now)
        if seen == last:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
