"""What a change makes anew and withdraws."""

from pyspark.sql import functions as F
from test_reconcile import claim, claims

from claimweave.operators import reconcile


def test_a_turned_measure_remakes_only_parts_of_wholes(spark):
    before = claims(spark, [claim("a", value=9.0, measure="cash flow"), claim("b", value=8.0, measure="cash flow", period="2017 Q3"), claim("c", value=7.0, measure="cash flow", period="2015"), claim("d", value=6.0, measure="cash flow", period="2014")])
    none, key = spark.createDataFrame([], "measure_key string"), spark.createDataFrame([("cash_flow",)], "measure_key string")
    made, gone = reconcile.follow(before, before, none, key)
    assert [(r.claim_a_id, r.claim_b_id) for r in made.collect()] == [("a", "b")] and gone.isEmpty()  # all six before
    moved = before.withColumn("subject_raw", F.when(F.col("id") == "d", "Elsewhere").otherwise(F.col("subject_raw")))
    made, gone = reconcile.follow(before, moved.where("id <> 'c'"), none, none)
    assert made.isEmpty() and sorted(tuple(r) for r in gone.collect()) == [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    together = before.withColumn("subject_raw", F.when(F.col("id").isin("c", "d"), "Elsewhere").otherwise(F.col("subject_raw")))
    made, gone = reconcile.follow(before, together, none, none)
    assert [(r.claim_a_id, r.claim_b_id) for r in made.collect()] == [("c", "d")] and gone.count() == 4
