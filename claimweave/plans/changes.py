"""Claims that come, change or go, and the stored relations that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.blocks import block_measure, block_subject
from claimweave.functions.schema import CLAIM, conform
from claimweave.operators import reconcile
from claimweave.sources.store import DEALT, Store, bounded, checkpointed

BLOCK = ["_subject", "_measure"]


def _blocks(claims: DataFrame) -> DataFrame:
    return claims.withColumns({"_subject": block_subject(), "_measure": block_measure()})


def _numbers(df: DataFrame, column: str = "bucket") -> list[int]:
    """The distinct buckets of df: at most as many as a table has."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def touched(store: Store, put: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What claims that are put, and those with ids that go or are replaced, touch: (old, before, negative then, negative now).

    old: the stored claims with these ids. before: all stored claims of the blocks of either, and of all blocks of
    measures that go negative now and didn't, or did and don't. Where claims lie is looked up by their ids alone;
    otherwise the buckets that hold these blocks are read and no others, and the stored side isn't shuffled unless the
    other one is too large to broadcast.
    """
    spread = DEALT["claims"](store.buckets)
    old = checkpointed(store.read("claims", store.buckets_of("claims", ids)).join(ids, "id", "left_semi"))
    changed = put.unionByName(old)
    measures = bounded(changed.where("measure_key <> ''").select("measure_key").distinct())
    below = store.read("claims").where("canonical_low < 0").select("id", "measure_key").join(measures, "measure_key", "left_semi")
    stays = below.join(ids.withColumn("_goes", F.lit(True)), "id", "left").groupBy("measure_key").agg(F.bool_or(F.col("_goes").isNull()).alias("now"))
    put_below = put.where("canonical_low < 0 and measure_key <> ''").select("measure_key", F.lit(False).alias("then"), F.lit(True).alias("now"))
    negative = checkpointed(stays.select("measure_key", F.lit(True).alias("then"), "now").unionByName(put_below).groupBy("measure_key").agg(F.bool_or("then").alias("then"), F.bool_or("now").alias("now")))
    turned = bounded(negative.where("then <> now").select("measure_key"))
    there = set(_numbers(changed.withColumn("bucket", spread)))
    if not turned.isEmpty():
        there |= set(store.buckets_of("claims", turned))
    stored = store.read("claims", sorted(there))
    own = bounded(_blocks(changed).select(*BLOCK).distinct().where("_subject is not null and _measure is not null"))
    of_blocks = _blocks(stored).join(own, BLOCK, "left_semi").select(*stored.columns)
    others = _blocks(stored).join(own, BLOCK, "left_anti").select(*stored.columns).join(turned, "measure_key", "left_semi").select(*stored.columns)
    return old, checkpointed(of_blocks.unionByName(others)), negative.where("then").select("measure_key"), negative.where("now").select("measure_key")


def apply(store: Store, put: DataFrame, gone: DataFrame | None = None, cap: int | None = reconcile.BLOCK_CAP) -> DataFrame:
    """Put claims into the store and take out those with the ids of gone; returns the relations that were made.

    Relations of claims that changed, went, or whose measure has come to go negative or doesn't any more, are withdrawn
    and made again, so that the stored ones are those of a full run over the stored claims with the same cap. Others
    aren't looked at. Running a change again changes nothing: relations are written before claims, so a run that was
    cut off finds the claims as they were. Of repeated ids in put one row counts; claims that are both put and gone are put.
    """
    put = checkpointed(conform(put.dropDuplicates(["id"]), CLAIM))
    ids = put.select("id") if gone is None else put.select("id").union(gone.select("id")).distinct()
    ids = bounded(ids)
    old, before, then, now = touched(store, put, ids)
    after = before.join(ids, "id", "left_anti").unionByName(put)
    made, withdrawn = reconcile.follow(before, after, then, now, cap)
    written = store.upsert("relations", made, gone=withdrawn, unique=True)
    store.upsert("claims", put, gone=old)
    return written
