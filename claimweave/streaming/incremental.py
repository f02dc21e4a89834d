"""Claims that arrive as files: each micro-batch is compared with what is stored, and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from claimweave.functions.schema import CLAIM
from claimweave.plans.changes import apply
from claimweave.sources.store import Store


def add_claims(store: Store, batch: DataFrame) -> None:
    """Put a batch into the store; relations follow, also of claims that arrive again with other values.

    Of repeated ids one row counts. A batch that is run again changes nothing.
    """
    apply(store, batch)


def stream_claims(spark: SparkSession, path: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Follow a folder of Parquet files of claims until the query is stopped."""
    schema = StructType.fromDDL(CLAIM)
    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(lambda batch, _: add_claims(store, batch)).option("checkpointLocation", checkpoint).start()
