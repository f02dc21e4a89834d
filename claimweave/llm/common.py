"""What the operators of this subpackage share: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what lies between these bytes: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it names none and all runs on one machine, as in tests, a local one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="claimweave-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's URI beside the checkpoints."""
    small_arrow(spark)
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of whole texts in one Arrow batch. Spark holds each batch several times: as it grows, as it is sent, in Python.
ARROW_ROWS = 500


def small_arrow(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold ARROW_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and go on from there: a lost executor then costs no more than the tasks it ran."""
    checkpoint_dir(df.sparkSession)
    small_arrow(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark removes the shuffle and checkpoint files of tables that nothing refers to any more.

    Iterative jobs call it between rounds; otherwise such files, and the classes of finished plans, stay until the
    driver's heap fills.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of which a task can hold several forms at a time; in the end Arrow gives back what it holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def bounded(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark df for broadcasting if it has at most most_rows rows; else leave the join to shuffle.

    df is counted, so it should be a checkpointed table.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
