"""Pages of relations in the order of review, from a table that is sorted so: any page reads the few files that hold it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from claimweave.plans.views import review_rank

#: Relations of one file, and the most of a page.
FILE_ROWS, PAGE_ROWS = 100_000, 500
#: Files that a task sorts and writes, and the bits that Spark's row numbers have for the row.
TASK_FILES, ROW_BITS = 64, (1 << 33) - 1
KEYS = ("rank", "within", "doubt", "id")


def _keyed(relations: DataFrame) -> DataFrame:
    """With the order of review as four columns that all rise."""
    return relations.withColumns({"rank": review_rank(F.col("verdict")), "within": F.when(F.col("cross_doc"), 0).otherwise(1), "doubt": -F.col("confidence")})


def write_pages(relations: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write relations under path, dealt by range of the order of review and sorted in it, with how many each file holds.

    What was written there before is replaced; no relations give an empty table. A task sorts the rows of TASK_FILES
    files and cuts them into these. Relations are computed once: they are written as they come, then read for the sort.
    """
    spark, staged = relations.sparkSession, f"{path}/staged-{uuid.uuid4().hex}"
    _keyed(relations).write.parquet(staged)
    found = spark.read.parquet(staged)
    tasks = max(1, -(-found.count() // (file_rows * TASK_FILES)))
    dealt = found.repartitionByRange(tasks, *KEYS).sortWithinPartitions(*KEYS).withColumn("at", F.monotonically_increasing_id())
    row = F.col("at").bitwiseAND(F.lit(ROW_BITS))
    cut = dealt.withColumn("file", F.col("at") - row + F.floor(row / file_rows)).drop("at").sortWithinPartitions("file", *KEYS)
    cut.write.mode("overwrite").partitionBy("file").parquet(f"{path}/rows")
    found.limit(0).write.mode("overwrite").parquet(f"{path}/columns")  # an empty table has no other file
    rows = _rows(spark, path)
    last = F.max(F.struct(*KEYS)).alias("last")
    rows.groupBy("file").agg(F.count("*").alias("n"), last).write.mode("overwrite").parquet(f"{path}/index")
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def total(spark: SparkSession, path: str) -> int:
    """How many relations there are, by the index."""
    return spark.read.parquet(f"{path}/index").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("file", LongType())).parquet(f"{path}/rows")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, list[Row]]:
    """The rows, and a row for each file in order: the index has one line for each FILE_ROWS relations."""
    return _rows(spark, path), spark.read.parquet(f"{path}/index").orderBy("file").collect()


def _after(cursor: dict) -> object:
    """Rows after the cursor, as conditions on the sorted columns that Parquet's statistics can answer."""
    out, equal = F.lit(False), F.lit(True)
    for k in KEYS:
        out = out | (equal & (F.col(k) > cursor[k]))
        equal = equal & (F.col(k) == cursor[k])
    return out


def _page(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(*KEYS).limit(limit).drop("file")


def _checked(limit: int) -> None:
    if not 0 <= limit <= PAGE_ROWS:
        raise ValueError(f"limit must be from 0 to {PAGE_ROWS}")


def page_after(spark: SparkSession, path: str, cursor: Row | dict | None = None, limit: int = 50) -> DataFrame:
    """The next limit relations after cursor, the last row of the page before (None: from the start), with KEYS for the next cursor.

    Only the files are read that can hold them: that of the cursor and as many after it as the page needs.
    """
    _checked(limit)
    rows, index = _read(spark, path)
    at = None if cursor is None else {k: cursor[k] for k in KEYS}
    chosen, there = [], 0
    for r in index:
        if at is not None and tuple(r["last"]) <= tuple(at[k] for k in KEYS):
            continue
        chosen.append(r["file"])
        there += r["n"] if at is None or len(chosen) > 1 else 0  # of the cursor's own file an unknown part
        if there >= limit:
            break
    found = rows.where(F.col("file").isin(chosen) if chosen else F.lit(False))
    return _page(found if at is None else found.where(_after(at)), limit)


def page_at(spark: SparkSession, path: str, offset: int, limit: int = 50) -> DataFrame:
    """limit relations from the offset-th on, without reading those before: files are skipped by how many rows they hold."""
    _checked(limit)
    if offset < 0:
        raise ValueError("offset must not be negative")
    rows, index = _read(spark, path)
    chosen, skipped, there = [], None, 0
    for r in index:
        if there + r["n"] > offset and there < offset + limit:
            chosen.append(r["file"])
            skipped = there if skipped is None else skipped
        there += r["n"]
    found = rows.where(F.col("file").isin(chosen) if chosen else F.lit(False))
    return found.orderBy(*KEYS).offset(offset - (skipped or 0)).limit(limit).drop("file")
