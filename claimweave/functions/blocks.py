"""What makes claims comparable: the block of subject and measure that they are in, and where stored blocks lie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions.text import normalise_subject


def block_subject() -> Column:
    return normalise_subject(F.col("subject_raw"))


def block_measure() -> Column:
    return F.coalesce(F.nullif(F.col("measure_key"), F.lit("")), F.lower("measure_raw"))


def bucket(of: int) -> Column:
    """The number of a claim's bucket: claims of one block share it."""
    return F.pmod(F.xxhash64(block_subject(), block_measure()), F.lit(of)).cast("int")
