"""From raw documents to a token mixture: each stage applies one operator of claimweave.llm to what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import bpe_codec, co_training, host_rules, minmax_dedup, source_mixing
from claimweave.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rule or whose host is rejected.

    Null, empty and blank texts have no words and go; a null source has no host verdict; repeated rows are judged
    alike; a rate that equals the limit keeps its host. All columns stay, whatever their names; no rows give no rows.
    """
    return host_rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the co-trained classifiers reject.

    Nulls in text or metadata are values like others; repeated rows get the same verdict; a score that equals the
    limit keeps its document. Without held-out labels of both classes all stay. All columns stay; no rows give no rows.
    """
    return co_training.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: five words to a shingle, similarity from 0.8.

    The rows' texts decide, so the unlike texts of a repeated id are documents of their own; the least id stays, a
    null id only where no other has one, and of repeated rows one. Null, empty and blank texts are in no group.
    """
    return minmax_dedup.keep_one(docs, shingle=5, percent=80)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its leaf's budget says: a row for each epoch that it is in.

    Null sources and languages are leaves of their own; null texts have no tokens and go with the prefix they stand in;
    rows of one leaf with one id, null ids too, are taken together, so ties don't matter. All columns stay.
    """
    taken = source_mixing.mix_documents(spark, docs)
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text and decode it again: (doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row.

    A null text counts as empty, very long ones are encoded whole; null and repeated ids stay; no rows give no rows.
    """
    return bpe_codec.encode_and_decode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("source mixing", source_mixture),
    ("BPE", bpe_tokens),
]
#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each reading the Parquet files that the one before it wrote to the folder of the checkpoints."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
