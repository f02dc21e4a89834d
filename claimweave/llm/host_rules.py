"""Quality rules: a base rule for each text, and a verdict for each host from its texts' failures.

A host's failure rate is shrunk by a beta prior that is fitted to all hosts' counts by the method of moments: hosts
with few texts stay near the corpus's rate. Hosts whose shrunk rate is above a limit lose all their texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import bounded, cut, small, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED, HOST_LIMIT = 50, 50, 0.6
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often, covered, n = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def figures(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # bytes are split at space and tab to carriage return
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_figures(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and the figures of each whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = [figures(t.as_py() or "") for t in batch.column(len(keys))]
            columns = zip(*got, strict=True) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, pa.int64()) for c in columns)], [*keys, *FIGURES])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text_col).mapInArrow(run, f"{kinds}, " + ", ".join(f"{f} long" for f in FIGURES))


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """judged (host, base_failed) to (host, n, n_failed, rate, rejected), one row for each host that isn't null.

    The prior: with m the corpus's rate and v the hosts' variance around it beyond what counts of that size show by
    chance, alpha + beta = m (1 - m) / v - 1, between 1 and 1e6.
    """
    hosts = cut(judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("n_failed")))
    n, failed, h = hosts.agg(F.sum("n"), F.sum("n_failed"), F.count("*")).first()
    m = F.lit(failed / n if n else 0.0)
    # Each term is rounded and summed as a decimal: the verdict doesn't depend on the order of the rows.
    total = lambda c: F.sum(F.round(c, 9).cast("decimal(20,9)")).cast("double")
    around, chance = hosts.agg(total(F.pow(F.col("n_failed") / F.col("n") - m, 2)), total(m * (1 - m) / F.col("n"))).first()
    mean = failed / n if n else 0.0
    spread = max(((around or 0.0) - (chance or 0.0)) / max(h - 1, 1), 1e-9)
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
    rate = F.round((F.col("n_failed") + m * weight) / (F.col("n") + weight), 6)
    return hosts.select("host", "n", "n_failed", rate.alias("rate"), (rate > limit).alias("rejected"))


def fails(n_words, n_repeat_words):
    """The base rule, on numbers or on columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def _judged(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    named = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    return cut(base_figures(named, ["id", "host"]).withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words"))))


def _rejected(judged: DataFrame, limit: float) -> DataFrame:
    """Only rejected hosts are joined; texts of a hot host are split by Spark where the join shuffles."""
    return bounded(cut(host_verdicts(judged, limit).where("rejected").select("host", "rejected")), 100_000)


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """(id_col, figures, base_failed, kept), one row for each row of docs.

    Null texts have no words and fail the base rule; texts without a host are judged by the base rule alone;
    repeated rows each get theirs. Very long texts are read whole. A rate equal to the limit, the one tie there can be,
    keeps its host. An empty table gives no rows; other columns are not read.
    """
    judged = _judged(docs, id_col, host_col, text_col)
    joined = judged.join(_rejected(judged, limit), "host", "left")
    return joined.select(F.col("id").alias(id_col), *FIGURES, "base_failed", (~F.col("base_failed") & F.col("rejected").isNull()).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """docs without those that judge() rejects, all columns as they were, whatever their names; repeated rows alike."""
    rejected = _rejected(_judged(docs, id_col, host_col, text_col), limit)

    rows = docs.select(F.struct("*").alias("row"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = (figures(v.as_py() or "") for v in batch.column("row").flatten()[at])
            yield batch.filter(pa.array([not fails(f[0], f[4]) for f in found], pa.bool_()))

    good = rows.mapInArrow(run, rows.schema)
    return good.join(rejected, good["row"].getField(host_col) == rejected["host"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, source, w, t,
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM base),
pos AS (SELECT doc_id, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM pos) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
fig AS (
  SELECT b.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN cov USING (doc_id)),
jud AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM fig),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM jud WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(f)::DOUBLE / sum(n)::DOUBLE AS m, count(*) AS h FROM hosts),
p AS (SELECT max(m) AS m, least(greatest(max(m) * (1 - max(m)) / greatest(
    (sum(round(power(f::DOUBLE / n - m, 2), 9)::DECIMAL(20,9))::DOUBLE - sum(round(m * (1 - m) / n, 9)::DECIMAL(20,9))::DOUBLE)
    / greatest(max(h) - 1, 1), 1e-9) - 1, 1.0), 1e6) AS weight FROM hosts, s),
bad AS (SELECT source FROM hosts, p WHERE round((f + m * weight) / (n + weight), 6) > 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND source IS DISTINCT FROM ALL (SELECT source FROM bad)) AS kept FROM jud
"""
ORACLE = ORACLE.replace("source IS DISTINCT FROM ALL (SELECT source FROM bad)", "NOT EXISTS (SELECT 1 FROM bad WHERE bad.source = jud.source)")
