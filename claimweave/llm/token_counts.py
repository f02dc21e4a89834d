"""Token counts of whole texts by overlapping chunks that are spliced at proven boundaries.

A text longer than a block is cut into blocks; each chunk is a block with the first characters of the next
one. Chunks are encoded apart from each other, and two neighbours are spliced at a position that

* is a token boundary in the encodings of both, and
* lies where a run of letters or a run of digits ends. The pre-tokenizer's pattern has no alternative that goes
  on from a letter to something else, or from a digit to something else, whatever came before, so the
  encodings to the left and to the right of it are independent of each other; and
* is farther from the left chunk's end than any special string is long, so no such string is cut there.

The left chunk's tokens count up to this position and the right chunk's from there. Where a pair of neighbours has
no such position, the whole text goes into the next round with blocks and overlaps of twice the length; a text
that fits into one block needs no splice, so the rounds end.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.common import bounded, cut, table

BLOCK, OVERLAP, MARGIN = 16_384, 512, 16
STABLE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder for a ranks file, and each id's length in bytes."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max([*ranks.values(), *(i for _, i in special)]) + 1, dtype=np.int64)
    for piece, i in ranks.items():
        lengths[i] = len(piece)
    for text, i in special:
        lengths[i] = len(text.encode())
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special)), lengths


def _marks(overlap: str, ends: np.ndarray, at: int, most: int) -> tuple[list[int], list[int]]:
    """Splice positions within an overlap, as bytes from its start, and the chunk's tokens before each.

    ends: where the chunk's tokens end, in bytes from the chunk's start; at: where the overlap starts there.
    """
    found = [len(overlap[:p].encode()) for p in (m.start() for m in STABLE.finditer(overlap)) if 0 < p <= most]
    before = np.searchsorted(ends, np.array(found, dtype=np.int64) + at)
    kept = [(p, int(k) + 1) for p, k in zip(found, before, strict=True) if k < len(ends) and ends[k] == p + at]
    return [p for p, _ in kept], [k for _, k in kept]


def _encode(path: str, pattern: str, special: tuple[tuple[str, int], ...], overlap: int):
    names = ["id", "sha", "chunk", "n_bytes", "n_tokens", "last", "head", "head_n", "tail", "tail_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(path, pattern, special)
        for batch in batches:
            got: dict[str, list] = {k: [] for k in names[4:5] + names[6:]}
            for i, whole in enumerate(zip(batch.column("sha").is_null().to_pylist(), batch.column("last").to_pylist(), strict=True)):
                text = batch.column("piece")[i].as_py()
                ids = encoding.encode(text, allowed_special="all")
                row: tuple = ([], [], [], [])
                if not whole[0]:
                    ends = np.cumsum(lengths[np.array(ids, dtype=np.int64)]) if ids else np.zeros(0, np.int64)
                    start, size = text[:overlap], batch.column("block")[i].as_py()
                    head = _marks(start, ends, 0, len(start)) if batch.column("chunk")[i].as_py() else ([], [])
                    rest = "" if whole[1] else text[size:]
                    tail = _marks(rest, ends, len(text[:size].encode()), len(rest) - MARGIN) if rest else ([], [])
                    row = (*head, *tail)
                for k, v in zip(got, (len(ids), *row), strict=True):
                    got[k].append(v)
            kind = {"n_tokens": pa.int64(), **{k: pa.list_(pa.int64()) for k in names[6:]}}
            yield pa.RecordBatch.from_arrays([pa.array(got[k], kind[k]) if k in got else batch.column(k) for k in names], names)

    return run


def _pieces(texts: DataFrame, block: int, overlap: int) -> DataFrame:
    """Chunks of texts (id, n_bytes, text, sha): regexp_extract_all cuts all blocks in one pass over the text.

    A last block that isn't longer than the overlap is whole in the chunk before it, and is no chunk of its own.
    """
    blocks = F.expr(f"regexp_extract_all(text, '(?s).{{1,{block}}}', 0)")
    n = F.size("blocks") - F.when((F.size("blocks") > 1) & (F.length(F.get("blocks", F.size("blocks") - 1)) <= overlap), 1).otherwise(0)
    chunks = texts.select("id", "sha", "n_bytes", blocks.alias("blocks")).withColumn("n", n).select(
        "id", "sha", "n_bytes",
        F.posexplode(F.transform(F.slice("blocks", F.lit(1), F.col("n")), lambda b, i: F.struct(
            F.concat(b, F.coalesce(F.substring(F.get("blocks", i + 1), 1, overlap), F.lit(""))).alias("piece"),
            (i == F.col("n") - 1).alias("last"),
        ))).alias("chunk", "c"),
    )
    return chunks.select("id", "sha", F.col("chunk").cast("long").alias("chunk"), "n_bytes", "c.piece", "c.last", F.lit(block).alias("block"))


def token_counts(docs: DataFrame, path: str, pattern: str, special: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """Count each text's tokens: (id_col, n_bytes, n_tokens), one row for each row of docs.

    path: a ranks file of a byte-level BPE; pattern: its pre-tokenizer's; special: strings that are single tokens
    wherever they stand. Null texts count as empty; empty texts have no tokens; null ids stay null; repeated rows
    each keep their row; an empty table gives no rows; very long texts are counted whole, in pieces. There are no ties.
    Other columns, whatever their names, are not read.
    """
    marks = tuple(sorted((special or {}).items()))
    overlap = max(overlap, 4 * MARGIN)
    if any(len(s) >= MARGIN for s, _ in marks):
        raise ValueError(f"special strings must be shorter than {MARGIN} characters")
    schema = "id {0}, sha string, chunk long, n_bytes long, n_tokens long, last boolean, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>".format(docs.schema[id_col].dataType.simpleString())
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"), (F.length("text") > block).alias("long"))
    short = texts.where(~F.col("long")).select("id", F.lit(None).cast("string").alias("sha"), F.lit(0).cast("long").alias("chunk"), "n_bytes", F.col("text").alias("piece"), F.lit(True).alias("last"), F.lit(block).alias("block"))
    done = [short.mapInArrow(_encode(path, pattern, marks, 0), schema).select("id", "n_bytes", "n_tokens")]
    todo = texts.where("long").select("id", "n_bytes", "text", F.sha2("text", 256).alias("sha"))
    while True:
        # Chunks of huge texts are dealt out evenly, so no task encodes one such text alone.
        pieces = _pieces(todo, block, overlap).repartition("id", "sha", "chunk")
        encoded = pieces.mapInArrow(_encode(path, pattern, marks, overlap), schema)
        one = encoded.groupBy("id", "sha", "chunk").agg(F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in ("n_bytes", "n_tokens", "last", "head", "head_n", "tail", "tail_n")))
        order = Window.partitionBy("id", "sha").orderBy("chunk")
        at = lambda found, n, p: F.try_element_at(F.col(n), F.array_position(F.col(found), p).cast("int"))
        spliced = (
            one.withColumn("next_head", F.lead("head").over(order))
            .withColumn("end", F.when(~F.col("last"), F.array_max(F.array_intersect("tail", "next_head"))))
            .withColumn("start", F.lag("end").over(order))
            .withColumn("failed", ~F.col("last") & F.col("end").isNull())
            .withColumn("from", F.when(F.col("start").isNull(), F.lit(0)).otherwise(at("head", "head_n", F.col("start"))))
            .withColumn("to", F.when(F.col("end").isNull(), F.col("n_tokens")).otherwise(at("tail", "tail_n", F.col("end"))))
        )
        result = cut(spliced.groupBy("id", "sha").agg(F.max("n_bytes").alias("n_bytes"), F.sum(F.col("to") - F.col("from")).alias("n_tokens"), F.max("copies").alias("copies"), F.bool_or("failed").alias("failed")))
        done.append(result.where(~F.col("failed")).select("id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col"))
        failed = result.where("failed").select(F.col("id").alias("f_id"), F.col("sha").alias("f_sha"))
        if failed.isEmpty():
            break
        todo = todo.join(bounded(failed, 100_000), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("sha") == F.col("f_sha")), "left_semi")
        block, overlap = 2 * block, 2 * overlap
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
