"""Ranked lexical search: every document is scored for every item by sort-based accumulation.

Documents become postings once: how often each holds the terms that items ask for. Each task takes a range of
documents; it concatenates (item, document, impact) for all matches, sorts them by packed keys with a radix sort, sums
each key's impacts by numpy's reduceat, and keeps an item's best documents on a heap. Best lists of tasks are merged in
two steps, so that no task gets the lists of all others. Scores are 64-bit integers, so sums don't depend on any order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.common import cut, small_arrow, table
from claimweave.llm.decontaminate import words_of

#: (item, term) pairs that one scan of the documents serves; matches that are sorted together.
MOST_PAIRS, MATCHES = 200_000, 2_000_000
_NO_ID = np.iinfo(np.int64).max


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                terms = pa.array(sorted(set(words_of(text))), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(terms), pa.int64())), terms], ["item", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(id_col, text_col).mapInArrow(run, f"item {kind}, term string").distinct()


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """docs (id, text) to (id, n, terms, times): the number of all terms, and the numbers of those asked for with how often they occur."""
    number = {term: k for k, term in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda ends, parts: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
        for batch in batches:
            n, found, times = [], [], []
            for value in batch.column("text").cast(pa.binary()):
                words = words_of(value.as_py())
                at = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
                which, count = np.unique(at[at >= 0], return_counts=True)
                n.append(len(words))
                found.append(which)
                times.append(count.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), lists(ends, found), lists(ends, times)], ["id", "n", "terms", "times"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, times array<int>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys (uint64), by one counting pass for each 16 bits; digits that are in order need none."""
    order = np.arange(len(keys))
    for shift in range(0, 64, 16):
        if not (keys >> np.uint64(shift)).any():
            break
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)[order]
        if (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


class Ranker:
    """Heaps with the most best documents of each item. A term's items stand at items[first[term] : first[term + 1]]."""

    def __init__(self, n_items: int, first: np.ndarray, items: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, most: int) -> None:
        self.first, self.items, self.weights, self.n_docs, self.n_terms, self.most = first, items, weights, n_docs, n_terms, most
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(n_items)]

    def add(self, ids: np.ndarray, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        """Documents with counts postings each, which stand in terms and times one after the other; _NO_ID for null ids."""
        matches = np.concatenate(([0], np.cumsum(self.first[terms + 1] - self.first[terms])))
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = 0
        while at < len(ids):  # at least one document, else as many as have MATCHES together
            upto = int(np.searchsorted(matches[ends], matches[ends[at]] + MATCHES, side="right")) - 1
            upto = min(max(upto, at + 1), at + 0xFFFF, len(ids))
            own = slice(ends[at], ends[upto])
            self._add(ids[at:upto], n[at:upto], counts[at:upto], terms[own], times[own])
            at = upto

    def _add(self, ids: np.ndarray, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        doc = np.repeat(np.arange(len(ids)), counts)
        length = 10 + (90 * n * self.n_docs) // self.n_terms
        impact = self.weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * length[doc]))
        many = self.first[terms + 1] - self.first[terms]
        source = np.repeat(np.arange(len(terms)), many)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
        keys = (self.items[self.first[terms[source]] + nth] << 16 | doc[source]).astype(np.uint64)
        order = radix_order(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
        if not len(starts):
            return
        scores, keys = np.add.reduceat(impact[source[order]], starts), keys[starts]
        item, of = (keys >> np.uint64(16)).astype(np.int64), ids[(keys & np.uint64(0xFFFF)).astype(np.int64)]
        edges = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            heap = self.heaps[item[lo]]
            here = np.flatnonzero(scores[lo:hi] >= max(1, heap[0][0] if len(heap) == self.most else 1)) + lo
            for k in here[best(scores[here], of[here], self.most)]:
                entry = (int(scores[k]), -1 if of[k] == _NO_ID else 0, -int(of[k]))
                if len(heap) < self.most:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the most highest scores, of equal ones those with the least ids."""
    if len(scores) <= most:
        return np.arange(len(scores))
    limit = np.partition(scores, len(scores) - most)[len(scores) - most]
    over, ties = np.flatnonzero(scores > limit), np.flatnonzero(scores == limit)
    return np.concatenate((over, ties[np.argsort(ids[ties], kind="stable")[: most - len(over)]]))


def _searched(docs: DataFrame, asked: dict[str, list], kind: str, most: int) -> DataFrame:
    """(item, id, score), the best documents (id, text) for each item in each partition; asked: a term's items."""
    terms = sorted(asked)
    found = cut(postings(docs, [t.encode() for t in terms]))
    total = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holds = dict(found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect())
    names = list(dict.fromkeys(item for term in terms for item in asked[term]))
    number = {item: k for k, item in enumerate(names)}
    first = np.cumsum([0, *(len(asked[term]) for term in terms)])
    items = np.array([number[item] for term in terms for item in asked[term]], np.int64)
    weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * holds.get(k, 0) + 1))) for k in range(len(terms))], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(len(names), first, items, weights, total.docs, total.terms, most)
        for batch in batches:
            ids = batch.column("id").fill_null(_NO_ID).to_numpy()
            own, times = batch.column("terms"), batch.column("times")
            ranker.add(ids, batch.column("n").to_numpy(), own.value_lengths().to_numpy().astype(np.int64), own.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64))
        kept = [(names[k], None if no_id else -minus, score) for k, heap in enumerate(ranker.heaps) for score, no_id, minus in sorted(heap, reverse=True)]
        yield pa.RecordBatch.from_pylist([{"item": i, "id": d, "score": s} for i, d, s in kept], schema)

    schema = pa.schema([("item", kind_of(kind)), ("id", pa.int64()), ("score", pa.int64())])
    return found.mapInArrow(run, f"item {kind}, id long, score long")


def kind_of(name: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(name, pa.int64())


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = 10, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(item_id, rank, id_col, score): the most highest-scoring documents of each item, all documents looked at.

    A score sums, over the item's distinct terms, weight * (10**9 * tf div (1000 * tf + 8 * m)), where m is
    10 + 90 * n * N div L; only scores above 0 count. Equal scores rank by ascending id, null ids after all others. Null
    and empty texts have no terms, match nothing and don't count in N; an item without terms, or none of whose terms
    occurs, gives no rows. Rows that share an item's id, null too, are one item with the terms of all. Repeated
    documents are documents of their own. Very long texts count whole. Empty tables give no rows. Item ids are
    integers or strings, document ids integers. Other columns aren't read.

    Documents are scanned once for each most_pairs (item, term) pairs, so that what a task holds stays bounded.
    """
    small_arrow(docs.sparkSession)
    kind = items.schema[item_id].dataType.simpleString()
    kind = kind if kind in ("string", "int") else "bigint"
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pairs = cut(item_terms(items.select(F.col(item_id).cast(kind).alias(item_id), F.col(item_text).alias(item_text)), item_id, item_text))
    blocks = -(-pairs.count() // most_pairs)
    out = docs.sparkSession.createDataFrame([], f"item {kind}, id long, score long, part int")
    for k in range(blocks):
        asked: dict[str, list] = {}
        for r in pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect():
            asked.setdefault(r.term, []).append(r.item)
        if asked:
            found = _searched(named, asked, kind, most)
            out = out.union(found.withColumn("part", F.spark_partition_id() % F.lit(max(1, math.isqrt(found.rdd.getNumPartitions())))))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    some = out.withColumn("rank", rank("item", "part")).where(F.col("rank") <= most)
    return some.withColumn("rank", rank("item")).where(F.col("rank") <= most).select(F.col("item").alias(item_id), "rank", F.col("id").alias(id_col), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH texts AS (SELECT doc_id AS id, true AS is_doc, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
w AS (SELECT id, is_doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM texts),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM w WHERE is_doc AND len(w) > 0),
asked AS (SELECT DISTINCT id AS item_id, unnest(w) AS term FROM w WHERE NOT is_doc),
found AS (SELECT id AS doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT id, len(w)::BIGINT AS n, unnest(w) AS term FROM w WHERE is_doc) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM found GROUP BY 1), corpus),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS impact FROM found JOIN weights USING (term), corpus),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM impacts JOIN asked USING (term) GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
