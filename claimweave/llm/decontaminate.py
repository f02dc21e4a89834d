"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, through which each text goes once.

Texts are normalised to words, and the automaton reads words, not characters: each word that a window holds has a
code of a few characters, all others share one, and a code's k-th character is of the k-th alphabet, so matches lie on
word borders. A match gives the numbers of the words it covers, and the words' places in the original text follow from
its bytes. Where windows are too many for one automaton, texts go through several, and what these find is merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import bounded, cut, small_arrow, table

#: Words of a window, and the (window, item) pairs of one automaton, which at ten words has at most some 3,000,000 states.
WINDOW, MOST_PAIRS = 10, 100_000
_ALPHABET = 32
#: Lower-cases A-Z and blanks what is in no word: all of ASCII but letters and digits.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class Matcher:
    """The automaton of windows, given as (words joined by spaces, item) pairs; an item may be null."""

    def __init__(self, pairs: Iterable[tuple[str, str | None]]) -> None:
        items = defaultdict(set)
        for window, item in pairs:
            items[window].add(item)
        split = {window: window.encode().split(b" ") for window in items}
        known = sorted({word for words in split.values() for word in words})
        self.width = 1
        while _ALPHABET**self.width < len(known) + 1:
            self.width += 1
        self.codes = {word: self._code(k) for k, word in enumerate(known, 1)}
        self.other = self._code(0)
        self.automaton = ahocorasick.Automaton()
        for window, words in split.items():
            self.automaton.add_word("".join(map(self.codes.__getitem__, words)), (len(words), tuple(items[window])))
        self.automaton.make_automaton()

    def _code(self, k: int) -> str:
        return "".join(chr(_ALPHABET * place + k // _ALPHABET**place % _ALPHABET) for place in range(self.width))

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """The number of words, the first and last word of each stretch of hit words, and the items whose windows occur."""
        words = words_of(text)
        found, items = [], set()
        if self.codes:
            for end, (n, of) in self.automaton.iter("".join(map(self.codes.get, words, repeat(self.other)))):
                last = end // self.width
                found.append((last - n + 1, last))
                items.update(of)
        return len(words), joined(found), items


def joined(stretches: Iterable[tuple]) -> list[tuple]:
    """Stretches (first, last, ...) as disjoint ones in order; further pairs (start, end) go along."""
    out: list[list] = []
    for s in sorted(stretches):
        if out and s[0] <= out[-1][1] + 1:
            if s[1] > out[-1][1]:
                out[-1][1::2] = s[1::2]
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def places(text: bytes, stretches: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first, last) words with the code points of the original text from which and before which they stand."""
    raw = np.frombuffer(text.translate(_NORMAL), np.uint8)
    gap = np.concatenate(([True], raw == 32, [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # continuation bytes begin no character
    return [(first, last, int(points[edges[2 * first]]), int(points[edges[2 * last + 1]])) for first, last in stretches]


SPANS = "array<struct<first: long, last: long, start: long, end: long>>"
_SPANS = pa.list_(pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "end")]))


def windows(items: DataFrame, item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, item): each run of size words of an item, once; an item of fewer words is one run, one without words none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                found = sorted({b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else ())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array([item.as_py()] * len(found), pa.string())], ["window", "item"])

    return items.select(F.col(item_id).cast("string"), item_text).mapInArrow(run, "window string, item string").distinct()


def _scanned(docs: DataFrame, pairs: list[tuple[str, str | None]], only_hit: bool) -> DataFrame:
    """docs (id, mark, text) to (id, mark, n_words, spans, items), by one automaton."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, mark long, n_words long, spans {SPANS}, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(pairs)
        for batch in batches:
            n, spans, items = [], [], []
            for value in batch.column("text").cast(pa.binary()):
                text = value.as_py()
                count, found, of = matcher.scan(text)
                n.append(count)
                spans.append([dict(zip(("first", "last", "start", "end"), s, strict=True)) for s in places(text, found)] if found else [])
                items.append(sorted(i for i in of if i is not None))
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["id", "mark", "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hit else out

    return docs.mapInArrow(run, schema)


def _merged(found: DataFrame) -> DataFrame:
    """Rows with the spans of several automata, which may overlap, to rows with disjoint ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("first", "last", "start", "end"), s, strict=True)) for s in joined(tuple(x.values()) for x in row)] for row in batch.column("spans").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(spans, _SPANS))

    return found.mapInArrow(run, found.schema)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(id_col, n_words, n_hit, spans, items), one row for each row of docs: what of its text is in test items.

    A word is hit if an occurrence of a window covers it. spans are the stretches of hit words: numbers of their first
    and last word from 0, and the code points of the text from which and before which they stand. items are the ids, as
    strings in order, of items whose windows occur. A null or empty text has no words. An item without words, null ones
    too, has no windows; windows of an item with a null id hit words, but the id isn't listed. Rows that repeat an
    item's id add windows to it. Repeated rows and null ids of docs each keep their row; ties can't arise. Very long
    texts are scanned whole. Without items nothing is hit; no docs give no rows. Other columns aren't read.
    """
    small_arrow(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    known = cut(windows(items, item_id, item_text, size))
    blocks = -(-known.count() // most_pairs) or 1
    part = lambda k: [(r.window, r.item) for r in known.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k).collect()]
    found = _scanned(named, part(0), only_hit=False)
    if blocks > 1:
        more = _scanned(named, part(1), only_hit=True)
        for k in range(2, blocks):
            more = more.union(_scanned(named, part(k), only_hit=True))
        # Repeated rows have equal findings, so one row for each id and text is joined to all of them.
        once = more.dropDuplicates(["id", "mark", "spans", "items"]).groupBy(F.col("id").alias("m_id"), F.col("mark").alias("m_mark")).agg(F.flatten(F.collect_list("spans")).alias("m_spans"), F.flatten(F.collect_list("items")).alias("m_items"))
        once = bounded(cut(once), 100_000)
        both = lambda c, kind: F.concat(F.col(c), F.coalesce(f"m_{c}", F.array().cast(kind))).alias(c)
        found = _merged(found.join(once, found["id"].eqNullSafe(once["m_id"]) & (found["mark"] == once["m_mark"]), "left").select("id", "mark", "n_words", both("spans", SPANS), F.array_sort(F.array_distinct(both("items", "array<string>"))).alias("items")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "spans", "items")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH texts AS (SELECT doc_id AS id, true AS is_doc, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
w AS (SELECT id, is_doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
items AS (SELECT id, len(w) AS many, least(len(w), 10) AS n, w FROM w WHERE NOT is_doc AND len(w) > 0),
win AS (SELECT DISTINCT id AS item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, many - n + 2)) AS i FROM items)),
runs AS (SELECT id AS doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE is_doc AND len(w) >= n),
hits AS (SELECT doc_id, r.i, r.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM runs) r JOIN win ON r.g = win.g AND r.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered ON w.id = covered.doc_id LEFT JOIN named ON w.id = named.doc_id WHERE is_doc
"""
