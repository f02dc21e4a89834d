"""Scoring pages by the signs of facts on them, choosing pages to read, and what the choice leaves out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.sources.store import checkpointed

# What counts as each sign. Words and phrases stand between word boundaries, marks anywhere.
NUMBER = r"\d[\d,]*\.?\d*"
UNIT_MARKS = "₹$€£%"
UNIT_WORDS = r"per\s?cent|percent|crore|lakh|million|billion|trillion|mn|bn|cr|rs\.?|inr|usd|tons?|tonnes?|kg|gw|bps"
PERIOD_WORDS = r"fy\s?\d{2,4}|q[1-4]|(?:19|20)\d{2}|year ended|quarter ended|as (?:at|of)|half[- ]year|h[12]|fiscal|as on"
ENTITY_WORDS = r"director|chairman|chief \w+ officer|appointed|resigned|ceased|registered office|incorporat\w+|cin|din|secretary"
ASSERTION_WORDS = r"projected|expected|estimated?|forecast\w*|stood at|increased?|declined?|grew|recorded|reported|rose|was|is|amounted to|registering|compared (?:to|with)|revised|restated|assessed|placed at"
BOILERPLATE = r"(?imU)(table of contents|^\s*contents\s*$|this page (?:has been |is )?intentionally left blank)"
# One boundary test for all words of a sign: a pattern that begins each word with its own tries all of them at each character.
UNIT = rf"(?iU)[{UNIT_MARKS}]|\b(?:{UNIT_WORDS})\b"
PERIOD, ENTITY, ASSERTION = (rf"(?iU)\b(?:{words})\b" for words in (PERIOD_WORDS, ENTITY_WORDS, ASSERTION_WORDS))
#: (pattern, count at which about half of the weight is reached, weight)
SIGNS = {"numbers": (f"(?U){NUMBER}", 25.0, 2.0), "units": (UNIT, 8.0, 2.0), "periods": (PERIOD, 5.0, 2.0), "assertions": (ASSERTION, 6.0, 2.0), "entities": (ENTITY, 3.0, 1.5)}
SHORTEST, MIN_SCORE = 120, 1.5


def saturated(n: Column, half: float) -> Column:
    """0 for none, rising by the logarithm, 1 from four times half on."""
    return F.when(n > 0, F.least(F.log1p(n.cast("double")) / F.log1p(F.lit(half * 4)), F.lit(1.0))).otherwise(0.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def reasons(text: Column) -> dict[str, Column]:
    out = {name: saturated(F.regexp_count(text, F.lit(pattern)), half) * weight for name, (pattern, half, weight) in SIGNS.items()}
    out["prose"] = F.least(word_count(text) / 250.0, F.lit(1.0)) * 0.5
    out["boilerplate"] = F.when(F.rlike(text, F.lit(BOILERPLATE)), -3.0).otherwise(0.0)
    return out


def score_pages(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Add score (3 decimals) and its parts. A page under 120 characters, or without text, scores 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = F.length(text) >= SHORTEST
    scored = pages.select("*", F.when(long, F.struct(*(c.alias(n) for n, c in reasons(text).items()))).alias("reasons"))
    parts = [F.col(f"reasons.{n}") for n in (*SIGNS, "prose", "boilerplate")]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return scored.withColumn("score", F.coalesce(F.round(total, 3), F.lit(0.0)))


def choose(scored: DataFrame, min_score: float = MIN_SCORE, budget: int | None = None, doc_col: str = "doc_id", page_col: str = "page_no") -> DataFrame:
    """Pages from min_score on; with a budget, each document's best ones, ties by page number."""
    eligible = scored.where(F.col("score") >= min_score)
    if budget is None:
        return eligible
    rank = F.row_number().over(Window.partitionBy(doc_col).orderBy(F.desc("score"), page_col))
    return eligible.withColumn("_rank", rank).where(F.col("_rank") <= budget).drop("_rank")


def coverage(scored: DataFrame, min_score: float = MIN_SCORE, by: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """Pages and characters, chosen and skipped."""
    n, chosen = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), F.col("score") >= min_score
    total, skipped = F.greatest(F.sum(n), F.lit(1)), F.coalesce(F.sum(F.when(~chosen, n)), F.lit(0))
    return scored.groupBy(*by).agg(
        F.count("*").alias("pages_total"), F.count_if(chosen).alias("pages_selected"), F.coalesce(total, F.lit(1)).alias("chars_total"), skipped.alias("chars_skipped"),
        F.round(1 - skipped / F.coalesce(total, F.lit(1)), 4).alias("char_coverage"),
    )


#: Bits of the map of needles' beginnings, of which each task holds a byte for each (16 MB), and how long these are at most.
MAP_BITS, LONGEST = 1 << 24, 64
#: Bytes of texts that are hashed together.
BLOCK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(raw: np.ndarray, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, a number below MAP_BITS for each run of so many bytes of raw), for lengths that are powers of two: each is made from the half of it."""
    h, n = (raw.astype(np.uint64) + np.uint64(1)) * _ODD, 1
    for length in sorted(lengths):
        while n < length <= len(raw):
            h = h[: len(h) - n] * np.uint64(pow(0x100000001B3, n, 1 << 64)) + h[n:]
            n *= 2
        if length <= len(raw):
            mixed = (h ^ (h >> np.uint64(29))) * _ODD + np.uint64(length)
            yield length, (mixed >> np.uint64(40)).astype(np.int64)


def _beginning(n_bytes: int) -> int:
    """How many first bytes of a needle are looked up: the largest power of two that it has, up to LONGEST."""
    return min(1 << (n_bytes.bit_length() - 1), LONGEST)


def _marked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, of a needle in bytes, and its place in the map)."""
    for frame in frames:
        found = {(len(x), int(h[0])) for x in frame.column("needle").to_pylist() if x for _, h in _hashes(np.frombuffer(x, np.uint8)[: _beginning(len(x))], [_beginning(len(x))])}
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["length", "place"])


def occurrences(pages: DataFrame, needles: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of pages without their text: each with a null needle, and with each needle (one column, in bytes) that its text may hold, which are all that it holds.

    Texts are read once, whatever the number of needles. All runs of bytes of a text are hashed together; where a run's
    place in a map of the needles' beginnings is taken, the bytes from there on are given for each length of needles
    with such a beginning, so a join on them is exact. What a needle costs is one bit and the places where it occurs.
    """
    marks = checkpointed(needles.select(F.col(needles.columns[0]).alias("needle")).mapInArrow(_marked, "length long, place long").distinct())
    lengths: dict[int, list[int]] = {}
    for n in sorted(r.length for r in marks.select("length").distinct().collect()):
        lengths.setdefault(_beginning(n), []).append(n)
    words = marks.groupBy(F.floor(F.col("place") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 32 as int)))").alias("bits"))
    table = np.zeros(MAP_BITS // 32, np.uint32)  # a fixed size, however many needles there are
    for r in words.toLocalIterator():
        table[r.word] = r.bits
    taken = pages.sparkSession.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").view(bool))
    kept, empty = [c for c in pages.columns if c != text_col], not needles.where(F.length(needles.columns[0]) == 0).isEmpty()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = taken.value
        for frame in frames:
            texts = frame.column(text_col).cast(pa.large_binary()).fill_null(b"")
            edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
            data = texts.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            found, row = set(), 0
            while row < len(texts):  # some whole texts at a time, so that what is held doesn't grow with the batch
                last = max(int(np.searchsorted(edges, edges[row] + BLOCK, "right")) - 1, row + 1)
                part, bounds = raw[edges[row] : edges[last]], edges[row : last + 1] - edges[row]
                for beginning, hashes in _hashes(part, lengths):
                    for at in np.flatnonzero(there[hashes]).tolist():
                        k = int(np.searchsorted(bounds, at, "right")) - 1
                        found.update((row + k, part[at : at + n].tobytes()) for n in lengths[beginning] if at + n <= bounds[k + 1])
                row = last
            if empty:
                found.update((row, b"") for row, known in enumerate(frame.column(text_col).is_valid().to_pylist()) if known)
            every = range(frame.num_rows)
            rows = pa.array([*every, *(r for r, _ in found)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(frame.column(c).take(rows) for c in kept), pa.array([*(None for _ in every), *(x for _, x in found)], pa.binary())], [*kept, "needle"])

    ddl = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "needle binary"])
    return pages.mapInArrow(run, ddl)


def triage_recall(scored: DataFrame, needles: DataFrame, budgets: tuple[int | None, ...] = (20, 40, 60, 80, None), min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """For each budget the share of needles (doc_id, needle) that stand on a chosen page; those on no page are missed.

    Needles are looked for as they are written. None for a budget: all pages from min_score on. A needle counts by the
    best page that it stands on, which a budget leaves if it comes no later than the document's last page within it.
    Needles are looked for in all pages at once (see occurrences), and texts aren't shuffled or sorted.
    """
    known = checkpointed(needles.select("doc_id", F.encode("needle", "UTF-8").alias("needle")).distinct())
    better = F.struct((-F.col("score")).alias("score"), "page_no").alias("place")
    pages = scored.select("doc_id", "score", "page_no", F.col(text_col).alias("text"))
    both = checkpointed(occurrences(pages, known.select("needle")))
    places, held = both.where("needle is null"), both.where((F.col("score") >= min_score) & F.col("needle").isNotNull()).select("doc_id", "needle", better)
    first = held.join(known, ["doc_id", "needle"], "left_semi").groupBy("doc_id", "needle").agg(F.min("place").alias("place"))
    hits = known.join(first, ["doc_id", "needle"], "left")
    within = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "page_no"))
    for b in budgets:
        if b is None:
            hits = hits.withColumn("_all", F.col("place").isNotNull())
            continue
        last = places.withColumn("_rank", within).where(F.col("_rank") <= b).groupBy("doc_id").agg(F.max(better).alias(f"_last_{b}"))
        hits = hits.join(last, "doc_id", "left").withColumn(f"_{b}", F.coalesce(F.col("place") <= F.col(f"_last_{b}"), F.lit(False)))
    return hits.agg(*(F.count_if(F.col(f"_{b or 'all'}")).alias(f"found_{b or 'all'}") for b in budgets), F.count("*").alias("known")).select(
        "*", *(F.round(F.try_divide(F.col(f"found_{b or 'all'}"), F.col("known")), 4).alias(f"recall_{b or 'all'}") for b in budgets)
    )


def printed_page(text: Column) -> Column:
    """The page's own number: of the last two, then the first two lines that aren't blank, the first that is up to four digits."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    n = F.size(lines)
    last = F.slice(lines, F.greatest(n - 1, F.lit(1)), F.lit(2))
    return F.get(F.filter(F.concat(last, F.slice(lines, F.lit(1), F.lit(2))), lambda x: F.rlike(x, F.lit(r"(?U)^\d{1,4}$"))), 0)
