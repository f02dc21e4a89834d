"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a signature takes
half as many hash evaluations; both agree for two sets with probability J, their Jaccard similarity, and the two
estimates together vary less than two minima. Bands hold ROWS minima or ROWS maxima of different permutations.
With 56 permutations and 4 rows there are 28 bands: a pair at J = 0.8 shares none with probability 4e-7.

Links are confirmed on full sets. Texts with equal sets are one class from the start. Classes that share a band are
candidates, and the bands' hot buckets aren't expanded into pairs: members are compared with one member of their
bucket, that which meets most others, and links give them the labels of their components. Members of buckets that then
still hold several labels are compared by their rarest shingles (rare_pairs), which loses no link. So every candidate
pair is either compared, or known to be no link, or already in one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import bounded, cut, table, tidy
from claimweave.llm.components import components

PERMUTATIONS, ROWS = 56, 4
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles of k words; with fewer words, the whole sequence is one shingle."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.weights = _mix(np.arange(1, k + 1, dtype=np.uint64) * _MIX[2]) | np.uint64(1)
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        self.up = np.multiply.accumulate(np.full(n + 1, _BASE, dtype=np.uint64))
        self.down = np.multiply.accumulate(np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))

    def words(self, text: str) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of the bytes' powers."""
        raw = np.frombuffer(text.encode().lower(), dtype=np.uint8)  # of bytes, lower() changes A-Z alone
        if len(raw) >= len(self.up):
            self._grow(2 * len(raw))
        gap = np.concatenate(([True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]))
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])))
        return _mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _MIX[3])

    def shingles(self, text: str) -> np.ndarray:
        """The distinct shingles, sorted; none for a text without words."""
        words, k = self.words(text), self.k
        if not len(words):
            return words
        if len(words) < k:
            return _mix((words * self.weights[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.array([len(words)], np.uint64) * _MIX[4])
        n = len(words) - k + 1
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out += words[i : i + n] * self.weights[i]
        return np.unique(_mix(out))


def _bands(found: np.ndarray, times: np.ndarray, plus: np.ndarray, rows: int) -> np.ndarray:
    low, high = np.full(len(times), ~np.uint64(0)), np.zeros(len(times), np.uint64)
    for at in range(0, len(found), 1024):
        hashed = found[at : at + 1024, None] * times + plus
        np.minimum(low, hashed.min(axis=0), out=low)
        np.maximum(high, hashed.max(axis=0), out=high)
    bands = np.concatenate((low, high)).reshape(-1, rows)
    return _mix((bands * _MIX[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(len(bands), dtype=np.uint64) * _MIX[5]).view(np.int64)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(8)
    times = random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return times, random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)


def _bitmap(found: np.ndarray) -> bytes:
    """A bit for each shingle, in a map of eight to sixteen bits a shingle, but 64 at least."""
    size = 1 << max(6, int(8 * len(found) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[found & np.uint64(size - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _may_link(a: bytes, b: bytes, n_a: int, n_b: int, percent: int) -> bool:
    """False only if the sets can't be similar enough: a bit that one map lacks is a shingle that its set lacks."""
    size = min(len(a), len(b))
    x, y = (np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, size), axis=0) for m in (a, b))
    both = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
    return 100 * both >= percent * (n_a + n_b - both)


def prints(docs: DataFrame, shingle: int, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """(id, text) to (id, mark, n, class, bits, bands), one row for each row of docs.

    class is a 128-bit digest of the shingle set, bits its bitmap; both are null, and there are no bands, without
    shingles. mark is a hash of the text: with the id it finds the text again.
    """
    if permutations % rows or rows > len(_MIX):
        raise ValueError("permutations must be a multiple of rows, and rows at most 8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(shingle)
        times, plus = _permutations(permutations)
        for batch in batches:
            n, classes, bits, bands = [], [], [], []
            for value in batch.column("text"):
                found = own.shingles(value.as_py() or "")
                n.append(len(found))
                classes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                bits.append(_bitmap(found) if len(found) else None)
                bands.append(_bands(found, times, plus, rows) if len(found) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)], dtype=np.int32)), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(bits, pa.binary()), lists], ["id", "mark", "n", "class", "bits", "bands"])

    return docs.select("id", "mark", "text").mapInArrow(run, "id long, mark long, n long, class binary, bits binary, bands array<long>")


class Texts:
    """Texts by the number of their class: each class (node, id, mark, n, bits) has one row of docs that stands for it."""

    def __init__(self, docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> None:
        self.docs, self.classes, self.shingle, self.percent = docs, classes, shingle, percent

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node) to (node, text)."""
        places = cut(self.classes.join(wanted, "node", "left_semi").select("node", F.col("id").alias("r_id"), F.col("mark").alias("r_mark")))
        places = bounded(places, 1_000_000)
        found = self.docs.join(places, self.docs["id"].eqNullSafe(places["r_id"]) & (self.docs["mark"] == places["r_mark"]))
        return found.select("node", "text").dropDuplicates(["node"])

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Written pairs (a, b) of classes without those that the bitmaps rule out: most that are no links, and no link."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        maps = self.classes.join(wanted, "node", "left_semi").select("node", F.struct("n", "bits").alias("value"))
        percent = self.percent
        return by_hub(pairs, maps, lambda: lambda v: (v["n"], v["bits"]), lambda x, y: _may_link(x[1], y[1], x[0], y[0], percent))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of written pairs (a, b) of classes, those whose full sets have 100 * intersection >= percent * union."""
        shingle, percent = self.shingle, self.percent
        texts = self.of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        return by_hub(pairs, texts.select("node", F.col("text").alias("value")), lambda: Shingler(shingle).shingles, lambda x, y: _linked(x, y, percent))

    def links_by(self, sets: DataFrame, pairs: DataFrame) -> DataFrame:
        """The same for classes whose full sets are written (node, hashes, ...)."""
        percent = self.percent
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        values = sets.join(wanted, "node", "left_semi").select("node", F.col("hashes").alias("value"))
        return by_hub(pairs, values, lambda: np.array, lambda x, y: _linked(x, y, percent))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node) to (node, hashes, s0, ...): the whole set, and its sketch."""
        shingle = self.shingle
        names = [f"s{k}" for k in range(SKETCH)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Shingler(shingle)
            for batch in batches:
                found = [own.shingles(v.as_py()) for v in batch.column("text")]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
                sketches = np.array([sketch(f) for f in found], np.int64).reshape(-1, SKETCH)
                yield pa.RecordBatch.from_arrays([batch.column("node"), lists, *(pa.array(sketches[:, k]) for k in range(SKETCH))], ["node", "hashes", *names])

        return self.of(wanted).mapInArrow(run, "node long, hashes array<long>, " + ", ".join(f"{x} long" for x in names))


def _linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(other) - both)


#: Neighbours of a hub that one task compares with it; members of a shingle's group in a row or column of its grid; 64-bit words of a sketch.
NEAR, CELL, SKETCH = 200, 500, 8


def by_hub(pairs: DataFrame, values: DataFrame, opener, fits) -> DataFrame:
    """Of written pairs (a, b), those with fits(x, y), where opener() makes the function that turns a value into x or y.

    values: (node, value). A hub's value goes once to each NEAR of its neighbours, not onto each pair's row, and tasks
    hold one hub's at a time: rows are sorted so that it comes before its neighbours'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, hub = opener(), None
        for batch in batches:
            others, values = batch.column("b").to_pylist(), batch.column("value")
            keep = []
            for k, b in enumerate(others):
                own = opened(values[k].as_py())
                if b is None:
                    hub = own
                keep.append(b is not None and fits(hub, own))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / NEAR).cast("int").alias("parts"))
    hubs = parts.join(values, F.col("a") == F.col("node")).select("a", F.lit(None).cast("long").alias("b"), "value", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = pairs.join(parts, "a").join(values, F.col("b") == F.col("node")).select("a", "b", "value", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    dealt = hubs.union(others).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    found = cut(dealt.select("a", "b", "value").mapInArrow(run, "a long, b long"))
    del parts, hubs, others, dealt
    tidy(pairs.sparkSession)
    return found


def sketch(found: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall on each of 64 * SKETCH bits: where two sketches differ, so do the sets."""
    odd = np.bincount((found >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def rare_pairs(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be links, by the rarest shingles of each set.

    sets: (node, hashes, s0, ...); sizes: (node, n, component). Shingles are ordered by their frequency. Two sets are
    similar enough only if they share one of the first n - percent * n / 100 + 1 shingles of each, and if from the first
    that they share on both have as many as they need. What all members of a bucket share, such as a common passage,
    comes last in the order, so no pairs come from it. A shingle all of whose sets are of one component makes no pairs.
    The group of one that many sets have first is a grid of cells of CELL by CELL sets, each a key of its own, and each
    pair meets in one cell. Rows hold sketches of one size, by which most pairs that are no links never leave the join.
    """
    flat = sets.select("node", F.explode("hashes").alias("h"))
    often = flat.groupBy("h").agg(F.count("*").alias("often")).where("often > 1")
    shared = flat.join(often, "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("shared")).join(sizes, "node")
    alone = F.col("n") - F.size("shared")  # shingles of this set alone come first
    first = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - alone
    prefix = shared.where(first > 0).select("node", "n", "component", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), first.cast("int"))).alias("at", "s"))
    prefix = cut(prefix.select(F.col("s.h").alias("h"), "node", "n", "component", (F.col("n") - F.col("alone") - F.col("at")).alias("left")))
    grids = prefix.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / CELL).cast("int").alias("cells")).where("lo <> hi").select("h", "cells")
    words = [f"s{k}" for k in range(SKETCH)]
    placed = prefix.join(grids, "h").join(sets.select("node", *words), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    side = lambda x, row, column: placed.select("h", row.alias("i"), column.alias("j"), *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component", "left", *words)))
    enough = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    likely = (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    met = side("a", F.col("own"), every).join(side("b", every, F.col("own")), ["h", "i", "j"])
    return met.where((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & enough & likely).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _labels(links: DataFrame) -> DataFrame:
    """(node, component) of linked nodes, the least node within a few links: what it tells apart may still be one component."""
    sides = links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a"))
    now = cut(sides.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component")))
    for _ in range(2):
        of = now.select(F.col("node").alias("of"), F.col("component").alias("to"))
        now = now.join(of, now["component"] == of["of"]).select("node", F.col("to").alias("component"))
    return now


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Of (key, node, n), those in buckets whose members have several components (of, component), with these."""
    here = members.join(labels, members["node"] == labels["of"], "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    several = here.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return cut(here.join(several, "key", "left_semi"))


def _grouped(docs: DataFrame, shingle: int, percent: int, permutations: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """docs (id, mark, text) to its prints, and (class, id, component) of all classes."""
    signed = cut(prints(docs, shingle, permutations, rows))
    # Texts with equal sets are one class from the start; the row with the least id stands for it.
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "n", "bits", "bands")
    classes = signed.where("class is not null").groupBy("class").agg(F.min(row).alias("r"))
    classes = cut(classes.select("class", F.monotonically_increasing_id().alias("node"), "r.id", "r.mark", "r.n", "r.bits", "r.bands"))
    owned = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = owned.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    members = cut(owned.join(shared, "key"))
    within = cut(classes.select("node", "id", "mark", "n", "bits").join(members.select("node"), "node", "left_semi"))
    texts = Texts(docs, within, shingle, percent)
    tidy(docs.sparkSession)

    # Of a bucket's members, the one that meets most others in all of its buckets stands in the middle of its group.
    meets = members.groupBy("node").agg(F.sum("many").alias("meets"))
    middle = members.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    # One order ranks all hubs: no pair comes both ways.
    firsts = cut(members.join(middle, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    links = texts.links(texts.likely(firsts))
    found = components(links).withColumnRenamed("node", "of")
    here = _mixed(members.select("key", "node", "n"), found)
    if not here.isEmpty():
        sets = cut(texts.sets(here.select("node").distinct()))
        # Each member with the least one that it may be linked with; then what that leaves apart.
        sizes = cut(here.select("node", "n", "component").distinct())
        tidy(docs.sparkSession)
        pairs = cut(rare_pairs(sets, sizes, percent))
        tidy(docs.sparkSession)
        pairs = texts.likely(pairs)
        some = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        more = texts.links_by(sets, some)
        # Components so far go on as stars, which are near their end already.
        links = found.where("of <> component").select(F.col("of").alias("a"), F.col("component").alias("b")).union(more)
        labels = cut(_labels(links))
        of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        rest = pairs.join(some, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        apart = ~F.coalesce("c_a", "a").eqNullSafe(F.coalesce("c_b", "b"))
        apart = cut(rest.where(apart).select("a", "b"))
        tidy(docs.sparkSession)
        links = links.union(texts.links_by(sets, apart))
        found = components(links).withColumnRenamed("node", "of")
    tidy(docs.sparkSession)
    grouped = classes.select("class", "node", "id").join(found, classes["node"] == found["of"], "left")
    return signed, cut(grouped.select("class", "id", F.coalesce("component", "node").alias("component")))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row for each row of docs; ids are integers.

    component_id is the least id that a document reaches over links, its own included; kept: it is its own. A null
    or empty text, or one without words, has no shingles and is linked with nothing. Rows with a null id are linked
    like others, and kept if they reach no id. Rows that share an id are documents of their own: links are between
    texts, so such rows may lie in different components. Repeated rows each keep their row. Very long texts are
    compared whole. Ties can't arise: components are sets. An empty table gives no rows. Other columns aren't read.
    """
    signed, grouped = _grouped(_named(docs, id_col, text_col), shingle, percent, permutations, rows)
    least = grouped.groupBy("component").agg(F.min("id").alias("least"))
    of_class = cut(grouped.join(least, "component").select(F.col("class").alias("of"), "least"))
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least"))
    found = signed.join(of_class, signed["class"] == of_class["of"], "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (component.isNull() | component.eqNullSafe(F.col("id"))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate group, all columns as they were.

    The row with the least id stays, one without an id only if no other has one; of rows that share it, the one with
    the least hash of its text; of rows that share that too, one. Texts without words are in no group and all stay.
    """
    signed, grouped = _grouped(_named(docs, id_col, text_col), shingle, percent, PERMUTATIONS, ROWS)
    rows = signed.where("class is not null").select("class", "id", "mark").join(grouped.select("class", "component"), "class")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("k"), F.count("*").alias("rows"))
    best = cut(best.select("component", F.col("k.id").alias("k_id"), F.col("k.mark").alias("k_mark"), "rows"))
    # Most groups are one row, which stays: only rows of larger groups are looked up.
    large = best.where("rows > 1")
    grown = rows.join(large, "component")
    stays = grown["id"].eqNullSafe(F.col("k_id")) & (grown["mark"] == F.col("k_mark"))
    judged = cut(grown.groupBy(F.col("id").alias("j_id"), F.col("mark").alias("j_mark")).agg(F.bool_or(stays).alias("j_stays"), F.count("*").alias("j_rows")))
    once, goes = judged.where("j_stays and j_rows > 1"), judged.where("not j_stays or j_rows > 1")
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"))
    match = lambda side: marked["id"].eqNullSafe(side["j_id"]) & (marked["mark"] == side["j_mark"])
    single = marked.join(bounded(goes, 1_000_000), match(goes), "left_anti").select("row")
    repeated = marked.join(bounded(once, 1_000_000), match(once), "left_semi").groupBy("id", "mark").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS n_both FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * n_both >= 80 * (nx + ny - n_both)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, sym.y FROM reach r JOIN sym ON r.y = sym.x)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept
FROM s JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) c ON c.x = s.doc_id
"""
