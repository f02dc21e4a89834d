"""Quality scores by co-training: one classifier sees a page's text, the other its metadata.

Both are naive Bayes over sets of features, fitted from counts. In each round both are fitted to the labelled rows and
to what the other one has labelled so far; each is calibrated on labelled rows held out from all fitting, and gives
the other the unlabelled rows that it is sure of. At the end the calibrated views are combined by a
logistic regression on the held-out rows, and all documents are scored in one pass over their whole texts.

A document is kept from a score of 0.5 on, or from a lower one if that is needed to keep all but MISSED of the
held-out good rows.

Of labelled rows the fit takes a bounded sample, about LABELLED, drawn by a hash of the id. All other rows are
unlabelled ones: each round after the first reads their whole texts again and keeps only counts of features.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import bounded, cut, small, table

LABELLED, ROUNDS, SURE, MISSED = 20_000, 3, 0.97, 0.005
WORD_SLOTS, SHAPE_SLOTS, META_SLOTS = 1 << 15, 256, 1 << 14
#: A feature counts if its log ratio is so many standard errors from 0.
SIGNIFICANT = 3.0
SYMBOLS, CAPITALS = "#*$%&|<>{}[]~^_=\\", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_features(text: str) -> list[int]:
    """Hashed distinct words, and the text's shape: shares of symbols, digits, repeated lines and repeated words."""
    words, raw = text.lower().split(), text.encode("utf-8", "surrogatepass")
    next_to = sum(map(eq, words, words[1:]))
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(text)), max(1, len(words))
    bucket = lambda share: min(15, int(-2 * math.log2(share))) if share > 0 else 15
    shape = (
        bucket(sum(map(text.count, SYMBOLS)) / n), bucket(sum(map(text.count, "0123456789")) / n), bucket(1 - len(set(lines)) / max(1, len(lines))),
        bucket(1 - len(distinct) / m), min(15, len(words).bit_length()), min(15, int(n / m)), bucket(sum(map(text.count, "!?")) / n), bucket(sum(map(text.count, ".,;:")) / n),
        bucket(next_to / m), bucket(text.count("|") / m),
        bucket((len(raw) - len(raw.translate(None, CAPITALS))) / n),
    )
    return [*{zlib.crc32(w.encode()) % WORD_SLOTS for w in distinct}, *(WORD_SLOTS + 16 * i + b for i, b in enumerate(shape))]


def meta_features(row: tuple) -> list[int]:
    """Each metadata column's value, numbers by their order of magnitude, and all pairs of them."""
    values = [f"{i}={x.bit_length() if isinstance(x, int) else x}" for i, x in enumerate(row)]
    return sorted({zlib.crc32(v.encode()) % META_SLOTS for v in values + [f"{a}&{b}" for i, a in enumerate(values) for b in values[i + 1 :]]})


@dataclass
class View:
    """Weights of one view's features, and the line that turns its sum into calibrated log odds."""

    slots: int
    weights: np.ndarray = field(default=None)
    slope: float = 0.0
    shift: float = 0.0

    def raw(self, features: list[int] | np.ndarray) -> float:
        return float(self.weights[features].sum()) if len(features) else 0.0

    def odds(self, features: list[int] | np.ndarray) -> float:
        return max(-30.0, min(30.0, self.slope * self.raw(features) + self.shift))

    def fit(self, counts: np.ndarray, good: int, bad: int) -> None:
        """counts: rows (feature, good, bad) of the rows that have it."""
        self.weights = np.zeros(self.slots)
        if len(counts) and good and bad:
            f, g, b = counts.T
            ratio = np.log((g + 0.5) / (good + 1.0)) - np.log((b + 0.5) / (bad + 1.0))
            sure = np.abs(ratio) >= SIGNIFICANT * np.sqrt(1 / (g + 0.5) + 1 / (b + 0.5))
            self.weights[f[sure]] = ratio[sure]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic regression with the constant last, by Newton's method."""
    x = np.column_stack((x, np.ones(len(y))))
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@dataclass
class CoTrained:
    text: View
    meta: View
    mix: np.ndarray
    keep_from: float

    def scores(self, text: str, meta: tuple) -> tuple[float, float, float]:
        a, b = self.text.odds(text_features(text)), self.meta.odds(meta_features(meta))
        return sigmoid(a), sigmoid(b), self.combined(a, b)

    def combined(self, a: float, b: float) -> float:
        return sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def _sampled(ids: str, rate: float):
    return F.pmod(F.xxhash64(F.col(ids), F.lit(4)), F.lit(1_000_000)) < int(rate * 1_000_000)


def _sample(docs: DataFrame, labels: DataFrame, n_labelled: int) -> tuple[DataFrame, DataFrame]:
    """(id, part, y, text_f, meta_f) of the labelled rows that are taken, and all other rows of docs.

    part is 0 for fitting, 1 for calibration; only ids are shuffled.
    """
    known = labels.where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    known = cut(known.where(_sampled("id", min(1.0, n_labelled / max(1, known.count())))))
    known = bounded(known, 10 * n_labelled)
    picked, others = docs.join(known, "id"), docs.join(known, "id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [text_features(t or "") for t in batch.column("text").to_pylist()]
            metas = [meta_features(tuple(m.values())) for m in batch.column("meta").to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(texts, kind), pa.array(metas, kind)], ["id", "y", "text_f", "meta_f"])

    part = F.when(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0, 1).otherwise(0)
    made = picked.select("id", "y", "text", "meta").mapInArrow(run, "id long, y int, text_f array<int>, meta_f array<int>")
    return cut(made.select("id", part.alias("part"), "y", "text_f", "meta_f")), others


def co_train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE, n_labelled: int = LABELLED) -> CoTrained | None:
    """Fit to docs (id, text, meta struct) and labels (id, y 0 or 1); None if one of the classes has no labels."""
    state, others = _sample(docs, labels, n_labelled)
    held = state.where("part = 1").orderBy("id").select("y", "text_f", "meta_f").toArrow()  # about a fifth of n_labelled
    y = np.array(held.column("y").to_pylist(), dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    features = {v: [np.array(f, dtype=np.int64) for f in held.column(f"{v}_f").to_pylist()] for v in ("text", "meta")}
    views = {"text": View(WORD_SLOTS + SHAPE_SLOTS), "meta": View(META_SLOTS)}
    fitted = [state.where("part = 0").select(F.lit(v).alias("view"), "y", F.explode(F.array_append(f"{v}_f", -1)).alias("f")) for v in views]
    fitted = cut(fitted[0].unionByName(fitted[1]).groupBy("view", "f").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")))
    passed: list[dict[str, View]] = []
    for _ in range(rounds):
        given = fitted.unionByName(_exchange(others, passed, sure)) if passed else fitted
        counts = given.groupBy("view", "f").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()  # a row for each slot at most
        for v, view in views.items():
            own = counts[counts["view"] == v][["f", "good", "bad"]].to_numpy(dtype=np.int64)
            total, own = own[own[:, 0] == -1], own[own[:, 0] >= 0]
            view.fit(own, *(map(int, total[0, 1:]) if len(total) else (0, 0)))
            view.slope, view.shift = logistic(np.array([[view.raw(f)] for f in features[v]]), y)
        passed.append({v: replace(view) for v, view in views.items()})
    both = np.array([[views["text"].odds(a), views["meta"].odds(b)] for a, b in zip(features["text"], features["meta"], strict=True)])
    model = CoTrained(views["text"], views["meta"], logistic(both, y), 0.5)
    model.keep_from = min(0.5, float(np.quantile([model.combined(a, b) for a, b in both[y == 1]], MISSED)))
    return model


def _exchange(others: DataFrame, passed: list[dict[str, View]], sure: float) -> DataFrame:
    """(view, f, good, bad), a task's partial counts: features of the unlabelled rows that each view is given, -1 for the rows.

    A view is given the rows that the other is sure of. What a row was given once stays, so the views of all rounds
    so far are asked in turn; no row's features are stored.
    """
    limit = math.log(sure / (1 - sure))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {v: np.zeros((view.slots + 1, 2), dtype=np.int64) for v, view in passed[0].items()}
        for batch in small(batches):
            for text, meta in zip(batch.column("text").to_pylist(), batch.column("meta").to_pylist(), strict=True):
                seen = {"text": np.array(text_features(text or ""), dtype=np.int64), "meta": np.array(meta_features(tuple(meta.values())), dtype=np.int64)}
                for v, other in (("text", "meta"), ("meta", "text")):
                    odds = next((z for views in passed if abs(z := views[other].odds(seen[other])) >= limit), None)
                    if odds is not None:
                        column = sums[v][:, int(odds <= 0)]
                        column[seen[v]] += 1
                        column[-1] += 1
        for v, s in sums.items():
            f = np.flatnonzero(s.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(f), pa.string()), pa.array(np.where(f == len(s) - 1, -1, f), pa.int32()), pa.array(s[f, 0]), pa.array(s[f, 1])], ["view", "f", "good", "bad"])

    return others.select("text", "meta").mapInArrow(run, "view string, f int, good long, bad long")


def scored(model: CoTrained | None, texts: pa.Array, metas: list[pa.Array]) -> list[tuple[float | None, float | None, float | None]]:
    """(p_text, p_meta, score) of each row; without a model, nulls."""
    if model is None:
        return [(None, None, None)] * len(texts)
    return [model.scores(t or "", m) for t, m in zip(texts.to_pylist(), zip(*(m.to_pylist() for m in metas), strict=True), strict=True)]


def keeps(model: CoTrained | None, score: float | None) -> bool:
    return model is None or score is None or score >= model.keep_from


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...], label_col: str, **fit) -> CoTrained | None:
    seen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*(F.col(c) for c in meta_cols)).alias("meta"))
    return co_train(seen, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")), **fit)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"), label_col: str = "quality", **fit) -> DataFrame:
    """(id_col, p_text, p_meta, score, kept), one row for each row of docs.

    Null or empty texts have no words, null metadata is a value of its own; whole texts are read, however long. Labels
    that are null or of no document say nothing; if a document has several, the least counts. Without held-out labels
    of both classes nothing is fitted: the scores are null and all rows are kept. Rows that share an id each get their
    own score; a score of keep_from itself keeps. An empty table gives no rows. Other columns aren't read.
    """
    model = fitted(docs, labels, id_col, text_col, meta_cols, label_col, **fit)
    kinds = [pa.float64(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [(*s, keeps(model, s[2])) for s in scored(model, batch.column("text"), batch.columns[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], [id_col, "p_text", "p_meta", "score", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"m{i}") for i, c in enumerate(meta_cols)))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, p_text double, p_meta double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"), label_col: str = "quality", **fit) -> DataFrame:
    """docs without those that classify() rejects, all columns as they were, whatever their names; repeated rows alike."""
    model = fitted(docs, labels, id_col, text_col, meta_cols, label_col, **fit)
    text, metas = docs.columns.index(text_col), [docs.columns.index(c) for c in meta_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fields = batch.column("row").flatten()
            yield batch.filter(pa.array([keeps(model, s[2]) for s in scored(model, fields[text], [fields[m] for m in metas])], pa.bool_()))

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
