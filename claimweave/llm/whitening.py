"""Embedding whitening: the covariance of all vectors in double-double arithmetic, its eigenvectors, and each vector projected.

Vectors are centred before they are multiplied. Each product is split into its rounded value and its exact error
(error-free transformations), and sums are carried as pairs of doubles, high and low, within a task, from task to task
and in the last step, so what is left of rounding is far below a double's own. LAPACK's symmetric solver reduces the
covariance to a tridiagonal matrix and divides and conquers; its vectors are then refined in longer floats.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import cut, table

#: x = floor(SCALE * c) + SHIFT of an entry c; entries beyond LARGEST count as not finite. Partial sums that one task or the driver merges.
SCALE, SHIFT, LARGEST, MERGED = 64, 1_000_000, 2.0**31, 32
Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> Pair:
    """a as a sum of two doubles of 26 bits, whose products are exact."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two double-double arrays."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e = e + t
    high = s + e
    low = (e - (high - s)) + f
    out = high + low
    return out, low - (out - high)


def folded(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum over the first axis, by halving."""
    while len(high) > 1:
        half = len(high) // 2
        h, e = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = (np.concatenate((x, y[2 * half :])) for x, y in ((h, high), (e, low)))
    return high[0], low[0]


def products(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum of all rows' outer products, rows being double-double vectors: the upper triangle, row by row."""
    i, j = np.triu_indices(high.shape[1])
    step = max(1, 65536 // len(i))  # products that fit the processor's cache
    a, b = halves(high)
    total = np.zeros(len(i)), np.zeros(len(i))
    for at in range(0, len(high), step):
        h, l, u, v = (x[at : at + step] for x in (high, low, a, b))
        x, y, ux, uy, vx, vy = h[:, i], h[:, j], u[:, i], u[:, j], v[:, i], v[:, j]
        p = x * y
        error = vx * vy - (((p - ux * uy) - vx * uy) - ux * vy)
        total = add(total, folded(p, error + (x * l[:, j] + l[:, i] * y)))
    return total


def read(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of vectors, the rows of those with dims finite entries, and their x."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((lengths == dims) & pc.is_valid(column).to_numpy(zero_copy_only=False))
    own = values[(np.cumsum(lengths) - lengths)[rows][:, None] + np.arange(dims)]
    with np.errstate(invalid="ignore"):
        fine = (np.abs(own) <= LARGEST).all(axis=1)
    return rows[fine], np.floor(SCALE * own[fine]).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(dims, n, sums): the commonest length of whole vectors, the longest of equally common ones, how many there are, and their sum of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims in pc.unique(pc.list_value_length(batch.column(0))).to_pylist():
                if dims:
                    _, x = read(batch.column(0), dims)
                    if len(x):
                        yield pa.RecordBatch.from_pylist([{"dims": dims, "n": len(x), "sums": x.sum(axis=0).tolist()}])

    parts = cut(vectors.mapInArrow(run, "dims long, n long, sums array<long>"))
    most = parts.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return 0, 0, []
    sums = parts.where(F.col("dims") == most.dims).select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    return most.dims, most.n, [int(s) for _, s in sorted((r.pos, r.s) for r in sums)]


def _merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in parts:
        for high, low in zip(batch.column("high"), batch.column("low"), strict=True):
            pair = (high.values.to_numpy(), low.values.to_numpy())
            total = pair if total is None else add(total, pair)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in total], ["high", "low"])


def outer_products(vectors: DataFrame, centred) -> np.ndarray:
    """The sum of outer products of all rows, for centred(batch) -> (high, low) rows, as a matrix of long floats.

    Tasks send one pair of arrays each, and MERGED of these at a time are merged until the driver merges as many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                high, low = centred(batch)
                if len(high):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in products(high, low)], ["high", "low"])

        return _merge(parts())

    schema = "high array<double>, low array<double>"
    parts = cut(vectors.mapInArrow(run, schema))
    rows = parts.count()
    while rows > MERGED:
        rows = -(-rows // MERGED)
        parts = parts.repartition(rows).mapInArrow(_merge, schema)
    total = None
    for r in parts.collect():
        pair = np.array(r.high), np.array(r.low)
        total = pair if total is None else add(total, pair)
    if total is None:
        return np.zeros((0, 0), np.longdouble)
    dims = int((np.sqrt(8 * len(total[0]) + 1) - 1) / 2)
    out = np.zeros((dims, dims), np.longdouble)
    out[np.triu_indices(dims)] = total[0].astype(np.longdouble) + total[1]
    return out + np.triu(out, 1).T


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) by falling value, in long floats: LAPACK's divide and conquer, then steps of refinement.

    A step takes from the vectors what they lack in orthogonality and in diagonality, to first order; values too close
    to tell apart keep the vectors that the solver chose, made orthogonal. A vector's largest entry is positive.
    """
    scale = np.abs(matrix).max() or 1
    _, found = np.linalg.eigh((matrix / scale).astype(np.float64))
    a, x = matrix / scale, found[:, ::-1].astype(np.longdouble)
    for _ in range(2):
        lack = np.eye(len(a), dtype=np.longdouble) - x.T @ x
        seen = x.T @ a @ x
        values = np.diag(seen) / (1 - np.diag(lack))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 1e-13 * np.abs(values).max()
        x = x + x @ np.where(near, lack / 2, (seen + values[None, :] * lack) / np.where(near, 1, gap))
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values[order] * scale, x * signs


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each kept row and component.

    Dropped are rows whose vector is null, empty, holds a null, an entry that isn't finite or one beyond 2**31, or isn't as
    long as most of the others (of equally common lengths the longest counts). Entries become x = floor(64 c) + 1000000;
    n and all means are over all kept rows, repeated ones each. Components are numbered from 1 by falling eigenvalue of
    x's covariance (divisor n), min(components, dimensions) of them; equal eigenvalues, ties, share a space, in which the
    solver's vectors are taken. deviation is exact, the sum over dimensions of (n x - S)^2 as decimal(38, 0), null if
    larger. Where an eigenvalue is 0 but for rounding, as with a single row, whitened is null, and identity_error is over
    the others, null without any. Null ids stay. Vectors may be long: a task holds a few of its rows and one triangle.
    No rows give no rows. Other columns aren't read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    vectors = rows.select("vector")
    dims, n, sums = _sums(vectors)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return _named(df.sparkSession.createDataFrame([], schema), id_col)
    mean = [Fraction(s, n) for s in sums]
    high = np.array([float(m) for m in mean])
    low = np.array([float(m - Fraction(float(m))) for m in mean])

    def centred(batch: pa.RecordBatch) -> Pair:
        _, x = read(batch.column("vector"), dims)
        return less_mean(x.astype(np.float64), high, low)

    covariance = outer_products(vectors, centred) / n
    values, axes = eigen(covariance)
    values, axes, total = values[:components], axes[:, :components], np.trace(covariance)
    real = values > dims * np.finfo(np.float64).eps * max(values.max(), 0)
    turned = (axes / np.sqrt(np.where(real, values, 1))).astype(np.float64)
    explained = [float(v / total) if total > 0 else None for v in values]

    def whitened(x: np.ndarray) -> np.ndarray:
        h, e = less_mean(x.astype(np.float64), high, low)
        return h @ turned + e @ turned

    def plain(batch: pa.RecordBatch) -> Pair:
        z = whitened(read(batch.column("vector"), dims)[1])[:, real]
        z = np.column_stack((z, np.ones(len(z))))  # the last row of the products are sums
        return z, np.zeros_like(z)

    identity_error = None
    if real.any():
        second = outer_products(vectors, plain) / n
        rest = second[:-1, -1]  # what rounding left of the means
        identity_error = float(np.abs(second[:-1, :-1] - np.outer(rest, rest) - np.eye(int(real.sum()))).max())
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                kept, x = read(batch.column("vector"), dims)
                z = whitened(x)
                m = len(kept)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(np.repeat(kept, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(deviations(x, n, sums), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel(), mask=np.tile(~real, m)),
                    pa.array(explained * m, pa.float64()), pa.array([identity_error] * (m * k), pa.float64()),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _named(rows.mapInArrow(run, schema), id_col)


def less_mean(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> Pair:
    """x less the mean (high, low), as double-double rows."""
    h, e = two_sum(x, -high)
    return two_sum(h, e - low)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """The sum of (n x - S)^2 of each row, exactly; None beyond 38 digits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most < 2**62:
        d = n * x - np.array(sums, np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * len(sums) >= 2**63:
            d = d.astype(object)
    else:
        d = n * x.astype(object) - np.array(sums, object)
    return [Decimal(v) if v < 10**38 else None for v in (d * d).sum(axis=1).tolist()]


def _named(found: DataFrame, id_col: str) -> DataFrame:
    return found.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
