"""Embedding whitening by a compensated covariance and a divide-and-conquer eigen-solve.

Entries are put on an integer grid, so counts and sums are exact. The covariance is taken over each distinct vector once:
rows are centred on the mean in double-double, split into slices of few bits whose products and block sums are exact in
a double (error-free transformations), and added to matrices of high and low parts by exact two-sums. Tasks merge high
and low parts in a tree. The eigen-solve of the matrix, whose size depends on the dimensions alone, is LAPACK's
tridiagonal divide and conquer (``syevd``, which ``numpy.linalg.eigh`` calls). How far the whitened fit rows are from a
unit covariance is measured by the same sums in one more pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import cut

#: Grid of the entries: floor(SCALE * c) + SHIFT; entries whose grid value passes MOST_GRID raise.
SCALE, SHIFT, MOST_GRID = 64, 1_000_000, 1 << 40
#: Dimensions at most: d x d matrices are held by tasks and the driver.
MOST_DIMS = 2048
#: Bits of a slice, slices of a centred entry, and rows of a block: 2 * (SLICE_BITS - 1) + log2(BLOCK_ROWS) < 53.
SLICE_BITS, SLICES, BLOCK_ROWS = 21, 4, 4096
#: A covariance task reads at least so many rows for each dimension, so that its sums are a small part of what it reads.
ROWS_PER_DIM = 16
#: Partial sums that are merged at once.
FAN_IN = 64


def usable(vector: Column) -> Column:
    """True for a vector with entries, none of them null, NaN or infinite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def on_grid(vector: Column) -> Column:
    """The entries as longs, floor(SCALE * c) + SHIFT."""
    far = F.raise_error(F.lit("an entry lies beyond the grid"))
    return F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) * SCALE < MOST_GRID, F.floor(c.cast("double") * SCALE)).otherwise(far).cast("long") + SHIFT)


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and exactly what was lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Moments:
    """Sum of outer products of rows, as a matrix of high and one of low parts."""

    def __init__(self, d: int):
        self.high, self.low = np.zeros((d, d)), np.zeros((d, d))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        """Rows high + low (double-double). Slices whose product lies below 2^-84 of the block's largest are left out."""
        for start in range(0, len(high), BLOCK_ROWS):
            self._block(high[start : start + BLOCK_ROWS], low[start : start + BLOCK_ROWS])

    def _block(self, high: np.ndarray, low: np.ndarray) -> None:
        top = np.abs(high).max(initial=0.0)
        if top == 0.0:
            return
        unit, slices = 2.0 ** np.ceil(np.log2(top)), []
        for k in range(1, SLICES + 1):
            grid = unit * 2.0 ** (1 - SLICE_BITS * k)
            part = np.rint(high / grid) * grid
            slices.append(part)
            high, low = _two_sum(high - part, low)
        for total in range(SLICES - 1, -1, -1):  # the smallest products first
            for k in range(total // 2 + 1):
                product = slices[k].T @ slices[total - k]  # exact: at most 2^52 units of the two grids
                self.plus(product)
                if k != total - k:
                    self.plus(product.T)

    def plus(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        s, lost = _two_sum(self.high, high)
        self.high, self.low = _two_sum(s, self.low + (lost + low))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(fit: DataFrame, d: int) -> list[int]:
    """The exact sum of each dimension of ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a batch's sum fits a long; whole sums need not
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(_rows(b.column(0), d).sum(axis=0), pa.int64())], names=["i", "s"])

    parts = fit.select("x").mapInArrow(run, "i int, s long")
    return [int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()]


def moments(fit: DataFrame, d: int, width: int, n: int, centred: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) of the sum of outer products of ``centred`` rows of ``x``, which have ``width`` entries.

    Each task returns one row of its matrices at a time; rows of equal index are merged ``FAN_IN`` at once, so no task
    holds more than ``FAN_IN`` rows of one index, however many tasks there were.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, task = Moments(width), TaskContext.get().partitionId()
        for b in batches:
            m.add(*centred(_rows(b.column(0), d)))
        lists = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([task] * width, pa.int64()), pa.array(list(m.high), lists), pa.array(list(m.low), lists)], names=["i", "task", "high", "low"])

    def merge(key, rows):
        import pandas as pd

        m = Moments(0)
        m.high = m.low = np.zeros(width)
        for high, low in zip(rows["high"], rows["low"]):
            m.plus(np.asarray(high), np.asarray(low))
        return pd.DataFrame({"i": [key[0]], "task": [key[1]], "high": [m.high], "low": [m.low]})

    schema = "i int, task long, high array<double>, low array<double>"
    tasks = max(1, min(fit.rdd.getNumPartitions(), n // (ROWS_PER_DIM * d)))
    parts = fit.select("x").coalesce(tasks).mapInArrow(run, schema)
    while tasks > 1:
        parts = parts.groupBy("i", F.expr(f"task div {FAN_IN}").alias("task")).applyInPandas(merge, schema)
        tasks = -(-tasks // FAN_IN)
    found = parts.orderBy("i").collect()  # width rows of width entries
    return np.array([r["high"] for r in found]), np.array([r["low"] for r in found])


@dataclass(frozen=True)
class Whitening:
    """What whitens a row, all of it of the size of the dimensions; ``axes`` are scaled eigenvectors, one a column."""

    n: int
    sums: tuple[int, ...]
    mean_high: np.ndarray
    mean_low: np.ndarray
    eigenvalues: np.ndarray
    axes: np.ndarray
    explained: tuple[float, ...]
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean_high) - self.mean_low) @ self.axes

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - sum)^2, exact, for each row, as decimal(38,0)."""
        total, kind = np.array(self.sums, object), pa.decimal128(38, 0)
        if self.n * int(np.abs(x).max(initial=0)) + int(np.abs(total).max(initial=0)) < 1 << 62:
            d = self.n * x - total.astype(np.int64)
            if float((d.astype(float) ** 2).sum(axis=1).max(initial=0.0)) < 2.0**62:
                return pa.array((d * d).sum(axis=1), pa.int64()).cast(kind)
        d = self.n * x.astype(object) - total
        return pa.array([Decimal(v) for v in (d * d).sum(axis=1)], kind)


def solve(high: np.ndarray, low: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors of (high + low) / n, largest first, and the trace.

    An eigenvector's sign makes its entry of largest size (the first of equals) positive.
    """
    v = high / n + low / n
    v = (v + v.T) / 2
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    at = np.abs(vectors).argmax(axis=0)
    return np.maximum(values, 0.0), vectors * np.where(vectors[at, range(len(at))] < 0, -1.0, 1.0), float(np.trace(v))


def learn(fit: DataFrame, components: int) -> Whitening | None:
    """The whitening of the grid vectors ``x`` of ``fit``, each row counting once; None without rows.

    Vectors of unequal length and more than ``MOST_DIMS`` dimensions raise. Components without variance (beyond the rank
    of the fit rows) get a zero axis: their whitened values are 0 and they are left out of ``identity_error``.
    """
    seen = fit.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("d")).head()
    n, d = seen["n"], seen["d"]
    if not n:
        return None
    if seen["least"] != d or d > MOST_DIMS:
        raise ValueError(f"vectors have {seen['least']} to {d} entries; equal lengths up to {MOST_DIMS} are needed")
    total = sums(fit, d)
    means = [Fraction(s, n) for s in total]
    mean_high = np.array([float(m) for m in means])
    mean_low = np.array([float(m - Fraction(float(m))) for m in means])
    # a grid value has at most 41 bits, so it is exact in a double, and so is what the difference to the mean loses
    centred = lambda x: (lambda s, lost: _two_sum(s, lost - mean_low))(*_two_sum(x.astype(float), -mean_high))
    high, low = moments(fit, d, d, n, centred)
    values, vectors, trace = solve(high, low, n, components)
    some = values > d * np.finfo(float).eps * values[:1]
    axes = np.where(some, vectors / np.sqrt(np.where(some, values, 1.0)), 0.0)
    explained = tuple(float(e / trace) if trace > 0 else 0.0 for e in values)
    half = Whitening(n, tuple(total), mean_high, mean_low, values, axes, explained, 0.0)
    high, low = moments(fit, d, len(values), n, lambda x: (half.project(x), np.zeros((len(x), len(values)))))
    off = np.abs(high / n + low / n - np.eye(len(values)))[np.ix_(some, some)]
    return Whitening(n, half.sums, mean_high, mean_low, values, axes, explained, float(off.max(initial=0.0)))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """One row per usable vector: key, n, deviation (decimal), whitened and explained (arrays), identity_error.

    Rows whose vector is null, empty or has null or non-finite entries are dropped. The fit rows are the distinct grid
    vectors of all others; equal vectors are combined per task before the shuffle and whitened each. Keys may be null or
    repeated; other columns are not read. Arrays have at most ``components`` entries, one a component by falling
    eigenvalue.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    own = rows.where(usable(F.col(vector))).select(F.col(key).alias("key"), on_grid(F.col(vector)).alias("x"))
    model = learn(cut(own.select("x").distinct(), "whitening-fit"), components)
    schema = f"key {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        out = spark.createDataFrame([], schema)
        return out.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.lit(None).cast("array<double>").alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    shared, d = spark.sparkContext.broadcast(model), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = _rows(b.column(1), d)
            w = m.project(x)
            flat = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), m.deviations(x), flat], names=["key", "deviation", "whitened"])

    out = own.mapInArrow(run, schema)
    literal = lambda v: F.lit(v).cast("double")
    return out.select(F.col("key").alias(key), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(literal, model.explained)).alias("explained"), literal(model.identity_error).alias("identity_error"))
