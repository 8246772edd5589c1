"""Temperature scaling: loss on a grid of temperatures in one pass, refined around the best."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uqframe.functions import vectors as V

LOWEST, HIGHEST = 0.05, 20.0
POINTS = 33


def log_grid(lo: float, hi: float, points: int = POINTS) -> list[float]:
    return [lo * (hi / lo) ** (i / (points - 1)) for i in range(points)]


def losses(probs: np.ndarray, label: np.ndarray, grid: list[float]) -> np.ndarray:
    """Negative log-likelihood of samples (rows of ``probs``) at each temperature: a row a temperature."""
    logs = np.log(np.clip(np.nan_to_num(probs, nan=1.0), V.CLIP, 1.0))
    top = logs.max(axis=1)
    below, own = logs - top[:, None], top - logs[np.arange(len(logs)), label]
    return np.array([np.log(np.exp(below / t).sum(axis=1)) + own / t for t in grid])


def grid_losses(df: DataFrame, grid: list[float], keys: list[str] | None = None) -> DataFrame:
    """Mean loss of each temperature; a task's samples are matrices, a batch at a time, and its sums one row a grid point.

    A sample without probabilities or with a label outside of them has no loss.
    """
    keys, types = keys or [], dict(df.dtypes)
    own = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("probs").cast("array<double>").alias("p"), F.col("label").cast("int").alias("y"))
    names = [*[f"k{i}" for i in range(len(keys))], "i", "s", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own_types = {}, []
        for batch in batches:
            own_types = [batch.schema.field(i).type for i in range(len(keys))]
            width = batch.column("p").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            label = batch.column("y").fill_null(-1).to_numpy(zero_copy_only=False)
            made = np.full((len(grid), batch.num_rows), np.nan)
            for w in np.unique(width[width > 0]):
                at = np.flatnonzero((width == w) & (label >= 0) & (label < w))
                flat = batch.column("p").take(pa.array(at)).flatten().fill_null(0.0)
                made[:, at] = losses(flat.to_numpy(zero_copy_only=False).reshape(len(at), w), label[at], grid)
            groups = batch.select(list(range(len(keys)))).to_pandas().groupby([f"k{i}" for i in range(len(keys))], dropna=False, sort=False).indices if keys else {(): np.arange(batch.num_rows)}
            for key, at in groups.items():
                key = tuple(None if x != x else x for x in (key if isinstance(key, tuple) else (key,)))
                into = held.setdefault(key, np.zeros((2, len(grid))))
                found = at[~np.isnan(made[0, at])]
                into += [made[:, found].sum(axis=1), np.full(len(grid), len(found))]
        for key, (s, n) in held.items():
            arrays = [pa.array([k] * len(grid), own_types[i]) for i, k in enumerate(key)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(range(len(grid)), pa.int32()), pa.array(s), pa.array(n)], names=names)

    parts = own.mapInArrow(run, ", ".join([*[f"k{i} {types[k]}" for i, k in enumerate(keys)], "i int, s double, n double"]))
    temperatures = F.array(*[F.lit(t) for t in grid])
    whole = parts.groupBy(*names[: len(keys)], "i").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("nll"))
    return whole.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.get(temperatures, F.col("i")).alias("temperature"), "nll")


def fit(df: DataFrame, width: float = 1e-7, most_rounds: int = 12) -> dict[str, float | bool]:
    """The temperature of least loss in [LOWEST, HIGHEST]. The loss is convex in 1 / T, so each round keeps the neighbours of the best.

    Each round reads the samples once and brings POINTS numbers to the driver. No sample: temperature 1.
    """
    lo, hi, best, loss = LOWEST, HIGHEST, 1.0, math.nan
    rows = []
    for _ in range(most_rounds):
        rows = sorted(grid_losses(df, log_grid(lo, hi)).collect(), key=lambda r: r.temperature)
        if not rows or rows[0].nll is None:
            return {"temperature": 1.0, "nll": math.nan, "at_bound": False, "converged": False}
        i = min(range(len(rows)), key=lambda k: rows[k].nll)
        best, loss = rows[i].temperature, rows[i].nll
        lo, hi = rows[max(i - 1, 0)].temperature, rows[min(i + 1, len(rows) - 1)].temperature
        if hi - lo < width:
            break
    return {"temperature": best, "nll": loss, "at_bound": best - LOWEST < 1e-4 or HIGHEST - best < 1e-4, "converged": hi - lo < width}
