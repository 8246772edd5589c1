"""Bootstrap resamples that every system, bin and order shares.

A row's weight in a resample is a Poisson(1) count that depends on the row's key, the resample and the seed alone. So
the same row has the same weights wherever and in whatever order it is read: differences between systems, arms and
scores are paired, nothing is drawn ahead, joined or sorted for it, and a task that is run again draws the same. The sum
of a resample's weights varies around the sample's size, so statistics divide by it.

The generator mixes 32-bit words in steps that SQL's 64-bit integers can follow, so a query's SQL draws the same weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.functions import vectors as V

#: Resamples unless said otherwise.
REPS, SEED = 2_000, 42
#: Odd multipliers below 2^31 and word constants of the mixing steps.
MULTIPLIERS, WORDS = (0x7FEB352D, 0x2C1B3C6D), (0x9E3779B9, 0x85EBCA6B)
#: A weight is the number of these that a 32-bit word reaches: Poisson(1) by its inverse distribution.
STEPS = tuple(math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12))
#: Words that are mixed at once, bytes of sums that a task holds before it returns them, rows of a block, blocks of a group.
TILE, HELD_BYTES, BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 16, 256 << 20, 20_000, 16, 4_096
#: Rows whose areas are added up as 32-bit integers: no weight passes 12.
AREA_ROWS = 4_096
#: Ends of blocks around a quantile, in its standard errors.
NEAR = (-8.0, -5.0, -3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 5.0, 8.0)
_LOW = np.uint64(0xFFFFFFFF)
#: The weight of all words with the same upper half; OPEN where a step lies among them.
OPEN = 255
_BY_UPPER, _LAST = (np.searchsorted(np.array(STEPS, np.uint64), (np.arange(1 << 16, dtype=np.uint64) << np.uint64(16)) + np.uint64(low), "right").astype(np.uint8) for low in (0, 0xFFFF))
_BY_UPPER[_BY_UPPER != _LAST] = OPEN


def _mix(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """Two rounds of shift and multiply on 32-bit words, in place; ``spare`` is overwritten."""
    spare = np.empty_like(x) if spare is None else spare
    for shift, m in zip((16, 15), MULTIPLIERS):
        x ^= np.right_shift(x, np.uint32(shift), out=spare)
        x *= np.uint32(m)
    x ^= np.right_shift(x, np.uint32(16), out=spare)
    return x


def _weights(a: np.ndarray, b: np.ndarray, c: np.ndarray, spare: dict | None = None) -> np.ndarray:
    """The weights of rows and resamples, where their words meet. The same ``spare`` in several calls saves them new memory; the result lies in it."""
    shape = np.broadcast_shapes(b.shape, c.shape)
    spare = {} if spare is None else spare
    if spare.get("shape") != shape:
        spare.update(shape=shape, u=np.empty(shape, np.uint32), v=np.empty(shape, np.uint32), out=np.zeros(-(-math.prod(shape) // 8) * 8, np.uint8), open=np.zeros(-(-math.prod(shape) // 8) * 8, bool))
    u, v, size = spare["u"], spare["v"], math.prod(shape)
    np.bitwise_xor(b, c, out=u)
    _mix(np.bitwise_xor(a, _mix(u, v), out=u), v)
    out, found = spare["out"], spare["open"]
    np.take(_BY_UPPER, np.right_shift(u, np.uint32(16), out=v).ravel(), out=out[:size], mode="clip")  # no upper half is beyond the table
    np.equal(out, OPEN, out=found)
    near = np.flatnonzero(found.view(np.uint64))  # eight at a time: few lie at a step
    near = (near[:, None] * 8 + np.arange(8)).ravel()
    near = near[found[near]]
    out[near] = np.searchsorted(np.array(STEPS, np.uint32), u.ravel()[near], "right")
    return out[:size].reshape(shape)


def area(score: np.ndarray, up: np.ndarray, weights: Weights, reps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, neg, area) of rows in the order of their scores in each resample: a positive beats the negatives before it, half of those of its own score.

    Rows are added one by one to sums of all resamples, so a weight costs an addition or two; ties wait until their score ends.
    """
    total = {k: np.zeros(reps) for k in ("pos", "neg", "area")}
    pos, neg, beaten, one = (np.zeros(reps, np.int32) for _ in range(4))
    tied = {True: np.zeros(reps), False: np.zeros(reps)}
    last = np.r_[score[1:] != score[:-1], True]
    alone = (last & np.r_[True, last[:-1]]).tolist()
    last, up, since = last.tolist(), up.tolist(), 0

    def settle() -> None:
        total["area"] += beaten + pos * total["neg"]
        total["pos"] += pos
        total["neg"] += neg
        for x in (pos, neg, beaten):
            x.fill(0)

    whole = np.empty((max(1, TILE // max(1, reps)), reps), np.int32)
    for start, drawn in weights.rows(reps):
        np.copyto(whole[: len(drawn)], drawn)
        for i, w in enumerate(whole[: len(drawn)], start):
            since += 1
            if not alone[i]:
                tied[up[i]] += w
                if not last[i]:
                    continue
                settle()
                total["area"] += tied[True] * (total["neg"] + 0.5 * tied[False])
                total["pos"] += tied[True]
                total["neg"] += tied[False]
                tied[True].fill(0)
                tied[False].fill(0)
                since = 0
            elif up[i]:
                np.multiply(w, neg, out=one)
                np.add(beaten, one, out=beaten)
                np.add(pos, w, out=pos)
            else:
                np.add(neg, w, out=neg)
            if since >= AREA_ROWS:
                settle()
                since = 0
    settle()
    return total["pos"], total["neg"], total["area"]


class Weights:
    """The weights of some rows: ``of(start, stop)`` is a matrix of resamples by rows."""

    def __init__(self, keys: np.ndarray, seed: int = SEED):
        wide = keys.astype(np.int64).view(np.uint64)
        low, high = (wide & _LOW).astype(np.uint32), (wide >> np.uint64(32)).astype(np.uint32)
        self.a = _mix(low ^ _mix(high ^ np.uint32(WORDS[0])))
        self.b = _mix(high ^ _mix(low ^ np.uint32(WORDS[1])))
        self.seed = _mix(np.array([seed & 0xFFFFFFFF], np.uint32))

    def of(self, start: int, stop: int, spare: dict | None = None) -> np.ndarray:
        c = _mix(np.arange(start + 1, stop + 1, dtype=np.uint32) ^ self.seed)
        return _weights(self.a, self.b, c[:, None], spare)

    def rows(self, reps: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, weights) of a few rows at a time, a row of all resamples each; they hold until the next ones are drawn."""
        c = _mix(np.arange(1, reps + 1, dtype=np.uint32) ^ self.seed)
        step, spare = max(1, TILE // max(1, reps)), {}
        for start in range(0, len(self.a), step):
            yield start, _weights(self.a[start : start + step, None], self.b[start : start + step, None], c, spare)

    def tiles(self, reps: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first resample, weights) of a few resamples at a time, which hold until the next ones are drawn."""
        step, spare = max(1, TILE // max(1, len(self.a))), {}
        for start in range(0, reps, step):
            yield start, self.of(start, min(reps, start + step), spare)


def sql(rows: str, reps: int = REPS, seed: int = SEED) -> str:
    """CTEs up to ``w`` (row_id, rep, cnt; cnt > 0) for the rows of ``rows`` (row_id), as ``Weights`` draws them."""
    steps: list[str] = []

    def mixed(name: str, source: str, keep: str, x: str) -> None:
        one, two = MULTIPLIERS
        y, z = f"(xor({x}, ({x}) >> 16) * {one}) % 4294967296", f"(xor(y, y >> 15) * {two}) % 4294967296"
        steps.append(f"w_{name}_1 AS (SELECT *, {y} AS y FROM {source})")
        steps.append(f"w_{name}_2 AS (SELECT * EXCLUDE (y), {z} AS z FROM w_{name}_1)")
        steps.append(f"w_{name} AS (SELECT {keep}, xor(z, z >> 16) AS {name} FROM w_{name}_2)")

    steps.append(f"w_k AS (SELECT DISTINCT row_id, (row_id::HUGEINT & 4294967295)::BIGINT AS lo, ((row_id::HUGEINT >> 32) & 4294967295)::BIGINT AS hi FROM {rows})")
    mixed("m1", "w_k", "row_id, lo, hi", f"xor(hi, {WORDS[0]})")
    mixed("a", "w_m1", "row_id, lo, hi", "xor(lo, m1)")
    mixed("m2", "w_a", "row_id, hi, a", f"xor(lo, {WORDS[1]})")
    mixed("b", "w_m2", "row_id, a", "xor(hi, m2)")
    own = int(_mix(np.array([seed & 0xFFFFFFFF], np.uint32))[0])
    mixed("c", f"(SELECT unnest(range(0, {reps})) AS rep)", "rep", f"xor(rep + 1, {own})")
    mixed("d", "(SELECT row_id, a, b, rep, c FROM w_b, w_c)", "row_id, rep, a", "xor(b, c)")
    mixed("u", "w_d", "row_id, rep", "xor(a, d)")
    steps.append(f"w AS (SELECT row_id, rep, {' + '.join(f'(u >= {s})::INT' for s in STEPS)} AS cnt FROM w_u WHERE u >= {STEPS[0]})")
    return ", ".join(steps)


def _products(weights: Weights, x: np.ndarray, reps: int) -> np.ndarray:
    """Resamples by columns: the weighted sums of each column of rows. Columns of small integers are added as 32-bit floats, which hold their sums exactly."""
    small = (x == np.rint(x)).all(axis=0) & (np.abs(x).sum(axis=0) * len(STEPS) < 1 << 24)
    out, counts, others = np.empty((reps, x.shape[1])), x[:, small].astype(np.float32), np.ascontiguousarray(x[:, ~small])
    for start, w in weights.tiles(reps):
        at = slice(start, start + len(w))
        if counts.shape[1]:
            out[at, small] = w.astype(np.float32) @ counts
        if others.shape[1]:
            out[at, ~small] = w.astype(np.float64) @ others
    return out


def together(df: DataFrame, row_key: str = "row_id") -> DataFrame:
    """``df`` with the rows of a key beside each other, so that ``sums`` draws a key's weights once for all groups that have it."""
    return df.repartition(row_key).sortWithinPartitions(row_key)


def sums(df: DataFrame, keys: list[str], values: dict[str, Column], binned: dict[str, tuple[Column, Column, int]] | None = None, row_key: str = "row_id", reps: int = REPS, seed: int = SEED, held_bytes: int = HELD_BYTES) -> DataFrame:
    """keys, rep, n (sum of weights) and the weighted sum of each of ``values``.

    ``binned`` has (value, bin, bins) for each name and gives an array of one sum a bin. ``row_key`` is an integer; rows of
    equal key share their weights, which a batch draws once for all of them, and a null key counts as -1. No row is shuffled: each task returns its sums, one row a
    group and resample, and again whenever its sums pass ``held_bytes``. A null value counts as 0. Empty input has no groups.
    """
    binned, types = binned or {}, dict(df.dtypes)
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    columns = [F.coalesce(F.col(row_key), F.lit(-1)).cast("long"), *map(number, values.values())]
    columns += [x for v, b, _ in binned.values() for x in (number(v), F.coalesce(b, F.lit(-1)).cast("int"))]
    own = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(f"c{i}") for i, c in enumerate(columns)])
    widths, count = [n for _, _, n in binned.values()], len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def packed() -> Iterator[pa.RecordBatch]:
            for key, made in held.items():
                arrays = [pa.array([k] * reps, own_types[i]) for i, k in enumerate(key)] + [pa.array(range(reps), pa.int32()), pa.array(made[:, 0])]
                arrays += [pa.array(made[:, 1 + i]) for i in range(count)]
                at = 1 + count
                for n in widths:
                    arrays.append(pa.ListArray.from_arrays(np.arange(0, reps * n + 1, n, dtype=np.int32), np.ascontiguousarray(made[:, at : at + n]).ravel()))
                    at += n
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            held.clear()

        own_types = []
        for batch in batches:
            own_types = [batch.schema.field(i).type for i in range(len(keys))]
            frame = batch.to_pandas()
            groups = frame.groupby([f"k{i}" for i in range(len(keys))], dropna=False, sort=False).indices if keys else {(): np.arange(len(frame))}
            found, place = np.unique(frame["c0"].to_numpy(), return_inverse=True)  # rows of a key share their draws
            blocks, names_ = [], []
            for key, at in groups.items():
                rows = frame.iloc[at]
                x = [np.ones((len(rows), 1)), rows[[f"c{1 + i}" for i in range(count)]].to_numpy(np.float64)]
                for i, n in enumerate(widths):
                    value, bin_ = (rows[f"c{1 + count + 2 * i + j}"].to_numpy() for j in (0, 1))
                    x.append(value[:, None] * (bin_[:, None] == np.arange(n)))
                x, here = np.hstack(x), place[at]
                if len(np.unique(here)) == len(here):
                    own = np.zeros((len(found), x.shape[1]))
                    own[here] = x
                else:
                    own = np.stack([np.bincount(here, c, len(found)) for c in x.T], axis=1)
                blocks.append(own)
                names_.append(tuple(None if k != k else k for k in (key if isinstance(key, tuple) else (key,))))
            made = _products(Weights(found, seed), np.hstack(blocks), reps) if blocks else np.zeros((reps, 0))
            for key, own in zip(names_, np.split(made, len(blocks), axis=1) if blocks else []):
                if key in held:
                    held[key] += own
                else:
                    held[key] = own.copy()
            if sum(m.nbytes for m in held.values()) > held_bytes:
                yield from packed()
        yield from packed()

    names = [*[f"k{i}" for i in range(len(keys))], "rep", "n", *[f"v{i}" for i in range(count)], *[f"b{i}" for i in range(len(widths))]]
    schema = ", ".join([*[f"k{i} {types[k]}" for i, k in enumerate(keys)], "rep int, n double", *[f"v{i} double" for i in range(count)], *[f"b{i} array<double>" for i in range(len(widths))]])
    parts = own.mapInArrow(run, schema)
    whole = parts.groupBy(*[f"k{i}" for i in range(len(keys))], "rep").agg(
        F.sum("n").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(count)], *[F.array(*[F.sum(F.get(f"b{i}", j)) for j in range(n)]).alias(f"b{i}") for i, n in enumerate(widths)]
    )
    renamed = [F.col(f"v{i}").alias(n) for i, n in enumerate(values)] + [F.col(f"b{i}").alias(n) for i, n in enumerate(binned)]
    return whole.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "rep", "n", *renamed)


def calibration(df: DataFrame, keys: list[str], classes: int, row_key: str = "row_id", bins: int = V.BINS, reps: int = REPS, seed: int = SEED, measures: tuple[str, ...] = ("accuracy", "mean_confidence", "brier", "nll", "ece", "macro_f1")) -> DataFrame:
    """keys, rep and ``measures`` of predictions (label, pred, probs) in each resample; sums that no measure needs are not made.

    Macro F1 is over fixed classes, one that is neither label nor prediction of a resample counts as 0. Narrow rows are
    shuffled by ``row_key``, so weights are drawn once for all groups.
    """
    conf, ok, one = V.confidence(F.col("probs")), F.col("pred") == F.col("label"), F.lit(1.0)
    means = {"accuracy": ok, "mean_confidence": conf, "brier": V.brier(F.col("probs"), F.col("label")), "nll": V.nll(F.col("probs"), F.col("label"))}
    means = {m: c.cast("double") for m, c in means.items() if m in measures}
    rows = df.select(*keys, row_key, "label", "pred", *[c.alias(f"__{m}") for m, c in means.items()], *([(ok.cast("double") - conf).alias("__gap"), V.bin_index(conf, bins).alias("__bin")] if "ece" in measures else []))
    binned = {"gap": (F.col("__gap"), F.col("__bin"), bins)} if "ece" in measures else {}
    if "macro_f1" in measures:
        binned |= {"tp": (ok, F.col("label"), classes), "of_label": (one, F.col("label"), classes), "of_pred": (one, F.col("pred"), classes)}
    s = sums(together(rows, row_key), keys, {m: F.col(f"__{m}") for m in means}, binned, row_key, reps, seed)
    n = F.nullif(F.col("n"), F.lit(0.0))
    made = {m: (F.col(m) / n) for m in means}
    if "ece" in measures:
        made["ece"] = V.total(F.transform("gap", F.abs)) / n
    if "macro_f1" in measures:
        each = F.zip_with("tp", F.zip_with("of_label", "of_pred", lambda a, b: a + b), lambda t, n: F.when(n > 0, 2.0 * t / n).otherwise(0.0))
        made["macro_f1"] = V.total(each) / classes
    return s.select(*keys, "rep", *[made[m].alias(m) for m in measures])


class _Ranges:
    """Blocks of each group: open ranges between quantiles, and single values that hold at least two quantiles' share."""

    def __init__(self, bounds: dict[tuple, list[float]]):
        self.bounds = {k: (np.unique(b), {x for x, y in zip(b, b[1:]) if x == y}) for k, b in bounds.items()}

    def find(self, key: tuple, values: np.ndarray) -> np.ndarray:
        """Even numbers for open ranges, odd ones for single values, in the order of the values."""
        bounds, hot = self.bounds[key]
        at = np.searchsorted(bounds, values, "left")
        return 2 * at + np.isin(values, list(hot))


def _blocked(df: DataFrame, keys: list[str], value: str, columns: list[str], blocks: int | None, q: float | None = None) -> DataFrame:
    """Columns ``key`` (the group as text), ``x`` (the value) and ``block`` beside ``columns``; rows without a value are left out.

    The blocks' ends, at most ``MOST_BLOCKS`` numbers a group, are all that reaches the driver. Blocks are as many as the
    largest group needs; with ``q`` they are few, and narrow only around that quantile, at ``NEAR`` of its standard errors.
    """
    name = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("")
    own = df.select(*[F.col(c) for c in dict.fromkeys([*keys, *columns])], name.alias("__key"), F.col(value).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    most = 0 if blocks else own.groupBy("__key").count().agg(F.max("count")).head()[0] or 0
    count = blocks or max(LEAST_BLOCKS, min(MOST_BLOCKS, most // BLOCK_ROWS))
    grid, accuracy = [i / count for i in range(1, count)] or [0.5], 10 * count + 100
    if q is not None and count > LEAST_BLOCKS and not blocks:
        error = math.sqrt(max(q * (1 - q), 1 / most) / most)
        grid, accuracy = sorted({min(1.0, max(0.0, q + z * error)) for z in NEAR}), min(1_000_000, math.ceil(4 / error))
    found = own.groupBy("__key").agg(F.percentile_approx("__x", grid, accuracy).alias("b")).collect()
    shared = df.sparkSession.sparkContext.broadcast(_Ranges({(r["__key"],): r["b"] for r in found}))

    def block(key: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int32)
        for k, at in key.groupby(key).indices.items():
            out[at] = shared.value.find((k,), x.to_numpy()[at])
        return pd.Series(out)

    return own.withColumn("__block", F.pandas_udf(block, "int")("__key", "__x"))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """A fixed number of partitions: small groups of rows become thousands of draws, so they must not be merged into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def auroc(df: DataFrame, keys: list[str], score: str = "score", positive: str = "positive", row_key: str = "row_id", reps: int = REPS, seed: int = SEED, blocks: int | None = None) -> DataFrame:
    """keys, rep, auroc: the chance that a positive scores above a negative in each resample, ties one half.

    Groups that hold the same row keys share their weights whatever the order of their scores, so differences are paired.
    A block of scores gives its own area and totals; a score that very many rows have needs only totals, summed per task.
    Null where a resample lacks one of the classes. Rows without a score are left out.
    """
    rows = _blocked(df, keys, score, [row_key, positive], blocks)
    up = F.col(positive).cast("boolean")
    flat = sums(rows.where("__block % 2 = 1"), [*keys, "__block"], {"pos": up, "neg": ~up}, row_key=row_key, reps=reps, seed=seed)
    flat = flat.select(*keys, "__block", "rep", "pos", "neg", (0.5 * F.col("pos") * F.col("neg")).alias("area"))
    types = dict(df.dtypes)

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__x", ignore_index=True)
        own = area(frame["__x"].to_numpy(), frame[positive].to_numpy(bool), Weights(frame[row_key].fillna(-1).to_numpy(), seed), reps)
        out = pd.DataFrame(dict(zip(("pos", "neg", "area"), own))).assign(rep=np.arange(reps))
        for k in [*keys, "__block"]:
            out[k] = frame[k].iloc[0]
        return out

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "__block int, rep int, pos double, neg double, area double"])
    cut = _spread(rows.where("__block % 2 = 0"), *keys, "__block").groupBy(*keys, "__block").applyInPandas(block, schema)
    below = Window.partitionBy(*keys, "rep").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.unionByName(flat).withColumn("area", F.col("area") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    return whole.groupBy(*keys, "rep").agg((F.sum("area") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auroc"))


def quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, row_key: str = "row_id", reps: int = REPS, seed: int = SEED, blocks: int | None = None) -> DataFrame:
    """keys, rep, quantile: the least value at which a resample's running weight reaches ``q`` of its total.

    Not a sum of rows, so it takes two steps of mergeable states, one a resample and block of values: the weight of
    each block tells in which block a resample's quantile lies, then that block alone is put in order. Blocks are narrow
    where resamples' quantiles are to be expected, so states are few and little is ordered; one that lies elsewhere is found
    in its wide block all the same. Rows without a value are left out; a resample without weight has no row.
    """
    rows = _blocked(df, keys, value, [row_key], blocks, q)
    weight = sums(rows, [*keys, "__block"], {}, row_key=row_key, reps=reps, seed=seed).where("n > 0")
    upto = Window.partitionBy(*keys, "rep").orderBy("__block")
    goal = F.lit(q) * F.sum("n").over(Window.partitionBy(*keys, "rep"))
    at = weight.withColumn("upto", F.sum("n").over(upto)).withColumn("goal", goal)
    at = at.where("upto >= goal and upto - n < goal or goal <= 0 and upto = n").select(*keys, "__block", "rep", (F.col("goal") - F.col("upto") + F.col("n")).alias("rest")).persist()  # a row a resample, read three times
    types = dict(df.dtypes)

    def inside(key: tuple, frame: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        frame, wanted = frame.sort_values("__x", ignore_index=True), wanted.sort_values("rep", ignore_index=True)
        x, own, found = frame["__x"].to_numpy(), Weights(frame[row_key].fillna(-1).to_numpy(), seed), []
        for rep, rest in zip(wanted["rep"], wanted["rest"]):
            w = own.of(int(rep), int(rep) + 1)[0].cumsum(dtype=np.int64)
            found.append(x[int(np.searchsorted(w, max(rest, 0.5), "left"))])
        out = pd.DataFrame({"rep": wanted["rep"].astype(np.int32), "quantile": np.asarray(found, np.float64)})
        for k, v in zip(keys, key):
            out[k] = v
        return out

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "rep int, quantile double"])
    by = [*keys, "__block"]
    # one row of a single value stands for all of them
    single = rows.where("__block % 2 = 1").groupBy(*by).agg(F.min("__x").alias("quantile")).join(at, by).select(*keys, "rep", "quantile")
    ordered = rows.where("__block % 2 = 0").select(*by, row_key, "__x").join(F.broadcast(at.select(*by).distinct()), by, "left_semi")
    return _spread(ordered, *by).groupBy(*by).cogroup(_spread(at.where("__block % 2 = 0"), *by).groupBy(*by)).applyInPandas(inside, schema).unionByName(single)


def deltas(drawn: DataFrame, by: str, pairs: list[tuple[str, str]], values: list[str]) -> DataFrame:
    """a, b, rep and, for each of ``values``, its difference between the groups a and b of ``by`` in the same resample."""
    picked = [F.max(F.when(F.col(by) == g, F.col(v))).alias(f"{v} {g}") for g in dict.fromkeys(g for p in pairs for g in p) for v in values]
    wide = drawn.groupBy("rep").agg(*picked)
    entry = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[(F.col(f"{v} {a}") - F.col(f"{v} {b}")).alias(v) for v in values]) for a, b in pairs]
    return wide.select("rep", F.explode(F.array(*entry)).alias("e")).select("e.a", "e.b", "rep", *[f"e.{v}" for v in values])
