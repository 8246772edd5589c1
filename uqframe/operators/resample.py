"""Bootstrap: resampled counts, weighted statistics of each resample, percentile intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.functions import vectors as V
from uqframe.operators.ranking import running

#: 32-bit words of the exact stream that a state starts, positions whose values a task holds, draws of a task and draws at once.
STREAM_BLOCK, HELD_POSITIONS, TASK_DRAWS, DRAWS_AT_ONCE = 1 << 20, 1 << 22, 1 << 28, 1 << 16
#: Rows of a block whose area under the curve is taken at once, and of one whose calibration is.
AREA_ROWS, CALIBRATION_ROWS = 100_000, 100_000
#: Counts that are drawn at once: what stays in a core's cache.
TILE = 1 << 17
#: Rows a cell, up to which rows are drawn one by one: a multinomial count costs as much as that many draws.
ROWS_A_CELL = 4


def hash_resamples(spark: SparkSession, n: int, reps: int) -> DataFrame:
    """rep, pos, cnt: position md5("rep-draw") mod n for n draws of each resample, the same in any engine."""
    draws = spark.range(reps * n).select((F.col("id") / n).cast("bigint").alias("rep"), (F.col("id") % n).alias("draw"))
    pos = F.conv(F.substring(F.md5(F.concat_ws("-", "rep", "draw")), 1, 8), 16, 10).cast("bigint") % n
    return draws.select("rep", pos.alias("pos")).groupBy("rep", "pos").agg(F.count(F.lit(1)).alias("cnt"))


def hash_counts(spark: SparkSession, n: int, reps: int) -> DataFrame:
    """pos, cnt (array of its count in each resample) of ``hash_resamples``: a row a position, for statistics that order rows once."""
    draws = spark.range(reps * n).select((F.col("id") / n).cast("bigint").alias("rep"), (F.col("id") % n).alias("draw"))
    pos = F.conv(F.substring(F.md5(F.concat_ws("-", "rep", "draw")), 1, 8), 16, 10).cast("bigint") % n
    dealt = draws.select(F.col("rep").cast("int").alias("rep"), pos.alias("pos")).repartition("pos")  # before they are counted: few draws of a position meet earlier
    return dealt.groupBy("pos").agg(*[F.count_if(F.col("rep") == r).alias(f"c{r}") for r in range(reps)]).select("pos", F.array(*[f"c{r}" for r in range(reps)]).alias("cnt"))


def positions(df: DataFrame, order: str = "row_id") -> DataFrame:
    """``df`` with ``pos`` from 0 in the order of ``order``, without a single-task sort."""
    return running(df, [], [order], {"pos": F.lit(1)}).withColumn("pos", F.col("pos") - 1)


def resampled(df: DataFrame, resamples: DataFrame, keys: list[str], statistics: dict[str, Column]) -> DataFrame:
    """Per resample and group the weighted sums of additive statistics; ``df`` has ``pos``."""
    own = df.select("pos", *keys, *[c.alias(n) for n, c in statistics.items()])
    return resamples.join(own, "pos").groupBy("rep", *keys).agg(*[F.sum(F.col("cnt") * F.col(n)).alias(n) for n in statistics], F.sum("cnt").alias("n"))


def interval(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """lo and hi: exact linear percentiles of ``value`` over resamples; NaN and null are left out."""
    tail = (1 - level) / 2
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail))).alias("q")).select(*keys, F.get("q", 0).alias("lo"), F.get("q", 1).alias("hi"))


def intervals(df: DataFrame, keys: list[str], values: list[str], level: float = 0.95) -> DataFrame:
    """``<value>_lo`` and ``<value>_hi`` of several values in one aggregation, as ``interval`` gives them."""
    tail = (1 - level) / 2
    quantiles = [F.percentile(F.nanvl(v, F.lit(None)), F.array(F.lit(tail), F.lit(1 - tail))).alias(v) for v in values]
    ends = [F.get(v, i).alias(f"{v}_{end}") for v in values for i, end in enumerate(("lo", "hi"))]
    return df.groupBy(*keys).agg(*quantiles).select(*keys, *ends)


def excludes_zero(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return (lo_a <= hi_b) & (lo_b <= hi_a)


def stream_words(seed: int, start: int, count: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What the 32-bit words ``start`` to ``start + count`` (both even) of PCG64(seed) give for integers below n: values, accepted.

    NumPy takes each 64-bit output as two words, the low one first, multiplies a word by n and rejects it where the
    product's low half is below 2^32 mod n; the high half is the value. So any part of a stream can be drawn alone.
    """
    words = np.random.PCG64(seed).advance(start // 2).random_raw(count // 2)
    halves = np.stack([words & 0xFFFFFFFF, words >> 32], axis=1).ravel()
    product = halves * np.uint64(n)
    return (product >> 32).astype(np.int64), (product & 0xFFFFFFFF) >= np.uint64((1 << 32) % n)


def stream_starts(spark: SparkSession, n: int, reps: int, seed: int = 42, block: int = STREAM_BLOCK) -> list[tuple[int, int]]:
    """(block of words, draws accepted before it) of NumPy's default_rng(seed).integers(0, n, (reps, n)), counted in parallel; 1 < n < 2^32.

    One number a block reaches the driver.
    """
    if not 1 < n < 1 << 32:
        raise ValueError("the exact stream is NumPy's 32-bit one: 1 to 2^32 - 1 samples")
    least = np.uint32((1 << 32) % n)

    def accepted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for b in frame["id"]:
                words = np.random.PCG64(seed).advance(int(b) * block // 2).random_raw(block // 2).view("<u4")
                made.append(int(np.count_nonzero(words * np.uint32(n) >= least)))
            yield pd.DataFrame({"b": frame["id"], "n": made})

    starts, total = [], 0
    while total < reps * n:
        at, more = len(starts), -(-(reps * n - total) // block)
        counted = spark.range(at, at + more, 1, max(1, min(more, 10_000))).mapInPandas(accepted, "b bigint, n bigint")
        for r in sorted(counted.collect()):
            starts.append((r.b, total))
            total += r.n
    return starts


def exact_stream(df: DataFrame, columns: list[str], reps: int, seed: int = 42, block: int = STREAM_BLOCK, order: str = "row_id", held: int = HELD_POSITIONS, draws: int = TASK_DRAWS) -> DataFrame:
    """rep and the resampled mean of each column, by the index stream of NumPy's default_rng(seed).integers(0, n).

    Draws are neither stored nor shuffled: positions are cut into ranges of at most ``held``, the stream into parts of about
    ``draws``, and a task draws one part and adds up the values of one range. So values are shuffled once for each part, and a
    part is drawn once for each range. A null value makes the mean NaN, as NaN does, where it is drawn.
    """
    spark, n, names = df.sparkSession, df.count(), [f"v{i}" for i in range(len(columns))]
    if n == 0:
        return spark.createDataFrame([], "rep bigint, " + ", ".join(f"{c} double" for c in columns))
    own = positions(df.select(order, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(v) for c, v in zip(columns, names)]), order).select("pos", *names)
    if n == 1:  # NumPy draws nothing
        return own.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))).alias("rep"), *[F.col(v).alias(c) for v, c in zip(names, columns)])
    block += block % 2
    starts = stream_starts(spark, n, reps, seed, block)
    cuts, tasks = -(-n // held), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(len(starts), max(-(-2 * tasks // cuts), -(-reps * n // draws)))
    of_part = [starts[len(starts) * i // parts : len(starts) * (i + 1) // parts] for i in range(parts)]
    ends = [p[0][1] for p in of_part[1:]] + [reps * n]
    spans = [(p[0][0], p[0][1], end) for p, end in zip(of_part, ends)]  # a part's first block, and its draws from and to

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(0).to_numpy()
            values = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(names))], axis=1)
            for cut in np.unique(pos // held):
                at = pos // held == cut
                yield pa.RecordBatch.from_pydict({"cut": [cut], "pos": [pos[at].astype("<i8").tobytes()], "x": [values[at].tobytes()]})

    def added(key: tuple, table: pa.Table) -> pa.Table:
        cut, part = (k.as_py() for k in key)
        low, x = cut * held, np.empty((min(held, n - cut * held), len(names)))
        for pos, values in zip(table.column("pos"), table.column("x")):
            x[np.frombuffer(pos.as_py(), "<i8") - low] = np.frombuffer(values.as_py()).reshape(-1, len(names))
        columns_ = [np.ascontiguousarray(c) for c in x.T]
        first, at, end = spans[part]
        stream = np.random.Generator(np.random.PCG64(seed).advance(first * block // 2))
        reps_, sums = [], []
        while at < end:
            rep, upto, total = at // n, min(end, (at // n + 1) * n), np.zeros(len(names))
            while at < upto:
                drawn = stream.integers(0, n, min(DRAWS_AT_ONCE, upto - at), np.uint32)
                at += len(drawn)
                if cuts > 1:
                    drawn -= np.uint32(low)  # those before the range wrap around
                    drawn = drawn[drawn < len(x)]
                total += [np.take(c, drawn).sum() for c in columns_]
            reps_.append(rep)
            sums.append(total)
        return pa.table({"rep": pa.array(reps_, pa.int64()), **{v: c for v, c in zip(names, np.array(sums).T.copy())}})

    pieces = own.mapInArrow(packed, "cut bigint, pos binary, x binary").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # as many partitions as groups: a group is a few bytes but millions of draws, so small partitions must not be merged
    dealt = pieces.repartition(max(tasks, min(10_000, cuts * parts)), "cut", "part").groupBy("cut", "part")
    made = dealt.applyInArrow(added, "rep bigint, " + ", ".join(f"{v} double" for v in names))
    return made.groupBy("rep").agg(*[(F.sum(v) / n).alias(c) for v, c in zip(names, columns)])


def ranges(cells: DataFrame, keys: list[str], order: str, count: int) -> DataFrame:
    """``cells`` with ``block``: which of ``count`` ranges of ``order``, cut at each group's quantiles; equal values share a block.

    The ranges' ends, fewer than ``count`` numbers a group, reach the driver; a value finds its range by bisection. Nulls are
    before all others, in block -1.
    """
    at = F.percentile_approx(F.col(order).cast("double"), [i / count for i in range(1, count)] or [0.5], 10_000)
    name = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("")
    ends = {r["k"]: np.unique(np.array(r["b"] or [], np.float64)) for r in cells.groupBy(name.alias("k")).agg(at.alias("b")).collect()}
    shared = cells.sparkSession.sparkContext.broadcast(ends)

    def block(key: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int32)
        for k, own in key.groupby(key).indices.items():
            out[own] = np.searchsorted(shared.value[k], x.to_numpy()[own], "left")
        return pd.Series(out)

    return cells.withColumn("block", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.pandas_udf(block, "int")(name, F.col(order).cast("double"))))


def _deal(rng: np.random.Generator, totals: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Some resamples by cells: each deals its total over the cells by their sizes ``n``, row by row unless cells hold many rows."""
    rows = int(n.sum())
    if rows > ROWS_A_CELL * len(n):
        return rng.multinomial(totals, n / n.sum())
    cell = None if rows == len(n) else np.repeat(np.arange(len(n), dtype=np.int32), n.astype(np.int64))
    out = np.empty((len(totals), len(n)), np.int64)
    for i, total in enumerate(totals):
        drawn = rng.integers(0, rows, total, dtype=np.int32)
        out[i] = np.bincount(drawn if cell is None else cell[drawn], minlength=len(n))
    return out


def _sizes(cells: DataFrame, keys: list[str]) -> dict[tuple, dict[int, int]]:
    """The rows of each block of each group."""
    sizes: dict[tuple, dict[int, int]] = {}
    for r in cells.groupBy(*keys, "block").agg(F.sum("n").alias("n")).orderBy(*keys, "block").collect():
        sizes.setdefault(tuple(r[k] for k in keys), {})[r["block"]] = r["n"]
    return sizes


def _totals(sizes: dict[int, int], block: int, reps: int, seed: int) -> np.ndarray:
    """What ``block`` gets of each resample of a group with these blocks; the same in every task."""
    of_blocks = np.array(list(sizes.values()), dtype=np.float64)
    return np.random.default_rng(seed).multinomial(int(of_blocks.sum()), of_blocks / of_blocks.sum(), size=reps)[:, list(sizes).index(block)]


def resample_cells(cells: DataFrame, keys: list[str], order: list[str], statistic: Callable[[pd.DataFrame, np.ndarray], dict[str, np.ndarray]], schema: str, reps: int, seed: int = 42) -> DataFrame:
    """``statistic`` of each block's cells in each resample: keys, block, rep and the columns of ``schema``.

    ``cells`` has ``n`` rows of the sample each, and ``block``. Resampling the rows with replacement gives a cell a
    multinomial count, so counts are drawn instead of rows: first the blocks' totals of each resample, the same in
    every task, then the counts within a block. ``statistic`` gets a block's cells in ``order`` and a matrix of some
    resamples by cells. Groups of ``keys`` are drawn apart; what must share its draws belongs into one cell.
    """
    sizes = _sizes(cells, keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, ignore_index=True)
        group, block = tuple(frame[k].iloc[0] for k in keys), int(frame["block"].iloc[0])
        totals = _totals(sizes[group], block, reps, seed)
        n, rng, parts = frame["n"].to_numpy(np.float64), np.random.default_rng([seed, block]), []
        step = max(1, TILE // len(frame))
        for start in range(0, reps, step):
            parts.append(statistic(frame, _deal(rng, totals[start : start + step], n)))
        columns = {c: np.concatenate([np.asarray(p[c]) for p in parts]) for c in parts[0]}
        made = pd.DataFrame({"rep": np.arange(reps), **{c: list(v) if v.ndim > 1 else v for c, v in columns.items()}})
        for k in [*keys, "block"]:
            made[k] = frame[k].iloc[0]
        return made

    types = dict(cells.dtypes)
    # a fixed number of partitions: a cell is a few bytes but thousands of draws, so small partitions must not be merged
    dealt = cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "block")
    return dealt.groupBy(*keys, "block").applyInPandas(run, ", ".join([f"{k} {types[k]}" for k in [*keys, "block"]] + ["rep bigint", schema]))


def auroc_resamples(df: DataFrame, keys: list[str], reps: int, score: str = "score", positive: str = "positive", blocks: int | None = None) -> DataFrame:
    """keys, rep, auroc: rows are summed to cells of equal score and class, and a block gives its own area and totals only."""
    cells = df.groupBy(*keys, score, positive).agg(F.count(F.lit(1)).alias("n")).persist()
    count = blocks or max(8, min(1_000, cells.count() // 20_000))

    def area(frame: pd.DataFrame, counts: np.ndarray) -> dict[str, np.ndarray]:
        up, value = frame[positive].to_numpy(bool), frame[score].to_numpy()
        pos, neg = counts[:, up], np.zeros((len(counts), int((~up).sum()) + 1), np.int64)
        np.cumsum(counts[:, ~up], axis=1, out=neg[:, 1:])
        # a positive beats the negatives before the first of its score, and half of those up to the last
        before, upto = (np.searchsorted(value[~up], value[up], side) for side in ("left", "right"))
        beaten = np.take(neg, before, axis=1) + np.take(neg, upto, axis=1)
        return {"pos": pos.sum(axis=1).astype(np.float64), "neg": neg[:, -1].astype(np.float64), "area": 0.5 * np.einsum("ij,ij->i", pos, beaten, dtype=np.float64, casting="unsafe")}

    parts = resample_cells(ranges(cells, keys, score, count), keys, [score, positive], area, "pos double, neg double, area double", reps)
    return _whole_area(parts, keys)


def auroc_of_counts(df: DataFrame, keys: list[str], reps: int, score: str = "score", positive: str = "positive", counts: str = "cnt", rows: int = AREA_ROWS) -> DataFrame:
    """keys, rep, auroc of rows with an array of their counts in each resample; null where a resample lacks a class.

    Rows are cut at quantiles of the score and summed to cells of equal score and class; a block of cells is sorted once for all
    resamples and gives its own area and totals only.
    """
    most = max((r["n"] for r in df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()), default=0)
    count = max(2, min(10_000, -(-most // rows)))
    grid = F.percentile_approx(F.col(score), [i / count for i in range(1, count)], 10_000)
    bounds = df.groupBy(*keys).agg(F.array_distinct(grid).alias("__b"))
    cut = df.join(F.broadcast(bounds), keys).withColumn("block", F.size(F.filter("__b", lambda b: b < F.col(score))))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), count)
    cells = cut.repartition(tasks, *keys, "block").groupBy(*keys, "block", score, positive).agg(*[F.sum(F.get(counts, r)).alias(f"c{r}") for r in range(reps)])

    def area(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(score, ignore_index=True)
        value, up = frame[score].to_numpy(), frame[positive].to_numpy(bool)[:, None]
        first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) & ~((value[1:] != value[1:]) & (value[:-1] != value[:-1]))])
        drawn = frame[[f"c{r}" for r in range(reps)]].to_numpy(np.float64)
        pos, neg = (np.add.reduceat(np.where(x, drawn, 0.0), first, axis=0) for x in (up, ~up))
        made = pd.DataFrame({"rep": np.arange(reps), "pos": pos.sum(axis=0), "neg": neg.sum(axis=0), "area": (pos * (neg.cumsum(axis=0) - 0.5 * neg)).sum(axis=0)})
        for k in [*keys, "block"]:
            made[k] = frame[k].iloc[0]
        return made

    types = dict(cells.dtypes)
    parts = cells.groupBy(*keys, "block").applyInPandas(area, ", ".join([f"{k} {types[k]}" for k in [*keys, "block"]] + ["rep bigint", "pos double", "neg double", "area double"]))
    return _whole_area(parts, keys)


def _whole_area(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rep, auroc from the area and totals of each block of a resample."""
    below = Window.partitionBy(*keys, "rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.withColumn("area", F.col("area") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    return whole.groupBy(*keys, "rep").agg((F.sum("area") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auroc"))


def paired_resamples(df: DataFrame, keys: list[str], classes: int, reps: int) -> DataFrame:
    """keys, rep, d_accuracy, d_macro_f1: system ``a`` less ``b``; ``df`` has label, a and b, their predictions of a row.

    Macro F1 is over fixed classes. Rows are summed to cells of label and both predictions, at most classes cubed.
    """
    cells = df.groupBy(*keys, "label", "a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.lit(0))

    def delta(frame: pd.DataFrame, counts: np.ndarray) -> dict[str, np.ndarray]:
        hot = {c: (frame[c].to_numpy()[:, None] == np.arange(classes)).astype(np.float64) for c in ("label", "a", "b")}

        def measures(c: str) -> tuple[np.ndarray, np.ndarray]:
            right, both = counts @ (hot["label"] * hot[c]), counts @ hot["label"] + counts @ hot[c]
            return right.sum(axis=1) / counts.sum(axis=1), np.where(both > 0, 2 * right / np.maximum(both, 1), 0.0).sum(axis=1) / classes

        (accuracy_a, f1_a), (accuracy_b, f1_b) = measures("a"), measures("b")
        return {"d_accuracy": accuracy_a - accuracy_b, "d_macro_f1": f1_a - f1_b}

    return resample_cells(cells, keys, ["label", "a", "b"], delta, "d_accuracy double, d_macro_f1 double", reps).drop("block")


def calibration_resamples(df: DataFrame, keys: list[str], reps: int, key: str = "row_id", bins: int = V.BINS, blocks: int | None = None) -> DataFrame:
    """keys, rep, accuracy, mean_confidence, ece, brier, nll of predictions (label, pred, probs, ``key``).

    Rows are dealt into blocks by the hash of ``key``; a block gives sums only, one row a resample. Groups whose blocks are
    of the same sizes have the same draws, so a task draws a block's counts once for all of them and adds all their sums in one product.
    """
    conf = V.confidence(F.col("probs"))
    rows = df.select(*keys, F.col(key).alias("__k"), (F.col("pred") == F.col("label")).cast("double").alias("accuracy"), conf.alias("mean_confidence"), V.brier(F.col("probs"), F.col("label")).alias("brier"), V.nll(F.col("probs"), F.col("label")).alias("nll"), V.bin_index(conf, bins).alias("bin"), F.lit(1).alias("n"))
    count = blocks or max(8, min(1_000, rows.count() // CALIBRATION_ROWS))
    sums, gaps = ["accuracy", "mean_confidence", "brier", "nll"], [f"gap_{i}" for i in range(bins)]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("__k"), F.lit(count)).cast("int"))
    sizes, seed, types = _sizes(dealt, keys), 42, dict(dealt.dtypes)

    def values(frame: pd.DataFrame) -> np.ndarray:
        off = (frame["accuracy"] - frame["mean_confidence"]).to_numpy()[:, None] * (frame["bin"].to_numpy()[:, None] == np.arange(bins))
        return np.hstack([frame[sums].to_numpy(np.float64), off])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block, alike, made = int(frame["block"].iloc[0]), {}, []
        frame = frame.sort_values("__k", ignore_index=True)
        for k, own in frame.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(frame)))]:
            group = tuple(frame[c].iloc[own[0]] for c in keys)
            alike.setdefault(tuple(sizes[group].items()), []).append((group, values(frame.iloc[own])))
        for own, groups in alike.items():
            totals, rng = _totals(dict(own), block, reps, seed), np.random.default_rng([seed, block])
            x = np.hstack([v for _, v in groups])
            step, one = max(1, TILE // len(x)), np.ones(len(x))
            drawn = np.concatenate([_deal(rng, totals[start : start + step], one).astype(np.float64) @ x for start in range(0, reps, step)])
            for (group, _), part in zip(groups, np.split(drawn, len(groups), axis=1)):
                made.append(pd.DataFrame({**dict(zip(keys, group)), "rep": np.arange(reps), **dict(zip([*sums, *gaps], part.T)), "n": totals.astype(np.float64)}))
        return pd.concat(made)

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "rep bigint", *[f"{c} double" for c in [*sums, *gaps, "n"]]])
    # as many partitions as blocks: a row is a few bytes but thousands of draws, so small partitions must not be merged
    parts = dealt.repartition(max(count, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block").groupBy("block").applyInPandas(run, schema)
    whole = parts.groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in [*sums, *gaps, "n"]])
    ece = sum((F.abs(g) for g in gaps), F.lit(0.0)) / F.col("n")
    return whole.select(*keys, "rep", *[(F.col(c) / F.col("n")).alias(c) for c in sums], ece.alias("ece"))
