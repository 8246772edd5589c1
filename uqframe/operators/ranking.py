"""Distributed running sums: order within groups without sending a group to one task."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

#: Ranges of the order column, or twice the shuffle partitions where those are more; one bound of each reaches every task.
RANGES = 64
#: Ranges of one value at most, as places between those of the values before and behind it.
SUBRANGES = 1 << 20
#: Share of the rows on either side of a quantile that are counted by value, and the sketch's accuracy that finds them.
ROOM, ACCURACY = 2e-5, 100_000


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with running sums over each group of ``keys`` in the order of ``order``, the row itself included.

    Rows are cut at quantiles of the first order column; each range of a group is summed in a window of its own and
    starts from the totals of the ranges before it, which are few. A value that fills two quantiles or more has ranges of
    its own, cut at quantiles of the second order column if that is a number; else its rows stay in one range. ``df`` is
    read for the bounds, the totals and the sums, so one that is dear to make belongs into a table first.
    """
    ranges = ranges or max(RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grid, value = [i / ranges for i in range(1, ranges)], F.col(order[0]).cast("double")
    found = df.agg(F.percentile_approx(value, grid, 10_000).alias("b"))
    own, spare = F.lit(0), None
    bounds, often = found.select(F.array_distinct("b")).scalar(), None
    if len(order) > 1 and isinstance(df.schema[order[1]].dataType, NumericType):
        often = found.select(F.array_distinct(F.filter("b", lambda x, i: x == F.get("b", i + 1)))).scalar()
        second = F.col(order[1]).cast("double")
        tied = df.select(value.alias("x"), second.alias("y")).withColumn("o", often).where(F.array_contains("o", F.col("x")))
        ends = tied.groupBy("x").agg(F.array_distinct(F.percentile_approx("y", grid, 10_000)).alias("e"))
        spare = ends.agg(F.map_from_entries(F.collect_list(F.struct("x", "e")))).scalar()  # at most a quantile's value each
    # plus nothing that Spark 4.1 takes for a constant: from the definition of __r it can infer a filter for the join's
    # other side on a column that isn't there
    place = 2 * F.size(F.filter("__b", lambda b: b < value))
    cut = df.withColumn("__b", bounds)
    if often is not None:
        cut = cut.withColumns({"__o": often, "__e": spare})
        inner = F.size(F.filter(F.coalesce(F.try_element_at("__e", value), F.array().cast("array<double>")), lambda b: b < second))
        own = F.when(F.coalesce(F.array_contains("__o", value), F.lit(False)), F.lit(SUBRANGES) + inner).otherwise(0)
    cut = cut.withColumn("__r", place.cast("long") * SUBRANGES + own + 0 * F.spark_partition_id()).drop("__b", "__o", "__e")
    cut = cut.withColumns({f"__{n}": c for n, c in sums.items()})
    totals = cut.groupBy(*keys, "__r").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__r", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({n: F.sum(f"__{n}").over(inside) for n in sums})
    # rows are dealt and sorted by these keys already; neither side is broadcast, whatever its size
    joined = summed.join(offsets.hint("merge"), [*keys, "__r"])
    return joined.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums}).drop("__r", *[f"__{n}" for n in sums], *[f"__o_{n}" for n in sums])


def quantile(df: DataFrame, value: str, q: float = 0.5) -> float | None:
    """The exact quantile of ``value``, linear between neighbours as ``percentile`` has it; null without values.

    ``percentile`` merges all distinct values in one task. Here a sketch gives a range around the quantile, and only the
    rows in it are counted by value: a share of about ROOM. Those counts reach the driver.
    """
    own = df.select(F.col(value).cast("double").alias("x")).where("x is not null")
    n, room = own.count(), ROOM
    if not n:
        return None
    at = q * (n - 1)
    ranks = (math.floor(at), math.ceil(at))
    while True:
        ends = [max(0.0, (ranks[0] - 1) / n - room), min(1.0, (ranks[1] + 2) / n + room)]
        lo, hi = own.agg(F.percentile_approx("x", ends, ACCURACY)).head()[0]
        counted = own.where(F.col("x") <= hi).groupBy(F.when(F.col("x") >= lo, F.col("x")).alias("x")).count().collect()
        below = sum(r["count"] for r in counted if r["x"] is None)
        inside = sorted((r["x"], r["count"]) for r in counted if r["x"] is not None)
        upto = below + np.cumsum([c for _, c in inside])
        if below <= ranks[0] and upto[-1] > ranks[1]:
            a, b = (inside[int(np.searchsorted(upto, k, "right"))][0] for k in ranks)
            return a if a == b else (ranks[1] - at) * a + (at - ranks[0]) * b
        room *= 4
