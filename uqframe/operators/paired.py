"""Paired comparison of systems on the same samples: discordant counts, exact McNemar, Holm, worst cases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.functions import vectors as V

#: Successes up to which an exact tail is added term by term.
TERMS = 2_000


def pivot_systems(df: DataFrame, names: list[str], system: str = "system", key: str = "row_id") -> DataFrame:
    """One row a sample with ``<name>_pred`` of each system and the label, without a self-join; samples that lack a system are dropped."""
    picked = [F.max(F.when(F.col(system) == n, F.col("pred"))).alias(f"{n}_pred") for n in names]
    wide = df.where(F.col(system).isin(names)).groupBy(key).agg(F.max("label").alias("label"), F.min("label").alias("__l"), *picked)
    return wide.where((F.col("label") == F.col("__l")) & ~F.exists(F.array(*[F.col(f"{n}_pred") for n in names]), lambda x: x.isNull())).drop("__l")


def discordant(a: Column, b: Column) -> list[Column]:
    """b: A right and B wrong; c: A wrong and B right."""
    return [F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c")]


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p of min(b, c) successes in b + c fair draws; 1 if there are none.

    The tail is its last term times a sum of falling ratios. Up to ``TERMS`` successes every term is added; beyond, the
    last term is Stirling's series, and ratios end after ten standard deviations, where they are below 1e-80.
    """
    return V.let(F.struct((b + c).cast("bigint").alias("n"), F.least(b, c).cast("bigint").alias("m")), lambda t: _exact(t["n"], t["m"]))


def _exact(n: Column, m: Column) -> Column:
    start = F.struct(F.lit(1.0).alias("s"), F.lit(0.0).alias("l"))
    step = lambda a, i: F.struct((1.0 + a["s"] * i / (n - i + 1)).alias("s"), (a["l"] + F.ln((n - i + 1) / i)).alias("l"))
    few = F.aggregate(F.when(m > 0, F.sequence(F.lit(1).cast("bigint"), m)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["s"] * F.exp(a["l"] - n * math.log(2.0)))
    x, y, off = m.cast("double"), (n - m).cast("double"), (n - 2 * m) / n
    rest = lambda v: 1 / (12 * v) - 1 / (360 * v * v * v) + 1 / (1260 * v * v * v * v * v)  # noqa: E731  what Stirling's formula leaves of ln v!
    last = rest(n.cast("double")) - rest(x) - rest(y) - x * F.log1p(-off) - y * F.log1p(off) - 0.5 * F.ln(2 * math.pi * x * (y / n))
    ends = F.least(m, F.ceil(10 * F.sqrt(n.cast("double"))))
    ratios = F.aggregate(F.sequence(ends, F.lit(1).cast("bigint"), F.lit(-1).cast("bigint")), F.lit(1.0), lambda s, j: 1.0 + s * (m - j + 1) / (n - m + j))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * F.when(m <= TERMS, few).otherwise(ratios * F.exp(last))))


def holm(df: DataFrame, family: str, p: str = "p", key: str = "row") -> DataFrame:
    """``df`` with ``p_holm``: step-down adjustment within each family, ties by ``key``."""
    w = Window.partitionBy(family)
    by = w.orderBy(p, key)
    scaled = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(by) + 1) * F.col(p))
    return df.withColumn("__scaled", scaled).withColumn("p_holm", F.max("__scaled").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__scaled")


def counts_for(spark: SparkSession, accuracy: float, n: int) -> DataFrame:
    """All counts k of n whose share prints as ``accuracy`` with four decimals."""
    lo, hi = math.floor((accuracy - 5e-5) * n), math.ceil((accuracy + 5e-5) * n)
    return spark.range(lo, hi + 1).where(F.round(F.col("id") / F.lit(float(n)), 4) == F.lit(round(accuracy, 4))).select(F.col("id").alias("k"))


def worst_case(spark: SparkSession, better: float, worse: float, n: int, most_discordant: int | None = None) -> DataFrame:
    """The largest exact p that two printed accuracies allow: k_better, k_worse, b, c, p. The enumeration is a few counts squared."""
    pairs = counts_for(spark, better, n).withColumnRenamed("k", "k_better").join(F.broadcast(counts_for(spark, worse, n).withColumnRenamed("k", "k_worse")), F.col("k_better") > F.col("k_worse"))
    d = F.col("k_better") - F.col("k_worse")
    most = 2 * F.least(F.lit(n) - F.col("k_better"), F.lit(n) - F.col("k_worse") - d) + d
    if most_discordant is not None:
        cap = F.lit(most_discordant) - F.when((F.lit(most_discordant) - d) % 2 != 0, 1).otherwise(0)
        most = F.least(most, cap)
    c = F.floor((most - d) / 2).cast("bigint")
    rows = pairs.select("k_better", "k_worse", (c + d).alias("b"), c.alias("c"))
    full = rows.withColumn("p", mcnemar_exact(F.col("b"), F.col("c")))
    return full.agg(F.max_by(F.struct("k_better", "k_worse", "b", "c", "p"), F.struct("p", -F.col("k_better"), -F.col("k_worse"))).alias("w")).select("w.*")


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: a sum of positive terms below 3, a continued fraction from there on."""
    start = F.struct(x.alias("sum"), x.alias("term"))
    step = lambda a, n: F.struct((a["sum"] + a["term"] * (2.0 * x * x / (2 * n + 1))).alias("sum"), (a["term"] * (2.0 * x * x / (2 * n + 1))).alias("term"))
    near = 1.0 - F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda a: a["sum"]) * F.exp(-x * x) * (2.0 / math.sqrt(math.pi))
    under = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda a, k: x + (k / 2.0) / a)
    return F.when(x < 3.0, near).otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * under))


def mcnemar_corrected(b: Column, c: Column) -> Column:
    """p of the chi-square test with continuity correction; 1 if there are no discordant pairs."""
    n = (b + c).cast("double")
    statistic = F.pow(F.abs(b - c) - 1.0, F.lit(2.0)) / F.nullif(n, F.lit(0.0))
    return F.coalesce(erfc(F.sqrt(statistic / 2.0)), F.lit(1.0))


def worst_cases(df: DataFrame, keys: list[str], better: str = "better", worse: str = "worse", n: str = "n", most: str = "most") -> DataFrame:
    """keys, k_better, k_worse, b, c, p, p_corrected: the largest exact p that two accuracies printed with four decimals allow.

    ``n`` is the sample's size and ``most`` a bound on discordant pairs (null: none); of equal p the least counts. Rows that
    no pair of counts with k_better > k_worse fits have no result.

    No pair has to be tried but two: with b - c = k_better - k_worse, the tail only grows as that difference falls, as
    k_better falls and as k_worse rises, bounded or not. So the least k_better goes with the greatest k_worse below it. Where
    both accuracies print alike, neighbours have p = 1, the least of them too. Where that p is 0 in a double, all are.
    """
    prints = lambda k, shown: F.round(k / F.col(n).cast("double"), 4) == F.round(F.col(shown), 4)
    near = lambda shown, off: F.col(shown) * F.col(n) + off * F.col(n)
    counts = lambda shown: F.filter(F.sequence(F.floor(near(shown, -5e-5)), F.ceil(near(shown, 5e-5))), lambda k: prints(k, shown))

    def least_c(k_better: Column, k_worse: Column) -> Column:
        d = k_better - k_worse
        free = 2 * F.least(F.col(n) - k_better, F.col(n) - k_worse - d) + d
        cap = F.col(most) - (F.col(most) - d) % 2
        return F.floor((F.coalesce(F.least(free, cap), free) - d) / 2).cast("bigint")

    def once(rows: DataFrame, *names: str, **made: Column) -> DataFrame:
        """``rows`` with columns that are computed once, however often later ones name them."""
        entry = F.struct(*[F.col(c) for c in names], *[c.alias(k) for k, c in made.items()])
        return rows.select(F.explode(F.array(entry)).alias("e")).select("e.*")

    def with_p(rows: DataFrame, k_worse: Column) -> DataFrame:
        rows = once(rows, *same, "k_better", "__w", k_worse=k_worse)
        rows = once(rows, *same, "k_better", "__w", "k_worse", c=least_c(F.col("k_better"), F.col("k_worse"))).withColumn("b", F.col("c") + F.col("k_better") - F.col("k_worse"))
        return once(rows, *same, "k_better", "__w", "k_worse", "b", "c", p=mcnemar_exact(F.col("b"), F.col("c")))

    same = [*keys, n, most]
    rows = once(df, *same, __b=counts(better), __w=counts(worse))
    rows = once(rows, *same, "__w", k_better=F.array_min(F.filter("__b", lambda k: k > F.array_min("__w"))))
    rows = once(rows, *same, "k_better", __w=F.filter("__w", lambda k: (k < F.col("k_better")) & (least_c(F.col("k_better"), k) >= 0))).where("size(__w) > 0")
    best = with_p(rows, F.array_max("__w"))
    best = with_p(best, F.when(F.col("p") > 0, F.col("k_worse")).otherwise(F.array_min("__w")))
    return best.select(*keys, "k_better", "k_worse", "b", "c", "p", mcnemar_corrected(F.col("b"), F.col("c")).alias("p_corrected"))
