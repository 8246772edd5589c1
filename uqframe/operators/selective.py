"""Error detection and selective prediction: AUROC, risk and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.functions import vectors as V
from uqframe.operators.ranking import RANGES, running
from uqframe.operators.resample import ranges

#: Scores are ranked at this many decimals, so engines that differ in the last digit agree.
PLACES = 12
COVERAGE = 0.8
#: Accuracy to hold, as a fraction of integers.
TARGET = (9, 10)


def scores_long(served: DataFrame, pooled: DataFrame) -> DataFrame:
    """row_id, score_id, score, ok for S1 to S6. S1 goes with the served predictions, the others with the pooled ones."""
    a = served.select("row_id", V.confidence(F.col("probs")).alias("c"), (F.col("pred") == F.col("label")).alias("ok_a"))
    b = pooled.select("row_id", V.confidence(F.col("probs")).alias("cb"), (F.col("pred") == F.col("label")).alias("ok_b"), "pred_entropy", "exp_entropy", "mi", "prob_std")
    both = a.join(b, "row_id")
    entry = lambda name, score, ok: F.struct(F.lit(name).alias("score_id"), F.round(score, PLACES).alias("score"), F.col(ok).alias("ok"))
    scores = F.array(
        entry("S1", 1.0 - F.col("c"), "ok_a"), entry("S2", 1.0 - F.col("cb"), "ok_b"), entry("S3", F.col("pred_entropy"), "ok_b"),
        entry("S4", F.col("exp_entropy"), "ok_b"), entry("S5", F.col("mi"), "ok_b"), entry("S6", F.col("prob_std"), "ok_b"),
    )
    return both.select("row_id", F.explode(scores).alias("s")).select("row_id", "s.*")


def auroc(df: DataFrame, keys: list[str], score: str = "score", positive: str = "positive", weight: str | None = None) -> DataFrame:
    """Chance that a positive scores above a negative, ties one half; null unless both occur.

    Rows are summed by distinct score before they are ordered, so ties cost nothing. Each of RANGES ranges of scores is ordered
    by itself and gives its own area and totals; ``df`` is read twice, for the ranges' ends and for the sums.
    """
    w = F.col(weight) if weight else F.lit(1)
    own = df.select(*keys, score, F.col(positive).alias("__up"), w.alias("__w"))
    pos, neg = F.sum(F.when(F.col("__up"), F.col("__w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("__up"), 0).otherwise(F.col("__w"))).alias("neg")
    by_score = ranges(own, keys, score, RANGES).groupBy(*keys, "block", score).agg(pos, neg)
    upto = F.sum("neg").over(Window.partitionBy(*keys, "block").orderBy(score))
    parts = by_score.withColumn("area", F.col("pos") * (upto - F.col("neg") + 0.5 * F.col("neg"))).groupBy(*keys, "block").agg(*[F.sum(c).alias(c) for c in ("area", "pos", "neg")])
    below = F.sum("neg").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    whole = parts.withColumn("area", F.col("area") + F.col("pos") * F.coalesce(below.cast("double"), F.lit(0.0)))
    return whole.groupBy(*keys).agg((F.sum("area") / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auroc"))


def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` (score, ok, row_id) with rank k from 1 and right answers among the first k, most certain first."""
    return running(df, keys, ["score", "row_id"], {"k": F.lit(1), "hits": F.col("ok").cast("bigint")})


def metrics(df: DataFrame, keys: list[str], coverage: float = COVERAGE) -> DataFrame:
    """aurc, accuracy at a coverage, largest coverage at the target accuracy (0 if none), n and errors by group."""
    own = ranked(df, keys)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    at = F.greatest(F.lit(1), F.least(F.col("n"), F.rint(coverage * F.col("n")).cast("bigint")))
    a, b = TARGET
    return own.join(size, keys).groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum((~F.col("ok")).cast("bigint")).alias("errors"),
        F.avg((F.col("k") - F.col("hits")) / F.col("k")).alias("aurc"),
        F.max(F.when(F.col("k") == at, F.col("hits") / F.col("k"))).alias("accuracy_at_coverage"),
        (F.coalesce(F.max(F.when(F.col("hits") * b >= F.col("k") * a, F.col("k"))), F.lit(0)) / F.max("n")).alias("coverage_at_accuracy"),
    )


def curve(df: DataFrame, keys: list[str], steps: int = 100) -> DataFrame:
    """Accuracy of the k most certain at each coverage step g / steps, k rounded half to even."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    grid = size.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    at = grid.withColumn("k", F.greatest(F.lit(1), F.least(F.col("n"), F.rint(F.col("step") / float(steps) * F.col("n")).cast("bigint"))))
    return ranked(df, keys).select(*keys, "k", "hits").join(at, [*keys, "k"]).select(*keys, "step", "k", (F.col("hits") / F.col("k")).alias("accuracy"))


def oracle_curve(df: DataFrame, keys: list[str], steps: int = 100) -> DataFrame:
    """The best possible curve: all right answers first."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("bigint")).alias("right"))
    grid = size.select(*keys, "n", "right", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    at = grid.withColumn("k", F.greatest(F.lit(1), F.least(F.col("n"), F.rint(F.col("step") / float(steps) * F.col("n")).cast("bigint"))))
    return at.select(*keys, "step", "k", (F.least("k", "right") / F.col("k")).alias("accuracy"))
