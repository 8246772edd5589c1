"""Classification and calibration metrics as one aggregation over predictions, grouped by any keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.functions import vectors as V


def correct() -> Column:
    return (F.col("pred") == F.col("label")).cast("double")


def accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(correct()).alias("accuracy"))


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that occur: label, pred, n. At most classes squared rows a group, whatever the data."""
    return df.groupBy(*keys, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def per_class(cells: DataFrame, keys: list[str], weight: str = "n") -> DataFrame:
    """True positives, labels and predictions of each class that occurs as either."""
    both = cells.select(*keys, F.explode(F.array(
        F.struct(F.col("label").alias("k"), F.when(F.col("label") == F.col("pred"), F.col(weight)).otherwise(0).alias("tp"), F.col(weight).alias("n_label"), F.lit(0).cast("bigint").alias("n_pred")),
        F.struct(F.col("pred").alias("k"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("n_label"), F.col(weight).alias("n_pred")),
    )).alias("c"))
    return both.groupBy(*keys, "c.k").agg(F.sum("c.tp").alias("tp"), F.sum("c.n_label").alias("n_label"), F.sum("c.n_pred").alias("n_pred"))


def f1() -> Column:
    return 2.0 * F.col("tp") / (F.col("n_label") + F.col("n_pred"))


def macro_f1(cells: DataFrame, keys: list[str], classes: int | None = None, weight: str = "n") -> DataFrame:
    """Macro F1 over ``classes`` fixed classes, absent ones as 0; or over the observed classes if None."""
    by = per_class(cells, keys, weight)
    return by.groupBy(*keys).agg((F.sum(f1()) / (F.lit(float(classes)) if classes else F.count(F.lit(1)))).alias("macro_f1"))


def balanced_accuracy(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean recall of the classes that occur as labels."""
    return per_class(cells, keys).where("n_label > 0").groupBy(*keys).agg(F.avg(F.col("tp") / F.col("n_label")).alias("balanced_accuracy"))


def calibration(df: DataFrame, keys: list[str], bins: int = V.BINS) -> DataFrame:
    """n, accuracy, mean_confidence, gap, ece, brier, nll by group: one shuffle of at most ``bins`` rows a task and group."""
    conf = V.confidence(F.col("probs"))
    rows = df.select(*keys, correct().alias("ok"), conf.alias("conf"), V.bin_index(conf, bins).alias("bin"), V.brier(F.col("probs"), F.col("label")).alias("b"), V.nll(F.col("probs"), F.col("label")).alias("l"))
    by_bin = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("ok", "conf", "b", "l")])
    n = F.sum("n")
    return by_bin.groupBy(*keys).agg(
        n.alias("n"),
        (F.sum("ok") / n).alias("accuracy"),
        (F.sum("conf") / n).alias("mean_confidence"),
        ((F.sum("conf") - F.sum("ok")) / n).alias("confidence_gap"),
        (F.sum(F.abs(F.col("ok") - F.col("conf"))) / n).alias("ece"),
        (F.sum("b") / n).alias("brier"),
        (F.sum("l") / n).alias("nll"),
    )


def reliability(df: DataFrame, keys: list[str], bins: int = V.BINS) -> DataFrame:
    """One row per group and bin, empty bins included: lower, upper, n, share, accuracy, mean_confidence (null if empty)."""
    conf = V.confidence(F.col("probs"))
    rows = df.select(*keys, correct().alias("ok"), conf.alias("conf"), V.bin_index(conf, bins).alias("bin"))
    seen = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accuracy"), F.avg("conf").alias("mean_confidence"))
    every = seen.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = every.join(seen, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(*keys, "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("share"), "accuracy", "mean_confidence")


def class_counts(df: DataFrame, keys: list[str], classes: DataFrame, label: str = "label") -> DataFrame:
    """Rows of each class of the dimension ``classes`` (label), absent ones as 0."""
    seen = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    listed = classes.agg(F.sort_array(F.collect_set(label))).scalar()  # as wide as the dimension
    every = seen.select(*keys).distinct().select(*keys, F.explode(listed).alias(label)) if keys else classes
    return every.join(seen, [*keys, label], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_weights(df: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """N / (classes * rows of the class) of each class that occurs."""
    seen = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return seen.select(label, "n", (F.sum("n").over(Window.partitionBy()) / (F.lit(float(classes)) * F.greatest("n", F.lit(1)))).alias("weight"))


def balance_drift(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Per class the largest difference of its share between splits."""
    share = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split)))
    splits = share.select(split).distinct().agg(F.count(F.lit(1)).alias("k"))
    by = share.groupBy(label).agg(F.max("share").alias("hi"), F.min("share").alias("lo"), F.count(F.lit(1)).alias("seen"))
    return by.join(F.broadcast(splits)).select(label, (F.col("hi") - F.when(F.col("seen") < F.col("k"), 0.0).otherwise(F.col("lo"))).alias("max_difference"))


def split_metrics(df: DataFrame, keys: list[str], classes: int, test: str = "test") -> DataFrame:
    """keys, split, n, accuracy, macro_f1; of the test split of pooled systems also accuracy_loglin, macro_f1_loglin,
    mean_prob_std and mean_mi, which are null elsewhere. Macro F1 is over fixed classes."""
    by = [*keys, "split"]
    whole = accuracy(df, by).join(macro_f1(confusion(df, by), by, classes), by)
    pooled = df.where((F.col("split") == test) & F.col("mi").isNotNull()).withColumn("pred", V.argmax_lowest(F.col("probs_loglin")))
    second = accuracy(pooled, by).select(*by, F.col("accuracy").alias("accuracy_loglin")).join(macro_f1(confusion(pooled, by), by, classes).withColumnRenamed("macro_f1", "macro_f1_loglin"), by)
    means = pooled.groupBy(*by).agg(F.avg("prob_std").alias("mean_prob_std"), F.avg("mi").alias("mean_mi"))
    return whole.join(second, by, "left").join(means, by, "left")
