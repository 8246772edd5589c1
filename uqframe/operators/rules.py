"""Decision tables over analysis results: claim verdicts, significance, confidence direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.functions import text as X
from uqframe.operators.resample import excludes_zero, overlap

ALPHA = 0.05
#: Disagreements that claim C6 expects.
EXPECTED_DISAGREEMENTS = 130


def lower_accuracy(delta: Column, p: Column) -> Column:
    """C1: averaging lowers accuracy at fixed trees."""
    return F.when((delta < 0) & (p < ALPHA), "SUPPORTED").when(delta < 0, "QUALIFIED").otherwise("CONTRADICTED")


def within_variance(p: Column, lo: Column, hi: Column) -> Column:
    """C2: a difference cannot be told from sampling variance."""
    return F.when((p < ALPHA) | excludes_zero(lo, hi), "CONTRADICTED").otherwise("SUPPORTED")


def indistinguishable(p_holm: Column, lo: Column, hi: Column) -> Column:
    """C3: two systems cannot be told apart."""
    same, holds = p_holm >= ALPHA, ~excludes_zero(lo, hi)
    return F.when(same & holds, "SUPPORTED").when(~same & ~holds, "CONTRADICTED").otherwise("QUALIFIED")


def signal_value(auroc_5: Column, lo_5: Column, hi_5: Column, auroc_1: Column, lo_1: Column, hi_1: Column) -> Column:
    """C4: the value lies in the uncertainty signal."""
    worse = ~overlap(lo_5, hi_5, lo_1, hi_1) & (auroc_5 < auroc_1)
    return F.when(lo_5 <= 0.5, "CONTRADICTED").when(worse, "QUALIFIED").otherwise("SUPPORTED")


def reproduced(rows: DataFrame) -> Column:
    """C5 as an aggregate over (by_manifest, by_computed), both nullable."""
    m, c = F.col("by_manifest"), F.col("by_computed")
    flagged = F.count_if(m.isNotNull() | c.isNotNull())
    fails = F.count_if(F.coalesce(~m, F.lit(False)) | F.coalesce(~c, F.lit(False)))
    return F.when(fails > 0, "CONTRADICTED").when((F.count_if(m != c) > 0) | (flagged == 0), "QUALIFIED").otherwise("SUPPORTED")


def disagreements(n: Column) -> Column:
    """C6."""
    return F.when(n == EXPECTED_DISAGREEMENTS, "SUPPORTED").otherwise("CONTRADICTED")


def significance(p: Column, p_holm: Column) -> Column:
    return F.when((p < ALPHA) & (p_holm < ALPHA), "significant").when(p < ALPHA, "nominal only").otherwise("not significant")


def confidence_state(conf: Column, acc: Column) -> Column:
    """over, under or matched, as four printed decimals tell."""
    gap = F.round(conf, 4) - F.round(acc, 4)
    return F.when(X.fixed(F.abs(gap) * 100.0, 2) == "0.00", "matched").when(gap > 0, "over").otherwise("under")


def direction(lo: Column, hi: Column) -> Column:
    """What an interval of a difference says of it."""
    return F.when(lo > 0, "higher").when(hi < 0, "lower").otherwise("unchanged")


def signal_sign(overlap: Column, less: Column, excludes_zero: Column, delta: Column) -> Column:
    """-1, 0 or 1: how one signal compares with another. Intervals that overlap don't show that two signals are equal, so
    then the paired difference decides; 0 if that can't be told from none."""
    of = lambda below: F.when(below, -1).otherwise(1)
    return F.when(~overlap, of(less)).when(excludes_zero, of(delta < 0)).otherwise(0)


def calibration_change(ece: Column, lo: Column, hi: Column, base: Column, base_lo: Column, base_hi: Column) -> Column:
    """unchanged where the intervals overlap, else improved or worsened."""
    return F.when(overlap(lo, hi, base_lo, base_hi), "unchanged").when(ece < base, "improved").otherwise("worsened")


def deferral_effect(accepted: Column, whole: Column) -> Column:
    """What deferring does to the accuracy of what is kept: leaves it where both print the same, else raises or lowers it."""
    order = X.compare_formatted(accepted, whole, X.fmt_metric(accepted), X.fmt_metric(whole))
    return F.when(order == 0, "leaves").when(order > 0, "raises").otherwise("lowers")


def coverage_state(coverage: Column) -> Column:
    """Where a target accuracy is held: at no coverage, at full coverage, or up to some coverage."""
    return F.when(coverage <= 0, "none").when(coverage >= 1, "full").otherwise("partial")


def chance_state(lo: Column, hi: Column) -> Column:
    """An AUROC's interval against chance."""
    return F.when(hi < 0.5, "below").when(lo > 0.5, "above").otherwise("includes")
