"""Pooling of ensemble members and the split of uncertainty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from uqframe.functions import vectors as V


def _mean_by_class(rows: Column) -> Column:
    """Mean over members of each class."""
    width = F.sequence(F.lit(0), F.size(F.get(rows, 0)) - 1)
    return F.transform(width, lambda k: V.total(F.transform(rows, lambda r: F.get(r, k))) / F.size(rows))


def pool(members: Column) -> Column:
    """Struct of one sample's members (array of logit arrays).

    probs: linear mean of the softmaxes. loglin: softmax of the mean logits. pred_entropy of the mean, exp_entropy as
    the members' mean, mi their difference floored at 0, prob_std the population deviation averaged over classes.
    """

    def of(z: Column, p: Column) -> Column:
        def with_mean(q: Column) -> Column:
            expected = V.total(F.transform(p, lambda x: V.entropy(x))) / F.size(p)
            deviation = F.transform(q, lambda m, k: F.sqrt(V.total(F.transform(p, lambda r: F.pow(F.get(r, k) - m, F.lit(2.0)))) / F.size(p)))
            return V.let(F.struct(V.entropy(q).alias("h"), expected.alias("e")), lambda s: F.struct(
                q.alias("probs"),
                F.greatest(F.lit(0.0), s["h"] - s["e"]).alias("mi"),
                s["h"].alias("pred_entropy"),
                s["e"].alias("exp_entropy"),
                (V.total(deviation) / F.size(q)).alias("prob_std"),
                V.softmax(_mean_by_class(z)).alias("loglin"),
            ))

        return V.let(_mean_by_class(p), with_mean)

    return V.let(members, lambda z: V.let(F.transform(z, lambda x: V.softmax(x)), lambda p: of(z, p)))


def unpooled(probs: Column) -> Column:
    """The same struct for a single model: no uncertainty terms."""
    none = F.lit(None).cast("double")
    return F.struct(probs.alias("probs"), *[none.alias(n) for n in ("mi", "pred_entropy", "exp_entropy", "prob_std")], F.lit(None).cast("array<double>").alias("loglin"))
