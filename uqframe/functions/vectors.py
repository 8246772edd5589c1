"""Column helpers over class-probability vectors (array<double>); labels and predictions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities are clipped to [CLIP, 1] inside logarithms only.
CLIP = 1e-12
#: Norms are clipped to this, so a zero vector stays zero.
NORM_CLIP = 1e-9
BINS = 15


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def softmax(z: Column) -> Column:
    """Softmax with the largest logit taken off first."""
    exps = lambda y: let(F.array_max(y), lambda m: F.transform(y, lambda x: F.exp(x - m)))
    return let(let(z, exps), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def clip_probability(p: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(p, F.lit(CLIP)))


def entropy(p: Column) -> Column:
    """Shannon entropy in nats; 0 log 0 is 0."""
    return -total(F.transform(p, lambda x: x * F.ln(clip_probability(x))))


def argmax_lowest(p: Column) -> Column:
    """Index of the largest entry, the lowest of ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confidence(p: Column) -> Column:
    return F.array_max(p)


def brier(p: Column, label: Column) -> Column:
    """Sum of squared differences from the one-hot label, 0 to 2."""
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == label, 1.0).otherwise(0.0), F.lit(2.0))))


def nll(p: Column, label: Column) -> Column:
    return -F.ln(clip_probability(F.get(p, label.cast("int"))))


def apply_temperature(p: Column, t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return softmax(F.transform(p, lambda x: F.ln(clip_probability(x)) / t))


def l2_normalize(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    return let(d, lambda w: let(F.greatest(F.sqrt(total(F.transform(w, lambda x: x * x))), F.lit(NORM_CLIP)), lambda n: F.transform(w, lambda x: x / n)))


def fuse(*vectors: Column) -> Column:
    """Early fusion: each normalised, then joined and cast to float."""
    return F.concat(*[l2_normalize(v) for v in vectors]).cast("array<float>")


def bin_index(conf: Column, bins: int = BINS) -> Column:
    """Equal-width bins, closed on the right; 0 and less belong to bin 0. Edges are compared as they are, never rounded."""
    steps = [F.when(conf > F.lit(i / bins), 1).otherwise(0) for i in range(1, bins)]
    out = steps[0]
    for s in steps[1:]:
        out = out + s
    return out


def argmax_tie_ok(p: Column, pred: Column, tolerance: float = 1e-9) -> Column:
    return F.coalesce(F.get(p, pred.cast("int")) >= F.array_max(p) - tolerance, F.lit(False))


def finite(x: Column) -> Column:
    """``x`` with NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def same_bits(a: Column, b: Column) -> Column:
    """True for equal numbers of equal sign, so 0 and -0 differ; NaN equals NaN, whatever its bits; null equals null."""
    return a.eqNullSafe(b) & F.coalesce(F.when(a == 0, a.cast("string") == b.cast("string")), F.lit(True))  # zeros print their sign


def bits_that_differ(a: Column, b: Column) -> Column:
    """How many entries of two vectors aren't the same to the bit; entries that one of them lacks differ. Null without a vector."""
    longer, shorter = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: F.when(same_bits(x, y), 0).otherwise(1))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(pairs, F.lit(0), lambda s, x: s + x) + longer - shorter)
