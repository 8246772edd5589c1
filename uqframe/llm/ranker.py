"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document's strength is a weighted sum of text features. In a preference pair a document of label 1 beats one of label
0; the weights minimise the logistic loss of the pairs' feature differences (no intercept, ridge, Newton steps). The
threshold is a quantile of the strengths: that of the share of label 0. The score is the logistic of the strength,
moved so that the quantile has the score ``CUT``. Features are DataFrame expressions, computed where a text is read;
weights and threshold are learned from every labelled row that isn't held out, and every document is scored. Pairs are
joined in Spark and packed as matrices of PAIR_BLOCK differences; a Newton step is a sum over these blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import UPPER, count_in, count_of, cut, discard, full_lines, hashes, let, shuffle_partitions, words
from uqframe.llm.quality import maybe_in
from uqframe.operators.ranking import running

#: Pairs, or labelled rows, of a block whose sums a task takes at once; blocks whose sums are added before the driver gets them.
PAIR_BLOCK, BLOCKS_MERGED = 4_096, 256
#: Rows of the smaller class up to which every task has them all: so few would be the keys of too many pairs.
FEW_ROWS = 4_096
#: Pairs for each row of the larger class.
PAIRS = 6
RIDGE = 1e-3
#: The score at the quantile threshold.
CUT = 0.7
FOLDS, HELD_OUT = 4, 2

FEATURES = (
    "words", "word_length", "hash_mark", "star", "dollar", "percent", "ampersand", "bar", "angle", "exclaim", "question",
    "upper", "digit", "stop", "comma", "other_mark", "line", "repeated_line", "repeated_window", "repeated_word", "long_word",
)


def _windows(h: Column) -> Column:
    """Hashes of all windows of three words."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))


def features(text: Column) -> Column:
    """array<double> of FEATURES; rates are by word or character, on a log scale where a few matter. Empty texts: zeros."""
    t = F.coalesce(text, F.lit(""))
    one = lambda c: count_of(t, c)

    def of(ws: Column, h: Column, squeezed: Column, lines: Column) -> Column:
        n = F.greatest(F.size(ws), F.lit(1)).cast("double")
        chars = F.greatest(squeezed, F.lit(1)).cast("double")
        rate = lambda x, by, k=20.0: F.log1p(k * x.cast("double") / by)
        return F.array(
            F.log1p(F.size(ws).cast("double")),
            squeezed / n,
            *[rate(c, n) for c in (one("#"), one("*"), one("$"), one("%"), one("&"), one("|"), one("<") + one(">"), one("!"), one("?"))],
            rate(count_in(t, UPPER), chars),
            rate(count_in(t, "0123456789"), chars),
            rate(one("."), n, 5.0),
            rate(one(","), n, 5.0),
            rate(count_in(t, "@=_/\\^~`{}[]+;:\"'()-"), n),
            rate(F.size(lines), n, 5.0),
            (F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.size(lines), F.lit(1)),
            *[let(x, lambda a: 1 - F.size(F.array_distinct(a)) / F.greatest(F.size(a), F.lit(1))) for x in (_windows(h), h)],
            F.size(F.filter(ws, lambda w: F.length(w) > 20)) / n,
        )

    return let(words(t), lambda ws: let(hashes(ws), lambda h: let(F.length(F.array_join(ws, "")), lambda size: let(full_lines(t), lambda lines: of(ws, h, size, lines)))))


def held_out(key: Column) -> Column:
    """Rows that learning never sees: crc32 of the key as text, modulo FOLDS, is HELD_OUT. A null key counts as empty."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS) == HELD_OUT


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def total(self, features_: Column, shift: float) -> Column:
        """The strength as a column, its constant part replaced by ``shift``."""
        weights = F.array(*[F.lit(float(x)) for x in self.weights / self.scale])
        return F.aggregate(F.zip_with(features_, weights, lambda a, b: a * b), F.lit(shift), lambda s, x: s + x)

    def score(self, features_: Column) -> Column:
        """The logistic of strength - threshold, CUT at the threshold."""
        shift = float(np.log(CUT / (1 - CUT)) - self.threshold - self.weights / self.scale @ self.mean)
        return 1 / (1 + F.exp(-self.total(features_, shift)))


def learn(x: np.ndarray, y: np.ndarray) -> Ranker:
    """Bradley-Terry fit to feature rows in a fixed order. With only one class all strengths are 0 and the score is CUT for label 1, less for 0."""
    d = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0 if len(good) or not len(bad) else 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    n = max(len(good), len(bad))
    i = np.arange(n)
    diff = np.concatenate([z[good[i % len(good)]] - z[bad[(i * (2 * p + 1) + p * 7919) % len(bad)]] for p in range(PAIRS)])

    def slopes(w: np.ndarray) -> np.ndarray:
        return _slopes(diff, w)

    w = _newton(d, len(diff), slopes)
    own = np.sort(z @ w)
    rank = len(bad)  # the quantile at the share of label 0, between the two strengths around it
    return Ranker(mean, scale, w, float((own[rank - 1] + own[min(rank, len(own) - 1)]) / 2))


def _slopes(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the pairs' loss, flat and summed over the pairs."""
    p = 1 / (1 + np.exp(np.clip(diff @ w, -35, 35)))  # chance that the pair goes the wrong way
    return np.r_[-diff.T @ p, ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()]


def _newton(d: int, pairs: int, slopes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights of least loss; ``slopes`` gives the sums of ``_slopes`` over all pairs."""
    w = np.zeros(d)
    for _ in range(30):
        both = slopes(w) / pairs
        step = np.linalg.solve(both[d:].reshape(d, d) + RIDGE * np.eye(d), RIDGE * w + both[:d])
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of ``parts`` (block, sums): always in the order of the blocks, so equal input gives equal bits. One row of BLOCKS_MERGED reaches the driver."""

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "sums": [np.stack(frame.sort_values("block")["sums"]).sum(axis=0)]})

    merged = parts.groupBy(F.expr(f"block div {BLOCKS_MERGED}")).applyInPandas(add, "block bigint, sums array<double>")
    return np.sum([r["sums"] for r in sorted(merged.collect(), key=lambda r: r["block"])], axis=0)


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, th (the text's hash), x (its features) of every row, computed where the text is read, so no text is ever shuffled; kept as a table."""
    return cut(docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), features(F.col(text)).alias("x")), "ranker-rows")


def _placed(rows: DataFrame, sure: DataFrame) -> DataFrame:
    """y, pos (from 0 within the label, by the key's hash), x: the features of every labelled one of ``rows``, kept as a table."""
    own = rows.join(sure, "k").select("k", "y", F.xxhash64("k").alias("h"), "th", "x")
    return cut(running(own, ["y"], ["h", "k", "th"], {"pos": F.lit(1)}).select("y", (F.col("pos") - 1).alias("pos"), "x"), "ranker-placed")


def _moments(placed: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each feature, centred before squaring."""
    blocks = placed.withColumn("block", F.expr(f"2 * (pos div {PAIR_BLOCK}) + y"))

    def total(shift: np.ndarray, power: int) -> np.ndarray:
        def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": [key[0]], "sums": [((np.stack(frame.sort_values("pos")["x"]) - shift) ** power).sum(axis=0)]})

        return _added(blocks.groupBy("block").applyInPandas(one, "block bigint, sums array<double>")) / n

    mean = total(np.zeros(len(FEATURES)), 1)
    return mean, np.sqrt(total(mean, 2))


def _packed_pairs(placed: DataFrame, good: int, bad: int, scale: np.ndarray) -> DataFrame:
    """block, d: the feature differences of PAIR_BLOCK pairs each, as bytes of a matrix of doubles; the pairs of ``learn``."""
    n, spark = max(good, bad), placed.sparkSession
    i, p = F.col("id") % n, F.expr(f"id div {n}")
    pairs = spark.range(n * PAIRS).select("id", (i % good).alias("g"), ((i * (2 * p + 1) + p * 7919) % bad).alias("b"))
    few = lambda df, rows: F.broadcast(df) if rows <= FEW_ROWS else df.hint("merge")
    better = placed.where("y = 1").select(F.col("pos").alias("g"), F.col("x").alias("xg"))
    worse = placed.where("y = 0").select(F.col("pos").alias("b"), F.col("x").alias("xb"))
    both = pairs.join(few(better, good), "g").join(few(worse, bad), "b")
    both = both.select(F.expr(f"id div {PAIR_BLOCK}").alias("block"), "id", F.zip_with("xg", "xb", lambda a, b: a - b).alias("x"))  # half as wide to shuffle

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        return pd.DataFrame({"block": [key[0]], "d": [(np.stack(frame["x"]) / scale).tobytes()]})

    tasks = max(shuffle_partitions(spark), n * PAIRS // (16 * PAIR_BLOCK))  # some 10 MB of blocks each
    return cut(both.repartition(tasks, "block").groupBy("block").applyInPandas(pack, "block bigint, d binary"), "ranker-pairs")


def _cut_strength(strength: DataFrame, rank: int, n: int) -> float:
    """The mean of the values ``s`` of rank ``rank`` and the next, from 0: exact, from a narrow range around them."""
    room = 2e-5
    while True:
        ends = [max(0.0, (rank - 1) / n - room), min(1.0, (rank + 2) / n + room)]
        lo, hi = strength.agg(F.percentile_approx("s", ends, 100_000)).head()[0]
        below = strength.where(F.col("s") < lo).count()
        inside = strength.where(F.col("s").between(lo, hi)).groupBy("s").count().orderBy("s").collect()
        upto = below + np.cumsum([r["count"] for r in inside])
        if below <= rank and (upto[-1] > min(rank + 1, n - 1)):
            at = [inside[int(np.searchsorted(upto, k, "right"))]["s"] for k in (rank, min(rank + 1, n - 1))]
            return float(sum(at) / 2)
        room *= 4


def _labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """k, y of all keys that learning may use: not null, not held out, of one label."""
    own = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    return own.groupBy("k").agg(F.min("y").cast("int").alias("y"), F.max("y").alias("z")).where("y = z").select("k", "y")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Ranker:
    """Learn from all labelled documents that aren't held out; null keys and labels teach nothing.

    Labels that contradict each other for one key teach nothing either. Gives what ``learn`` gives for the same rows, in
    the order of the keys' hashes, but rows and pairs stay in tables: sums of blocks alone reach the driver.
    """
    sure = _labelled(labels, key, label)
    if docs.schema[key].dataType == labels.schema[key].dataType:
        docs = docs.where(maybe_in(sure, "k", F.col(key)))  # the others' features needn't be computed
    rows = _read(docs, key, text)
    found = _fit(rows, sure)
    discard(rows)
    return found


def _fit(rows: DataFrame, sure: DataFrame) -> Ranker:
    placed = _placed(rows, sure)
    sizes = {r["y"]: r["count"] for r in placed.groupBy("y").count().collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    if not good or not bad:
        discard(placed)
        return learn(np.zeros((len(sizes), len(FEATURES))), np.array(list(sizes)))
    mean, scale = _moments(placed, good + bad)
    scale[scale < 1e-9] = 1.0
    d, blocks = len(FEATURES), _packed_pairs(placed, good, bad, scale)

    def slopes(w: np.ndarray) -> np.ndarray:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"block": frame["block"], "sums": [_slopes(np.frombuffer(x).reshape(-1, d), w) for x in frame["d"]]})

        return _added(blocks.mapInPandas(run, "block bigint, sums array<double>"))

    w = _newton(d, max(good, bad) * PAIRS, slopes)
    found = Ranker(mean, scale, w, 0.0)
    found.threshold = _cut_strength(placed.select(found.total(F.col("x"), -float(w / scale @ mean)).alias("s")), bad - 1, good + bad)
    discard(placed, blocks)
    return found


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Per row: key, held_out, score, predicted (1 from CUT on). Null texts are empty ones; repeated rows are scored each."""
    rows = _read(docs, key, text)  # features serve learning and scores alike
    scored = rows.select("k", _fit(rows, _labelled(labels, key, label)).score(F.col("x")).alias("score"))
    return scored.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that score at least CUT, all their columns as they were.

    ``learn_from`` has the labelled documents to learn from, where ``docs`` lost some of them in an earlier filter.
    """
    ranker = fit(docs if learn_from is None else learn_from, labels, key, text, label)
    return docs.where(ranker.score(features(F.col(text))) >= CUT)
