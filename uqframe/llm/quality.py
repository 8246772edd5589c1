"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio against a trusted target.

Two multinomials over hash buckets describe word unigrams and bigrams: one of trusted documents, one of the raw corpus.
There are the more buckets the more text there is. A document's score is the mean over its n-grams of log p_target -
log p_raw; it is kept if the base rules pass and the score reaches a fixed threshold. The corpus is halved by key: each
half is scored by the other's counts. Only DataFrame functions are used. Texts are read where they stand, once for the
counts and once for the scores; only those that a bit filter takes for trusted are shuffled to their labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import WHITE, count_in, cut, full_lines, hashes, let, spare, words

SYMBOLS = "#*$%&|<>"
#: Buckets of both multinomials: so many, and BUCKETS_PER_ROOT times the square root of the corpus's bytes. The weights,
#: a double a bucket and half, are all that reaches the scoring tasks: 400 MB for 150 TB of text.
LEAST_BUCKETS = 1 << 16
BUCKETS_PER_ROOT = 2
#: Weights and filter bits are put in order in chunks of so many.
CHUNK = 4096
#: The filter of trusted keys has 16 bits a key, at most so many (32 MB); what it lets through is joined exactly.
MOST_FILTER_BITS = 1 << 28
#: Added to every bucket's count.
SMOOTHING = 32.0
#: Mean log-likelihood ratio from which a document is kept.
THRESHOLD = -0.1

_POSITION_BITS = 31
_POSITION = (1 << _POSITION_BITS) - 1


def _adjacent(a: Column, x: Column, i: Column, same) -> Column:
    """True where ``x``, entry i of the sorted array ``a``, has an equal neighbour, as ``same`` tells; null or false where not."""
    return same(x, F.get(a, i - 1)) | same(x, F.get(a, i + 1))


def repeated_words(ws: Column, h: Column, width: int = 3) -> Column:
    """How many words stand in a window of ``width`` words that occurs at least twice in ``ws``; ``h`` are the words' hashes.

    Windows are found by sorting 33 hash bits joined with the position, then compared as text, so the count is exact.
    """
    starts = F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0)))
    packed = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long")))
    alike = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), _POSITION_BITS) == 0
    candidates = let(F.sort_array(packed), lambda s: F.transform(F.filter(s, lambda x, i: _adjacent(s, x, i, alike)), lambda x: x.bitwiseAND(F.lit(_POSITION)).cast("int")))

    def confirmed(at: Column) -> Column:
        windows = F.sort_array(F.transform(at, lambda p: F.struct(F.concat_ws(" ", *[F.get(ws, p + k) for k in range(width)]).alias("w"), p.alias("p"))))
        return let(windows, lambda s: F.transform(F.filter(s, lambda x, i: _adjacent(s, x, i, lambda a, b: a["w"] == b["w"])), lambda x: x["p"]))

    covered = F.aggregate(
        F.sort_array(let(candidates, confirmed)),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return F.when(F.size(ws) < width, F.lit(0).cast("long")).otherwise(covered)


def base_columns(text: Column) -> dict[str, Column]:
    """The counts of one text as columns; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return {
        "word_chars": (F.length(t) - count_in(t, WHITE)).cast("long"),
        "n_symbols": count_in(t, SYMBOLS).cast("long"),
        "n_dup_lines": let(full_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _by_ngram(h: Column, buckets: int, of_bucket) -> tuple[Column, Column]:
    """``of_bucket(bucket)`` for each word, and for each pair of neighbouring words, of the words' hashes ``h``."""
    bucket = lambda x: of_bucket(F.pmod(x, F.lit(buckets)).cast("int"))
    pairs = F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0)))
    return F.transform(h, lambda x: bucket(x)), F.transform(pairs, lambda x, i: bucket(F.xxhash64(x, F.get(h, i + 1))))


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """How many buckets the counts of ``docs`` get: they grow with the square root of its bytes."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).head()[0] or 0
    return LEAST_BUCKETS + BUCKETS_PER_ROOT * math.isqrt(size)


def ngram_buckets(ws: Column, buckets: int) -> Column:
    """Bucket of each word and of each pair of neighbouring words."""
    return let(hashes(ws), lambda h: F.concat(*_by_ngram(h, buckets, lambda b: b)))


def trusted_ids(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Keys whose every label row says 1; null keys and null labels trust nothing."""
    own = labels.select(F.col(key).alias("trusted_key"), F.coalesce(F.col(label), F.lit(0)).alias("trusted_label"))
    return own.where(F.col("trusted_key").isNotNull()).groupBy("trusted_key").agg(F.min("trusted_label").alias("m")).where("m = 1").select("trusted_key")


def fold(key: Column) -> Column:
    """0 or 1 by the key's hash: a document is scored by what the other half of the corpus says."""
    return F.pmod(F.xxhash64(key), F.lit(2)).cast("int")


def _dense(cells: DataFrame, by: list[str]) -> DataFrame:
    """For each ``by``, the values ``v`` of ``cells`` (by, i, v), i from 0 without gaps, as an array; sorted in chunks."""
    parts = cells.groupBy(*by, F.floor(F.col("i") / CHUNK).alias("c")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("own"))
    return parts.groupBy(*by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("c", "own"))), lambda x: x["own"])).alias("v"))


def maybe_in(ids: DataFrame, name: str, key: Column) -> Column:
    """True for every ``key`` that is in ``ids`` and for about one in 16 that isn't."""
    bits = min(MOST_FILTER_BITS, max(64, 16 * ids.count()))
    cells = -(-bits // 32)
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    bit = lambda k: F.pow(F.lit(2.0), F.pmod(slot(k), F.lit(32))).cast("long")
    place = lambda k: F.floor(slot(k) / 32).cast("long")
    used = ids.groupBy(place(F.col(name)).alias("i")).agg(F.bit_or(bit(F.col(name))).alias("own"))
    every = ids.sparkSession.range(cells).withColumnRenamed("id", "i").join(used, "i", "left").select("i", F.coalesce("own", F.lit(0).cast("long")).alias("v"))
    return F.get(_dense(every, []).scalar(), place(key).cast("int")).bitwiseAND(bit(key)) != 0


def count_ngrams(docs: DataFrame, labels: DataFrame, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """serves, i, raw, target: n-grams of each bucket i in all and in trusted documents, of the half that scores half ``serves``."""
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    trusted = trusted_ids(labels, key)
    # the same plan at every size: labels grow with the corpus, so they are never broadcast
    believed = own.where(maybe_in(trusted, "trusted_key", F.col("k"))).join(trusted.hint("merge"), F.col("k") == F.col("trusted_key"))

    def counted(df: DataFrame, raw: int) -> DataFrame:
        seen = df.select((1 - fold(F.col("k"))).alias("serves"), F.explode(ngram_buckets(words(F.col("t")), buckets)).alias("i"))
        return seen.groupBy("serves", "i").agg(F.count(F.lit(1)).alias("n")).select("serves", "i", (F.col("n") * raw).alias("raw"), (F.col("n") * (1 - raw)).alias("target"))

    return counted(own, 1).union(counted(believed, 0)).groupBy("serves", "i").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int, key: str = "doc_id", text: str = "text", smoothing: float = SMOOTHING) -> DataFrame:
    """One row, one column ``weights``: for fold 0 and fold 1 the log ratio of each bucket in the other fold.

    So no document tells on itself, labelled or not. All documents count for the raw corpus. The target's smoothing is
    the raw corpus's in proportion to its size, so a bucket without counts weighs 0. Without a trusted document in a
    half, or without any document, its weights are 0.
    """
    counts = cut(count_ngrams(docs, labels, buckets, key, text), "quality-counts")
    totals = counts.groupBy("serves").agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))  # two rows
    every = docs.sparkSession.range(2 * buckets).select(F.floor(F.col("id") / buckets).cast("int").alias("serves"), (F.col("id") % buckets).cast("int").alias("i"))
    listed = every.join(counts, ["serves", "i"], "left").na.fill(0, ["raw", "target"]).join(F.broadcast(totals), "serves", "left")
    part = F.col("n_target") / F.col("n_raw")
    log_share = lambda c, n, a: F.log((c + a) / (n + a * buckets))
    ratio = log_share(F.col("target"), F.col("n_target"), smoothing * part) - log_share(F.col("raw"), F.col("n_raw"), F.lit(smoothing))
    cells = listed.select("serves", "i", F.when(F.col("n_target") > 0, ratio).otherwise(0.0).alias("v"))
    return _dense(cells, ["serves"]).agg(F.transform(F.sort_array(F.collect_list(F.struct("serves", "v"))), lambda x: x["v"]).alias("weights"))


def score(h: Column, weights: Column, buckets: int) -> Column:
    """Mean weight of the n-grams of words with the hashes ``h``; null without words. ``weights`` is one fold's array."""
    total = [F.aggregate(x, F.lit(0.0), lambda s, w: s + w) for x in _by_ngram(h, buckets, lambda b: F.get(weights, b))]
    return (total[0] + total[1]) / F.nullif(2 * F.size(h) - 1, F.lit(-1))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """Per row of ``docs``: key, the base counts, base_failed, score and kept.

    A text without words (null and empty too) has score null and fails the base rules. Rows with a repeated or null
    key are judged each; tied scores share the verdict, since only the fixed threshold decides.
    """
    buckets = buckets or bucket_count(docs, text)
    weights = fit(docs, labels, buckets, key, text, smoothing).scalar()
    own = docs.select(F.col(key), F.col(text).alias("__text"))
    # named once, the weights stay part of the expression; as a column they would be copied into every row
    seen = let(F.col("__w"), lambda w: let(words(F.col("__text")), lambda ws: let(hashes(ws), lambda h: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        repeated_words(ws, h).alias("n_repeat_words"),
        score(h, w, buckets).alias("score"),
    ))))
    judged = own.withColumn("__w", F.get(weights, fold(F.col(key)))).select(key, *[c.alias(n) for n, c in base_columns(F.col("__text")).items()], seen.alias("__seen"))
    judged = judged.select(key, "__seen.n_words", "word_chars", "n_symbols", "n_dup_lines", "__seen.n_repeat_words", "__seen.score")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return judged.withColumns({"base_failed": failed, "kept": ~failed & F.coalesce(F.col("score") >= threshold, F.lit(False))})


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns as they were, whatever their names; rows are filtered where they are read."""
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    threshold, buckets = options.get("threshold", THRESHOLD), options.get("buckets") or bucket_count(docs, text)
    weights = fit(docs, labels, buckets, key, text, options.get("smoothing", SMOOTHING)).scalar()
    (held,) = spare(docs, "__w")
    verdict = let(F.col(held), lambda w: let(words(F.col(text)), lambda ws: let(hashes(ws), lambda h: ~base_failed(F.size(ws), repeated_words(ws, h)) & F.coalesce(score(h, w, buckets) >= threshold, F.lit(False)))))
    return docs.withColumn(held, F.get(weights, fold(F.col(key)))).where(verdict).select(*docs.columns)
