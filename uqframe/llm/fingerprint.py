"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k least distinct 64-bit hashes of a text's word shingles, as an ascending array. Sketches of parts
merge into the sketch of the whole. Two sketches estimate resemblance and containment, one the number of distinct
shingles. Only DataFrame functions are used; a sketch is computed where its text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.llm.common import ascii_lower, hashes, let, shuffle_partitions, words

#: Words in a shingle; a shorter text is one shingle, a text without words has none.
WIDTH = 5
#: Hashes in a sketch; resemblance has a standard error of at most 0.5 / sqrt(k).
K = 128

#: Ranges of keys at most; one bound of each reaches every task.
MOST_RANGES = 1 << 16

_SPAN = float(1 << 64)


def sketch(text: Column, width: int = WIDTH, k: int = K) -> Column:
    """Ascending array of at most ``k`` distinct hashes; null and texts without words give an empty array."""

    def of(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.least(F.size(h), F.lit(1))))
        whole = F.transform(starts, lambda x, i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.slice(F.array_sort(F.array_distinct(whole)), 1, k)

    return let(hashes(words(ascii_lower(text))), of)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_rows(df: DataFrame, key: str, sketch_column: str, k: int = K, salts: int = 64) -> DataFrame:
    """One merged sketch per key. Hot keys are first merged in ``salts`` parts, so no task gathers more than its share.

    A null key is a group of its own; null sketches add nothing.
    """
    gathered = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k)
    parts = df.select(F.col(key), F.col(sketch_column).alias("s"), F.pmod(F.xxhash64(sketch_column), F.lit(salts)).alias("salt")).groupBy(key, "salt").agg(gathered("s").alias("s"))
    return parts.groupBy(key).agg(gathered("s").alias(sketch_column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k least hashes of the union that both have; 1 if both are empty."""
    both = merge(a, b, k)
    return let(both, lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: among a's hashes below b's bound; 1 for an empty a."""
    bound = F.when(F.size(b) < k, F.lit((1 << 63) - 1)).otherwise(F.array_max(b))
    return F.when(F.size(a) == 0, 1.0).otherwise(let(F.filter(a, lambda x: x <= bound), lambda s: F.coalesce(F.size(F.array_intersect(s, b)) / F.nullif(F.size(s), F.lit(0)), F.lit(0.0))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.array_max(a).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def as_string(a: Column) -> Column:
    """Base64 of the hashes' 8 bytes each, in order, without line breaks."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), "\r\n", "")


def with_next(df: DataFrame, key: str, text: str, derive, per_partition: int = 8) -> DataFrame:
    """key, text, ``next_text``, ``own`` and ``next_own``: each row with the row that follows by descending key.

    ``derive(text)`` makes ``own`` of a text, after the shuffle. The first row follows the last. Keys are integers.

    Ties stand in the order of their text; a null key comes last. Keys are cut into ranges at their quantiles, a window runs in
    each range, and the first row of the next range joins each range as a row that is dropped again. So one shuffle
    moves each text once, and no task holds more than a range. What is broadcast has one row a range.
    """
    spark = df.sparkSession
    n = min(per_partition * shuffle_partitions(spark), MOST_RANGES)
    own = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rank = F.coalesce(F.col("k"), F.lit(-(1 << 63)))
    bounds = own.agg(F.array_distinct(F.percentile_approx(rank, [i / n for i in range(1, n)], 10 * n)).alias("b")).scalar()
    # the number of the range: bounds are ascending, found by halving
    ranged = own.withColumn("__b", bounds).withColumn("r", _range_of(rank, F.coalesce(F.col("__b"), F.array().cast("array<bigint>")), n)).drop("__b")
    heads = ranged.groupBy("r").agg(F.max(rank).alias("head"))
    order = Window.orderBy(F.desc("r"))
    firsts = heads.select(F.col("head"), F.coalesce(F.lag("r").over(order), F.min("r").over(Window.partitionBy())).alias("to"))
    ghosts = ranged.join(F.broadcast(firsts), rank == F.col("head")).select("k", "t", F.col("to").alias("r"), F.lit(1).alias("ghost"))
    rows = ranged.select("k", "t", "r", F.lit(0).alias("ghost")).unionByName(ghosts)
    w = Window.partitionBy("r").orderBy("ghost", F.desc_nulls_last("k"), "t")
    both = rows.withColumn("n", F.lead("t").over(w)).withColumn("own", derive(F.col("t"))).withColumn("next_own", F.lead("own").over(w))
    return both.where("ghost = 0").select(F.col("k").alias(key), F.col("t").alias("text"), F.col("n").alias("next_text"), "own", "next_own")


def _range_of(value: Column, bounds: Column, n: int) -> Column:
    """How many of the ascending ``bounds`` are below ``value``."""
    steps = n.bit_length() + 1
    span = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & F.coalesce(F.get(bounds, mid) < value, F.lit(False))
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span, halve, lambda s: s["lo"])


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``other``, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(other, F.lit(1), half))


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and the likeness to that and to the next document.

    Null texts count as empty. Repeated rows are judged each; equal texts have equal fingerprints. A single row is
    its own next document.
    """
    rows = with_next(df, key, text, lambda t: sketch(t, k=k))
    made = let(edited(F.col("text"), F.col("next_text")), lambda e: F.struct(
        F.sha2(e, 256).alias("edited_sha256"),
        let(sketch(e, k=k), lambda s: F.struct(as_string(s).alias("edited_fingerprint"), resemblance(F.col("own"), s, k).alias("near_edited"))).alias("s"),
    ))
    out = rows.select(key, F.length("text").cast("long").alias("n_chars"), as_string(F.col("own")).alias("fingerprint"), made.alias("e"), resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"), distinct_shingles(F.col("own"), k).alias("n_shingles"))
    return out.select(key, "n_chars", "e.edited_sha256", "fingerprint", "e.s.edited_fingerprint", "e.s.near_edited", "near_next", "n_shingles")
