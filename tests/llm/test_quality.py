"""Quality rules against plain Python: base counts, and the likelihood ratio with its two halves."""

import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from uqframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_text(t):
    return xxhash.xxh64_intdigest(t.encode(), seed=42)


def of_longs(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<Q", v & M), seed=h)
    return h


def base(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed


def grams(t, buckets):
    h = [of_text(x) for x in WORD.findall(t or "")]
    return [signed(x) % buckets for x in h] + [signed(of_longs(a, b)) % buckets for a, b in zip(h, h[1:])]


def scores(docs, trusted, buckets, smoothing):
    """Score of each document by the counts of the other half."""
    half = lambda k: signed(of_longs(k)) % 2
    out = []
    for k, t in docs:
        raw = Counter(b for j, u in docs if half(j) != half(k) for b in grams(u, buckets))
        target = Counter(b for j, u in docs if half(j) != half(k) and j in trusted for b in grams(u, buckets))
        n, m, own = sum(raw.values()), sum(target.values()), grams(t, buckets)
        if not own:
            out.append(None)
            continue
        s = smoothing * m / n if n else 0
        ratio = lambda b: 0.0 if not m else math.log((target[b] + s) / (m + s * buckets)) - math.log((raw[b] + smoothing) / (n + smoothing * buckets))  # noqa: B023, E731
        out.append(sum(map(ratio, own)) / len(own))
    return out


def texts(spark, sf_dir, n):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(n).collect()]


ODD = ["", None, " \t\n", "one", "a b c " * 40, "a a a a", "a b c a b c", "x\nx\n\n x\n", "# * $ |" * 20, "\xa0   é", "\x1c\x85", "w " * 3000, " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i % 40}" for i in range(80))]


def test_base_counts(spark, sf_dir):
    docs = [(-i - 1, t) for i, t in enumerate(ODD)] + texts(spark, sf_dir, 60)
    df = spark.createDataFrame([(*d, "x", 1.0, 7) for d in docs], "doc_id bigint, text string, trusted string, score double, __seen int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df, labels).collect()}
    assert got == {k: base(t) for k, t in docs}


def test_scores_and_verdicts(spark, sf_dir):
    docs = [*texts(spark, sf_dir, 50), (1000, ""), (1001, None)]
    trusted = {k for k, _ in docs if k % 3 == 0}
    labels = spark.createDataFrame([(k, int(k in trusted)) for k, _ in docs] + [(None, 1), (1, None), (3, 1)], "doc_id bigint, quality int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r for r in quality.judge(df, labels, buckets=512, smoothing=2.0).collect()}
    for (k, t), s in zip(docs, scores(docs, trusted, 512, 2.0)):
        assert rows[k].score == (None if s is None else pytest.approx(s, abs=1e-9))
        assert rows[k].kept == (not base(t)[5] and s is not None and rows[k].score >= quality.THRESHOLD)
    kept = sorted(r.doc_id for r in quality.keep(df, labels, buckets=512, smoothing=2.0).collect())
    assert kept == sorted(k for k, r in rows.items() if r.kept)


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.judge(none, labels).count() == 0 and quality.keep(none, labels).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    some = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")
    assert [r.kept for r in quality.judge(some, labels).collect()] == [True] * 3


def test_buckets_grow_with_the_text(spark):
    few, many = (spark.createDataFrame([("é" * n,)] * 4 + [(None,)], "text string") for n in (0, 20_000))
    assert quality.bucket_count(few) == quality.LEAST_BUCKETS
    assert quality.bucket_count(many) == quality.LEAST_BUCKETS + quality.BUCKETS_PER_ROOT * 400


def test_filter_of_trusted_keys_loses_none(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "trusted_key")
    passed = {r.id for r in spark.range(30000).where(quality.maybe_in(ids, "trusted_key", F.col("id"))).collect()}
    assert set(range(0, 3000, 3)) <= passed and len(passed) < 1000 + 0.1 * 29000
    nobody = ids.where("false")
    assert spark.range(100).where(quality.maybe_in(nobody, "trusted_key", F.col("id"))).count() == 0


def test_scores_with_several_chunks_of_weights(spark, sf_dir):
    docs = texts(spark, sf_dir, 20)
    labels = spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id bigint, quality int")
    buckets = 2 * quality.CHUNK + 7
    rows = {r.doc_id: r.score for r in quality.judge(spark.createDataFrame(docs, "doc_id bigint, text string"), labels, buckets=buckets).collect()}
    for (k, _), s in zip(docs, scores(docs, {k for k, _ in docs if k % 2}, buckets, quality.SMOOTHING)):
        assert rows[k] == (None if s is None else pytest.approx(s, abs=1e-9))
