"""Bottom-k sketches against plain Python."""

import base64
import hashlib
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from uqframe.llm import fingerprint as fp

M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shingles(text, width=5):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in low.split(" ") if w]
    out = set()
    for i in range(max(len(h) - width + 1, min(1, len(h)))):
        s = 42
        for x in h[i : i + width]:
            s = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=s)
        out.add(signed(s))
    return out


def sketch(text, k):
    return sorted(shingles(text))[:k]


def likeness(a, b, k):
    both = sorted(set(a) | set(b))[:k]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def printed(a):
    return base64.b64encode(b"".join(struct.pack(">Q", x & M) for x in a)).decode()


def want(rows, k):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (key, t) in enumerate(order):
        t, other = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + other[:half]
        a, b, c = sketch(t, k), sketch(e, k), sketch(other, k)
        out[key] = (len(t), hashlib.sha256(e.encode()).hexdigest(), printed(a), printed(b), pytest.approx(likeness(a, b, k)), pytest.approx(likeness(a, c, k)))
    return out


def compare(df, rows, k):
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.compare_edited(df, k=k).collect()}
    assert got == want(rows, k)


def test_query_equals_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    compare(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], fp.K)


def test_odd_texts(spark):
    rows = list(enumerate([None, "", " \n", "one", "ONE", "a b c d", "a b c d e", "a b c d e f " * 500, "🙂é " * 9, "\xa0 \x85", "x" * 60_000]))
    compare(spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id bigint, text string, r string, n int"), rows, 8)
    compare(spark.createDataFrame([(7, "a b c d e f g")], "doc_id bigint, text string"), [(7, "a b c d e f g")], 8)


def test_empty_and_repeated_rows(spark):
    assert fp.compare_edited(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(1, "a b c d e f")] * 3 + [(None, "g")] * 2
    assert len(fp.compare_edited(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == 5


def test_merge_containment_and_count(spark):
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [("k", text(0, 900)), ("k", text(850, 2000)), ("one", "x"), (None, ""), ("none", None)]
    df = spark.createDataFrame(rows, "key string, text string").withColumn("s", fp.sketch(F.col("text")))
    merged = {r.key: r.s for r in fp.merge_rows(df, "key", "s").collect()}
    assert merged["k"] == sorted(shingles(rows[0][1]) | shingles(rows[1][1]))[: fp.K]
    assert merged[None] == [] and merged["none"] == []
    both = spark.createDataFrame([(text(0, 1000), text(0, 4000))], "a string, b string")
    r = both.select(*[fp.sketch(F.col(c)).alias(c) for c in "ab"]).select(fp.containment(F.col("a"), F.col("b")).alias("c"), fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.distinct_shingles(F.col("b")).alias("n")).head()
    assert r.c == 1.0 and abs(r.r - 0.25) < 0.15 and abs(r.n / 3996 - 1) < 0.3
