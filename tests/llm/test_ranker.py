"""The pairwise ranker: held-out accuracy, what it may learn from, edge cases."""

import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from uqframe.llm import ranker


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = ranker.judge(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == r.quality for r in held) / len(held)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert right >= 0.9 and auc >= 0.95, (right, auc)


def test_held_out_labels_teach_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(ranker.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ranker.fit(docs, labels), ranker.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_the_fit_minimises_the_pairs_loss():
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.4).astype(int)
    x = rng.normal(size=(300, 4)) + y[:, None] * np.array([1.5, 0, -1, 0])
    r = ranker.learn(x, y)
    assert r.weights[0] > 0.5 and r.weights[2] < -0.3
    share = (r.strength(x) < r.threshold).mean()
    assert abs(share - (y == 0).mean()) < 0.01  # the threshold is the quantile of label 0's share


def test_one_class_no_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (3, ""), (4, "x" * 100_000)], "doc_id bigint, text string").withColumns({"k": F.lit(1), "score": F.lit("s"), "x": F.lit(2)})
    for rows in ([], [(1, 1)], [(1, 0)], [(1, 0), (1, 1)], [(None, 1), (1, None), (3, 7)]):
        got = ranker.judge(docs, spark.createDataFrame(rows, "doc_id bigint, quality int")).collect()
        assert len(got) == 5 and all(r.score is not None and r.held_out is not None for r in got)
    assert ranker.judge(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0
    assert ranker.keep(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).columns == docs.columns


def plain_features(text):
    """The features by their definition, in plain Python."""
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars = max(len(ws), 1), max(sum(map(len, ws)), 1)
    count = lambda cs: sum(c in cs for c in t)
    rate = lambda x, by, k=20.0: math.log1p(k * x / by)
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = list(zip(ws, ws[1:], ws[2:]))
    unlike = lambda xs: 1 - len(set(xs)) / max(len(xs), 1)
    return [
        math.log1p(len(ws)), sum(map(len, ws)) / n,
        *[rate(count(c), n) for c in ("#", "*", "$", "%", "&", "|", "<>", "!", "?")],
        rate(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars), rate(count("0123456789"), chars), rate(count("."), n, 5.0), rate(count(","), n, 5.0),
        rate(count("@=_/\\^~`{}[]+;:\"'()-"), n), rate(len(lines), n, 5.0), (len(lines) - len(set(lines))) / max(len(lines), 1),
        unlike(windows), unlike(ws), sum(len(w) > 20 for w in ws) / n,
    ]


def test_scores_equal_a_plain_fit_of_the_same_pairs(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = {k: plain_features(t) for k, t in texts.items()}
    assert all(np.allclose(r.x, x[r.doc_id], rtol=1e-9, atol=1e-12) for r in docs.select("doc_id", ranker.features(F.col("text")).alias("x")).collect())

    own = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    own.sort(key=lambda r: order[r[0]])
    rows = np.array([x[k] for k, _ in own])
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-9] = 1
    z = {k: (np.array(x[k]) - mean) / scale for k in x}
    good, bad = [k for k, y in own if y == 1], [k for k, y in own if y == 0]
    n = max(len(good), len(bad))
    pairs = [(good[i % len(good)], bad[(i * (2 * p + 1) + p * 7919) % len(bad)]) for p in range(ranker.PAIRS) for i in range(n)]
    loss = lambda w: sum(math.log1p(math.exp(-(z[a] - z[b]) @ w)) for a, b in pairs) / len(pairs) + ranker.RIDGE / 2 * w @ w
    fitted = ranker.fit(docs, labels)
    least, rng = loss(fitted.weights), np.random.default_rng(1)
    for step in (*np.eye(len(mean)) * 0.01, *-np.eye(len(mean)) * 0.01, *rng.normal(size=(10, len(mean))) * 0.01):
        assert loss(fitted.weights + step) > least  # the loss is convex, so this is its minimum

    strength = {k: float(z[k] @ fitted.weights) for k in x}
    ranked = sorted(strength[k] for k, _ in own)
    cut = (ranked[len(bad) - 1] + ranked[len(bad)]) / 2
    for r in ranker.judge(docs, labels).collect():
        s = 1 / (1 + math.exp(-(strength[r.doc_id] - cut + math.log(0.7 / 0.3))))
        assert abs(r.score - s) < 1e-6 and r.predicted == int(r.score >= 0.7)


def test_every_labelled_row_teaches(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ranker, "MOST_LABELLED", 40, raising=False)  # the bound there once was
    monkeypatch.setattr(ranker, "PAIR_BLOCK", 100, raising=False)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for turned, few in ((False, 4_096), (True, 0)):  # either class may be the larger one; joined by broadcast or by key
        monkeypatch.setattr(ranker, "FEW_ROWS", few, raising=False)
        told = labels.withColumn("quality", 1 - F.col("quality")) if turned else labels
        got = ranker.fit(docs, told)
        own = docs.join(told, "doc_id").where(~ranker.held_out(F.col("doc_id"))).select("quality", ranker.features(F.col("text")).alias("x")).orderBy(F.xxhash64("doc_id")).toPandas()
        want = ranker.learn(np.array(own["x"].tolist()), own["quality"].to_numpy())
        assert len(own) > 40
        assert np.allclose(got.mean, want.mean) and np.allclose(got.scale, want.scale) and np.allclose(got.weights, want.weights, atol=1e-7) and abs(got.threshold - want.threshold) < 1e-7


def test_no_text_is_shuffled_or_read_twice(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    written, real = {}, ranker.cut

    def noted(df, name):
        written[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(ranker, "cut", noted)
    before, bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(bound, "-1")  # as with more labels than can be broadcast
    try:
        plan = ranker.judge(docs, labels)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(bound, before)
    readers = [name for name, p in written.items() if "documents.parquet" in p]
    assert readers == ["ranker-rows"] and "Exchange" not in written["ranker-rows"] and "documents.parquet" not in plan
