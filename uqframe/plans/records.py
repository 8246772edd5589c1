"""Queries of edits, multimaps, exact shares, bit-equal features, pooled ensembles and derived tables."""

from __future__ import annotations

import uuid

from uqframe.operators import edits, scorer
from uqframe.plans.base import F, V, prep, query, r6, table
from uqframe.sources import cache
from uqframe.sources.shared import shared_dir


def _edits(spark, sf_dir):
    """Edits of the benchmark's passages: replacements and insertions, some for passages that no text has."""
    b, k = table(spark, sf_dir, "benchmark"), F.col("item_id")
    needle = F.when(k % 5 == 0, F.concat(F.lit("no such "), F.substring("text", 1, 24))).otherwise(F.substring("text", 1, 24))
    old = F.when(k % 2 == 0, F.when(k % 14 == 0, F.lit("not there")).otherwise(F.substring("text", 3, 12)))
    after = F.when((k % 2 == 1) & (k % 3 > 0), F.substring("text", 5, 10))
    mark = F.concat(F.lit("<"), k.cast("string"), F.lit(">"))
    return b.select(k.alias("edit"), needle.alias("needle"), old.alias("old"), mark.alias("new"), after.alias("after"), mark.alias("insert"))


_EDITS = """e AS (SELECT item_id AS edit, CASE WHEN item_id % 5 = 0 THEN 'no such ' ELSE '' END || substr(text, 1, 24) AS needle, CASE WHEN item_id % 14 = 0 THEN 'not there' WHEN item_id % 2 = 0 THEN substr(text, 3, 12) END AS old,
CASE WHEN item_id % 2 = 1 AND item_id % 3 > 0 THEN substr(text, 5, 10) END AS after_, '<' || item_id || '>' AS mark FROM benchmark),
h AS (SELECT d.doc_id, d.text, e.* EXCLUDE (needle), row_number() OVER (PARTITION BY d.doc_id ORDER BY edit) AS step FROM documents d JOIN e ON contains(d.text, e.needle))"""
_TARGET = "coalesce(h.old, h.after_)"
_APPLIED = f"({_TARGET} IS NULL OR strpos(a.text, {_TARGET}) > 0)"


@query(f"""WITH RECURSIVE {_EDITS}, a AS (SELECT DISTINCT doc_id, 0::BIGINT AS step, text, 0 AS applied, 0 AS missing FROM h UNION ALL
SELECT a.doc_id, h.step, CASE WHEN {_TARGET} IS NULL THEN a.text || h.mark WHEN strpos(a.text, {_TARGET}) = 0 THEN a.text WHEN h.old IS NOT NULL THEN substr(a.text, 1, strpos(a.text, h.old) - 1) || h.mark || substr(a.text, strpos(a.text, h.old) + length(h.old))
ELSE substr(a.text, 1, strpos(a.text, h.after_) + length(h.after_) - 1) || h.mark || substr(a.text, strpos(a.text, h.after_) + length(h.after_)) END, a.applied + {_APPLIED}::INT, a.missing + (NOT {_APPLIED})::INT
FROM a JOIN h ON h.doc_id = a.doc_id AND h.step = a.step + 1) SELECT doc_id, arg_max(sha256(text), step) AS edited, max(applied)::INT AS applied, max(missing)::INT AS missing FROM a GROUP BY doc_id""")
def edit_instructions(spark, sf_dir):
    """All edits applied to every document that holds their needle."""
    done = edits.apply(table(spark, sf_dir, "documents").select("doc_id", "text"), _edits(spark, sf_dir), everywhere=True).where(F.size("outcomes") > 0)
    count = lambda what: F.size(F.filter("outcomes", lambda o: o["outcome"] == what))
    return done.select("doc_id", F.sha2("edited", 256).alias("edited"), count("applied").alias("applied"), count("target missing").alias("missing"))


@query(f"WITH {_EDITS}, n AS (SELECT edit, count(*) AS texts FROM h GROUP BY edit) SELECT edit, coalesce(texts, 0) AS texts, CASE WHEN texts IS NULL THEN 'unmatched' WHEN texts > 1 THEN 'repeated' ELSE 'one' END AS state FROM e LEFT JOIN n USING (edit)")
def edit_report(spark, sf_dir):
    """What becomes of each edit where a needle has to name one text: unmatched and repeated needles are reported."""
    r = edits.report(table(spark, sf_dir, "documents").select("text"), _edits(spark, sf_dir))
    return r.select("edit", "texts", F.when(F.col("state").isin("applied", "target missing"), "one").otherwise(F.col("state")).alias("state"))


@query("WITH e AS (SELECT (props ->> '$.k')::INT AS k, user_id, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, ((row_number() OVER (PARTITION BY k ORDER BY first) - 1) // 20)::INT AS part FROM e WHERE user_id IS NOT NULL) SELECT k, part, array_to_string(list(user_id ORDER BY first), ',') AS users FROM r GROUP BY k, part")
def id_multimap(spark, sf_dir):
    """Users of each value of a JSON field, each once, in the order of their first event, in parts of 20."""
    e = table(spark, sf_dir, "events").select(F.from_json("props", "k int")["k"].alias("k"), "user_id", "event_id")
    return prep.multimap(e, "k", "user_id", "event_id", 20).select("k", "part", F.array_join("values", ",").alias("users"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || vec_id), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, k <= round_even(n * 0.1e0, 0) AS zeroed, round(list_sum(list_transform(embedding, lambda x: CASE WHEN k <= round_even(n * 0.1e0, 0) THEN 0e0 ELSE abs(x::DOUBLE) END)), 5) AS size FROM r")
def zeroed_share(spark, sf_dir):
    """Exactly a tenth of each label's vectors, set to zero."""
    picked = prep.exact_share(table(spark, sf_dir, "embeddings"), "label", "vec_id", 0.1, "zeroed")
    size = V.total(F.transform("embedding", lambda x: F.when(F.col("zeroed"), 0.0).otherwise(F.abs(x.cast("double")))))
    return picked.select("vec_id", "zeroed", F.round(size, 5).alias("size"))


@query("SELECT vec_id, ((vec_id % 7 = 0)::INT + (vec_id % 13 = 0)::INT + (vec_id % 17 = 0)::INT)::INT AS differ FROM embeddings WHERE vec_id < 100")
def feature_cross_check(spark, sf_dir):
    """Entries of the first 100 vectors that differ to the bit from a second reading, with planted signed zeros, NaN, last bits and lengths."""
    e, k = table(spark, sf_dir, "embeddings").where("vec_id < 100").select("vec_id", "embedding"), F.col("vec_id")
    first = F.transform("embedding", lambda x, i: F.when((i == 0) & (k % 7 == 0), F.lit(0.0)).when((i == 1) & (k % 11 == 0), F.lit(float("nan"))).when((i == 2) & (k % 13 == 0), F.lit(1.0)).otherwise(x.cast("double")))
    second = F.transform("embedding", lambda x, i: F.when((i == 0) & (k % 7 == 0), F.lit(-0.0)).when((i == 1) & (k % 11 == 0), F.lit(float("nan"))).when((i == 2) & (k % 13 == 0), F.lit(1.0 + 2.0**-52)).otherwise(x.cast("double")))
    second = F.when(k % 17 == 0, F.slice(second, 1, F.size("embedding") - 1)).otherwise(second)
    return e.select("vec_id", V.bits_that_differ(first, second).alias("differ"))


_MEMBERS, _CLASSES = 4, 3


def _outputs(x):
    """Raw outputs of fixed linear members."""
    import numpy as np

    i, k, m = np.ogrid[: x.shape[1], :_CLASSES, :_MEMBERS]
    w = ((i * 31 + k * 17 + m * 7) % 11 - 5) / 5.0
    return np.einsum("ni,ikm->nmk", x, w)


@query(f"""WITH z AS (SELECT vec_id, list_transform(range(0, {_MEMBERS}), lambda m: list_transform(range(0, {_CLASSES}), lambda k: list_sum(list_transform(range(0, len(embedding)), lambda i: embedding[i + 1]::DOUBLE * ((i * 31 + k * 17 + m * 7) % 11 - 5) / 5e0)))) AS z FROM embeddings),
p AS (SELECT vec_id, z, list_transform(z, lambda r: list_transform(r, lambda x: exp(x) / list_sum(list_transform(r, lambda y: exp(y))))) AS p FROM z),
q AS (SELECT *, list_transform(range(1, {_CLASSES + 1}), lambda k: list_sum(list_transform(p, lambda r: r[k])) / {_MEMBERS}) AS q, list_transform(range(1, {_CLASSES + 1}), lambda k: list_sum(list_transform(z, lambda r: r[k])) / {_MEMBERS}) AS zb FROM p),
h AS (SELECT *, -list_sum(list_transform(q, lambda x: x * ln(x))) AS h, list_sum(list_transform(p, lambda r: -list_sum(list_transform(r, lambda x: x * ln(x))))) / {_MEMBERS} AS e FROM q)
SELECT vec_id, (list_position(q, list_max(q)) - 1)::INT AS pred, (list_position(zb, list_max(zb)) - 1)::INT AS pred_loglin, round(list_max(q), 6) AS confidence, round(h, 6) AS pred_entropy, round(greatest(0e0, h - e), 6) + 0e0 AS mi,
round(list_sum(list_transform(range(1, {_CLASSES + 1}), lambda k: sqrt(list_sum(list_transform(p, lambda r: pow(r[k] - q[k], 2))) / {_MEMBERS}))) / {_CLASSES}, 6) AS prob_std FROM h""")
def ensemble_inference(spark, sf_dir):
    """Members' raw outputs of every vector, checked and pooled batch by batch."""
    u = scorer.apply_ensemble(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _outputs, _MEMBERS, _CLASSES)
    return u.select("vec_id", "pred", "pred_loglin", r6(V.confidence(F.col("probs"))).alias("confidence"), r6("pred_entropy").alias("pred_entropy"), r6("mi").alias("mi"), r6("prob_std").alias("prob_std"))


@query("""WITH f AS (SELECT event_type AS mode, count(*) AS n, sum(value) AS q FROM events GROUP BY ALL), s AS (SELECT *, row_number() OVER (ORDER BY mode) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT event_type AS mode FROM events))
SELECT f.mode, CASE WHEN i = 0 THEN 'gone' WHEN i = 1 THEN 'changed' WHEN i = k - 1 THEN 'new' ELSE 'fresh' END AS state, CASE WHEN i > 0 THEN n ELSE 0 END AS n, CASE WHEN i > 0 THEN round(q * CASE WHEN i = 1 THEN 2 ELSE 1 END, 2) ELSE 0e0 END AS quantity FROM f JOIN s USING (mode)""")
def derived_refresh(spark, sf_dir):
    """A derived table after its input lost one file, changed another and gained a third: only those two are made again."""
    base = f"{shared_dir(spark)}/uqframe-derived-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("q"))
    modes = sorted(r["mode"] for r in rows.select("mode").distinct().collect())  # a handful of types of event

    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    store = path(base).getFileSystem(context._jsc.hadoopConfiguration())
    place = lambda folder, mode: path(f"{base}/{folder}/{mode.replace(' ', '_')}.parquet")

    def put(mode, factor, folder):
        """One input file. Sorted within one partition: coalesce would take sorted partitions in the order of their hosts."""
        one = rows.where(F.col("mode") == mode).groupBy("mode", (F.col("q") * factor).alias("q")).agg(F.count(F.lit(1)).alias("times")).repartition(1).sortWithinPartitions("q")
        one.write.mode("overwrite").parquet(f"{base}/staged")
        store.mkdirs(path(f"{base}/{folder}"))
        written = next(s.getPath() for s in store.globStatus(path(f"{base}/staged/part-*.parquet")))
        store.rename(written, place(folder, mode))

    for m in modes[:-1]:
        put(m, 1, "first")
    for m in modes[1:]:
        if m in modes[2:-1]:  # the same file in both stages: a copy, so equal to the byte wherever it was written
            context._jvm.org.apache.hadoop.fs.FileUtil.copy(store, place("first", m), store, place("second", m), False, context._jsc.hadoopConfiguration())
        else:
            put(m, 2 if m == modes[1] else 1, "second")
    make = lambda df: df.select(cache.SOURCE, "mode", "q", "times")
    cache.refresh(spark, f"{base}/first", f"{base}/out", make)
    steps = cache.refresh(spark, f"{base}/second", f"{base}/out", make)
    state = steps.select(F.replace(F.replace("file", F.lit(".parquet")), F.lit("_"), F.lit(" ")).alias("mode"), "state")
    found = cache.read(spark, f"{base}/out").groupBy("mode").agg(F.sum("times").alias("n"), F.round(F.sum(F.col("q") * F.col("times")), 2).alias("quantity"))
    return state.join(found, "mode", "left").na.fill(0, ["n", "quantity"]).select("mode", "state", "n", "quantity")
