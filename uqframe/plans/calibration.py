"""Frame, vector, ensemble, calibration and classification queries."""

from __future__ import annotations

from uqframe.plans.base import *  # noqa: F403
from uqframe.plans.base import F, FRAME, POOLED, SERVED, SYS, TEST, S, V, ensembles, metrics, query, r6, rounded, sql, temperature, test_rows

_LIST6 = "list_transform({}, lambda x: round(x, 6) + 0e0)"


def _array6(c):
    return F.transform(c, lambda x: F.round(x, 6) + F.lit(0.0))


@query(FRAME + "SELECT image, checkpoint, mode, split, count(*) AS n, count(DISTINCT row_id) AS ids, round(avg(list_max(probs)), 6) AS mean_confidence, round(avg(mi), 6) AS mean_mi, sum(pred)::BIGINT AS sum_pred FROM preds GROUP BY ALL")
def pred_frame(spark, sf_dir):
    df = S.predictions(spark, sf_dir)
    return rounded(df.groupBy(*SYS, "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids"), F.avg(V.confidence(F.col("probs"))).alias("mean_confidence"), F.avg("mi").alias("mean_mi"), F.sum("pred").alias("sum_pred")))


@query("WITH " + sql.frame((POOLED,)) + " SELECT split, row_id, unnest(range(0, 8))::INT AS member, round(list_sum(zm[unnest(range(0, 8)) + 1]), 6) AS logit_sum FROM memb")
def member_frame(spark, sf_dir):
    df = S.member_frame(spark, sf_dir).select("split", "row_id", F.posexplode("members").alias("member", "z"))
    return df.select("split", "row_id", "member", r6(V.total(F.col("z"))).alias("logit_sum"))


@query("WITH " + sql.frame((SERVED,), "test") + " SELECT row_id, label, pred FROM preds")
def split_filter(spark, sf_dir):
    return S.predictions(spark, sf_dir, (SERVED,)).where("split = 'test'").select("row_id", "label", "pred")


@query("WITH " + sql.frame((SERVED,)) + " SELECT split, CASE split WHEN 'val' THEN 0 ELSE 1 END AS ord, count(*) AS n, min(row_id) AS first_id, max(row_id) AS last_id FROM preds GROUP BY split")
def union_splits(spark, sf_dir):
    df = S.predictions(spark, sf_dir, (SERVED,))
    both = df.where("split = 'val'").withColumn("ord", F.lit(0)).unionByName(df.where("split = 'test'").withColumn("ord", F.lit(1)))
    return both.groupBy("split", "ord").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))


@query("WITH " + sql.frame((SERVED,), "test") + " SELECT row_id, unnest(range(0, 9))::INT AS k, round(probs[unnest(range(0, 9)) + 1], 6) AS p FROM preds")
def softmax_long(spark, sf_dir):
    df = test_rows(spark, sf_dir, (SERVED,)).select("row_id", F.posexplode("probs").alias("k", "p"))
    return df.select("row_id", "k", r6("p").alias("p"))


@query("WITH " + sql.frame((POOLED,), "test") + " SELECT row_id, round(-list_sum(list_transform(probs, lambda x: x * ln(least(1e0, greatest(x, 1e-12))))), 6) AS entropy FROM preds")
def entropy_rows(spark, sf_dir):
    return test_rows(spark, sf_dir, (POOLED,)).select("row_id", r6(V.entropy(F.col("probs"))).alias("entropy"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-9), 2))), 6) AS squared, round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-9), 6) AS first FROM embeddings")
def l2_embeddings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", V.l2_normalize(F.col("embedding")).alias("u"))
    return e.select("vec_id", r6(V.total(F.transform("u", lambda x: x * x))).alias("squared"), r6(F.get("u", 0)).alias("first"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-9)) AS v FROM embeddings)
SELECT a.vec_id, len(a.v) + len(b.v) AS width, round(list_sum(list_transform(list_concat(a.v, b.v), lambda x: x::FLOAT::DOUBLE)), 4) AS total FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""")
def fused_features(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    both = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    fused = both.select("vec_id", V.fuse(F.col("a"), F.col("b")).alias("f"))
    return fused.select("vec_id", F.size("f").cast("bigint").alias("width"), (F.round(V.total(F.transform("f", lambda x: x.cast("double"))), 4) + F.lit(0.0)).alias("total"))


@query("WITH " + sql.frame((SERVED,), "test") + " SELECT row_id, (list_position(list_transform(probs, lambda x: round(x, 1)), list_max(list_transform(probs, lambda x: round(x, 1)))) - 1)::INT AS lowest FROM preds")
def argmax_lowest(spark, sf_dir):
    return test_rows(spark, sf_dir, (SERVED,)).select("row_id", V.argmax_lowest(F.transform("probs", lambda x: F.round(x, 1))).alias("lowest"))


@query(TEST + "SELECT image, checkpoint, mode, row_id, round(brier, 6) AS brier FROM rows_ WHERE image = 'imgA'")
def brier_rows(spark, sf_dir):
    return test_rows(spark, sf_dir).where("image = 'imgA'").select(*SYS, "row_id", r6(V.brier(F.col("probs"), F.col("label"))).alias("brier"))


@query(TEST + "SELECT image, checkpoint, mode, row_id, round(nll, 6) AS nll FROM rows_ WHERE image = 'imgA'")
def nll_rows(spark, sf_dir):
    return test_rows(spark, sf_dir).where("image = 'imgA'").select(*SYS, "row_id", r6(V.nll(F.col("probs"), F.col("label"))).alias("nll"))


@query("WITH " + sql.frame((POOLED,), "test") + f" SELECT row_id, {_LIST6.format('probs')} AS probs, pred FROM preds")
def pool_linear(spark, sf_dir):
    return test_rows(spark, sf_dir, (POOLED,)).select("row_id", _array6("probs").alias("probs"), "pred")


@query("WITH " + sql.frame((POOLED,), "test") + f" SELECT row_id, {_LIST6.format('probs_loglin')} AS probs, (list_position(probs_loglin, list_max(probs_loglin)) - 1)::INT AS pred FROM preds")
def pool_loglinear(spark, sf_dir):
    return test_rows(spark, sf_dir, (POOLED,)).select("row_id", _array6("probs_loglin").alias("probs"), V.argmax_lowest(F.col("probs_loglin")).alias("pred"))


@query("WITH " + sql.frame((POOLED,), "test") + " SELECT row_id, round(mi, 6) + 0e0 AS mi, round(pred_entropy, 6) AS pred_entropy, round(exp_entropy, 6) AS exp_entropy, round(prob_std, 6) AS prob_std FROM preds")
def uncertainty_terms(spark, sf_dir):
    return rounded(test_rows(spark, sf_dir, (POOLED,)).select("row_id", "mi", "pred_entropy", "exp_entropy", "prob_std"))


_CALIBRATION = "count(*) AS n, round(avg(ok), 6) AS accuracy, round(avg(conf), 6) AS mean_confidence, round(avg(conf) - avg(ok), 6) + 0e0 AS confidence_gap"
_BINNED = ", b AS (SELECT image, checkpoint, mode, bin, sum(ok) AS ok, sum(conf) AS conf FROM rows_ GROUP BY ALL), e AS (SELECT image, checkpoint, mode, sum(abs(ok - conf)) AS gap FROM b GROUP BY ALL) "
_TABLE = TEST + _BINNED + f"SELECT image, checkpoint, mode, {_CALIBRATION}, round(any_value(gap) / count(*), 6) AS ece, round(avg(brier), 6) AS brier, round(avg(nll), 6) AS nll FROM rows_ JOIN e USING (image, checkpoint, mode) "


@query(_TABLE + "GROUP BY ALL")
def calibration_table(spark, sf_dir):
    return rounded(metrics.calibration(test_rows(spark, sf_dir), SYS))


@query(_TABLE + "WHERE image = 'imgA' AND checkpoint = 'pgs' AND mode = 'argmax' GROUP BY ALL")
def calibration_row(spark, sf_dir):
    return rounded(metrics.calibration(test_rows(spark, sf_dir, (SERVED,)), SYS))


@query(TEST + _BINNED + "SELECT image, checkpoint, mode, round(gap / (SELECT count(*) FROM samples WHERE split = 'test'), 6) AS ece FROM e")
def ece(spark, sf_dir):
    return rounded(metrics.calibration(test_rows(spark, sf_dir), SYS).select(*SYS, "ece"))


@query(TEST + """, g AS (SELECT image, checkpoint, mode, bin, count(*) AS n, avg(ok) AS accuracy, avg(conf) AS mean_confidence FROM rows_ GROUP BY ALL),
d AS (SELECT * FROM (SELECT DISTINCT image, checkpoint, mode FROM g), (SELECT unnest(range(0, 15)) AS bin))
SELECT image, checkpoint, mode, bin::INT AS bin, round(bin / 15e0, 6) AS lower, round((bin + 1) / 15e0, 6) AS upper, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY image, checkpoint, mode)::DOUBLE, 6) AS share, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence FROM d LEFT JOIN g USING (image, checkpoint, mode, bin)""")
def reliability_bins(spark, sf_dir):
    return rounded(metrics.reliability(test_rows(spark, sf_dir), SYS))


_GRID = [0.5, 0.8, 0.9, 1.0, 1.1, 1.25, 1.5, 2.0, 3.0]
_GRID_SQL = ", ".join(f"{t}e0" for t in _GRID)


@query("WITH " + sql.frame((SERVED,), "val") + f""", l AS (SELECT row_id, label, list_transform(probs, lambda x: ln(least(1e0, greatest(x, 1e-12)))) AS lp FROM preds), t AS (SELECT unnest([{_GRID_SQL}]) AS temperature)
SELECT temperature, round(avg(ln(list_sum(list_transform(lp, lambda x: exp((x - list_max(lp)) / temperature)))) + (list_max(lp) - lp[label + 1]) / temperature), 6) AS nll FROM l, t GROUP BY temperature""")
def temperature_grid(spark, sf_dir):
    return rounded(temperature.grid_losses(S.predictions(spark, sf_dir, (SERVED,), "val"), _GRID))


_SCALED = ", q AS (SELECT *, list_transform(probs, lambda x: exp(ln(least(1e0, greatest(x, 1e-12))) / 1.5e0)) AS ex FROM preds), w AS (SELECT row_id, label, pred, list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM q)"


@query("WITH " + sql.frame((SERVED,), "test") + _SCALED + """, x AS (SELECT *, (pred = label)::INT AS ok, list_max(probs) AS conf, len(list_filter(range(1, 15), lambda i: list_max(probs) > i / 15e0)) AS bin, -ln(least(1e0, greatest(probs[label + 1], 1e-12))) AS nll FROM w),
b AS (SELECT bin, sum(ok) AS ok, sum(conf) AS conf FROM x GROUP BY bin)
SELECT count(*) AS n, round(avg(ok), 6) AS accuracy, round(avg(conf), 6) AS mean_confidence, round((SELECT sum(abs(ok - conf)) FROM b) / count(*), 6) AS ece, round(avg(nll), 6) AS nll FROM x""")
def temperature_scaled_row(spark, sf_dir):
    scaled = test_rows(spark, sf_dir, (SERVED,)).withColumn("probs", V.apply_temperature(F.col("probs"), 1.5))
    return rounded(metrics.calibration(scaled, []).select("n", "accuracy", "mean_confidence", "ece", "nll"))


@query("WITH " + sql.frame((SERVED,), "test") + _SCALED + "SELECT count_if((list_position(probs, list_max(probs)) - 1) <> pred)::BIGINT AS flips FROM w")
def temperature_argmax_flips(spark, sf_dir):
    scaled = test_rows(spark, sf_dir, (SERVED,)).withColumn("probs", V.apply_temperature(F.col("probs"), 1.5))
    return scaled.agg(F.count_if(V.argmax_lowest(F.col("probs")) != F.col("pred")).alias("flips"))


@query()
def temperature_fit(spark, sf_dir):
    found = temperature.fit(S.predictions(spark, sf_dir, (SERVED,), "val"))
    return spark.createDataFrame([(round(found["temperature"], 5), round(found["nll"], 6), found["at_bound"], found["converged"])], "temperature double, nll double, at_bound boolean, converged boolean")


@query(FRAME + "SELECT image, checkpoint, mode, split, count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy FROM preds GROUP BY ALL")
def accuracy_by_split(spark, sf_dir):
    return rounded(metrics.accuracy(S.predictions(spark, sf_dir), [*SYS, "split"]))


@query(TEST + "SELECT image, checkpoint, mode, label, pred, count(*) AS n FROM rows_ GROUP BY ALL")
def confusion(spark, sf_dir):
    return metrics.confusion(test_rows(spark, sf_dir), SYS)


_F1 = TEST + """, c AS (SELECT image, checkpoint, mode, k, 2e0 * count_if(pred = k AND label = k) / nullif(count_if(pred = k) + count_if(label = k), 0) AS f1, count_if(label = k) AS nl, count_if(label = k AND pred = k) / nullif(count_if(label = k), 0)::DOUBLE AS recall
FROM rows_, (SELECT unnest(range(0, 9)) AS k) GROUP BY ALL) """


@query(_F1 + "SELECT image, checkpoint, mode, round(sum(coalesce(f1, 0)) / 9, 6) AS macro_f1 FROM c GROUP BY ALL")
def macro_f1_fixed(spark, sf_dir):
    return rounded(metrics.macro_f1(metrics.confusion(test_rows(spark, sf_dir), SYS), SYS, S.CLASSES))


@query(_F1 + "SELECT image, checkpoint, mode, round(avg(f1), 6) AS macro_f1 FROM c GROUP BY ALL")
def macro_f1_observed(spark, sf_dir):
    return rounded(metrics.macro_f1(metrics.confusion(test_rows(spark, sf_dir), SYS), SYS))


@query(_F1 + "SELECT image, checkpoint, mode, round(avg(recall), 6) AS balanced_accuracy FROM c GROUP BY ALL")
def balanced_accuracy(spark, sf_dir):
    return rounded(metrics.balanced_accuracy(metrics.confusion(test_rows(spark, sf_dir), SYS), SYS))


@query("WITH " + sql.samples() + " SELECT label, count(*) AS n, round((SELECT count(*) FROM samples WHERE split = 'val') / (9e0 * count(*)), 6) AS weight FROM samples WHERE split = 'val' GROUP BY label")
def class_weights(spark, sf_dir):
    return rounded(metrics.class_weights(S.samples(spark, sf_dir).where("split = 'val'"), S.CLASSES))


@query("WITH " + sql.samples() + ", s AS (SELECT split, label, count(*) / sum(count(*)) OVER (PARTITION BY split)::DOUBLE AS share FROM samples GROUP BY split, label) SELECT label, round(max(share) - min(share), 6) AS max_difference FROM s GROUP BY label")
def class_balance_drift(spark, sf_dir):
    return rounded(metrics.balance_drift(S.samples(spark, sf_dir)))


@query(TEST + "SELECT image, checkpoint, mode, round(avg(ok), 6) AS accuracy, round(avg(prob_std), 6) AS mean_prob_std, round(avg(mi), 6) + 0e0 AS mean_mi FROM rows_ GROUP BY ALL")
def system_summary(spark, sf_dir):
    return rounded(test_rows(spark, sf_dir).groupBy(*SYS).agg(F.avg(metrics.correct()).alias("accuracy"), F.avg("prob_std").alias("mean_prob_std"), F.avg("mi").alias("mean_mi")))
