"""The surrogate frame: matrices of a task equal the column expressions; only what a query needs is made."""

from pyspark.sql import functions as F

from uqframe.functions import vectors as V
from uqframe.operators import ensembles
from uqframe.sources import shared
from uqframe.sources import surrogate as S


def test_matrices_equal_the_expressions(spark, sf_dir):
    z = S.logits(*S.IMAGES[1][1:], 1.0)
    want = {r.row_id: r for r in S.samples(spark, sf_dir).select("row_id", "split", ensembles.pool(S.members(z)).alias("u"), V.softmax(z).alias("p")).collect()}
    got = S.made_predictions(spark, sf_dir, (("imgB", "pgs", "pgs"), ("imgB", "pgs", "argmax"))).collect()
    assert len(got) == 2 * len(want)
    close = lambda a, b: abs(a - b) < 1e-12
    for r in got:
        w = want[r.row_id]
        assert r.split == w.split and r.pred == max(range(S.CLASSES), key=lambda k: r.probs[k])
        assert all(map(close, r.probs, w.u.probs if r.mode == "pgs" else w.p))
        if r.mode == "pgs":
            assert all(close(r[t], w.u[t]) for t in ("mi", "pred_entropy", "exp_entropy", "prob_std")) and all(map(close, r.probs_loglin, w.u.loglin))
        else:
            assert r.mi is None and r.probs_loglin is None


def test_only_what_is_asked_for_is_made(spark, tmp_path):
    spark.range(0, 40).select(F.col("id").alias("o_orderkey"), (F.col("id") * 3).alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    assert S.predictions(spark, str(tmp_path), (("imgA", "pgs", "argmax"),), "val").count() == 20
    made = [name for _, name, origin in shared._KEPT if origin == str(tmp_path)]
    assert made == ["predictions-imgA-pgs-argmax-val"]


def test_no_task_grows_with_the_table(spark):
    df = spark.range(0, 1000, 1, 5)
    assert shared.spread(df, "id", 10).rdd.getNumPartitions() == 100 and shared.spread(df, "id", 10_000).rdd.getNumPartitions() == 5
