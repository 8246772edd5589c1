"""Shared draws against plain NumPy with the same weights, and against the multinomial bootstrap."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.operators import draws, resample, rules

REPS = 40


def whole_weights(keys, reps=REPS, seed=draws.SEED):
    return draws.Weights(np.asarray(keys, np.int64), seed).of(0, reps).astype(np.float64)


def plain_auroc(w, score, up):
    below = (score[:, None] > score[None, :]) + 0.5 * (score[:, None] == score[None, :])
    pos, neg = w * up, w * ~up
    with np.errstate(invalid="ignore"):
        return np.einsum("ri,ij,rj->r", pos, below, neg) / (pos.sum(1) * neg.sum(1))


def test_weights_are_poisson_and_belong_to_rows():
    keys = np.r_[np.arange(20_000), [-1, 2**40, 2**40 + 1, -(2**62)]]
    w = whole_weights(keys)
    share = np.bincount(w.astype(int).ravel(), minlength=8)[:6] / w.size
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(6)], atol=3e-3)
    assert len(np.unique(w, axis=1).T) == len(keys)
    order = np.random.default_rng(0).permutation(len(keys))
    assert (whole_weights(keys[order]) == w[:, order]).all()
    assert (draws.Weights(keys).of(7, 9) == w[7:9]).all() and (whole_weights(keys, seed=1) != w).any()
    assert abs(np.corrcoef(w[:, :2000])[~np.eye(REPS, dtype=bool)]).max() < 0.12


def frame(spark, n=900):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        p = rng.dirichlet([1, 2, 3])
        for system in ("a", "b"):
            q = p if system == "a" else np.roll(p, 1) * 0.5 + p * 0.5
            rows.append((system, i, int(rng.integers(0, 3)) if system == "a" else rows[-1][2], int(q.argmax()), [float(x) for x in q / q.sum()]))
    return rows, spark.createDataFrame(rows, "system string, row_id bigint, label int, pred int, probs array<double>").repartition(5)


def test_sums_and_calibration_equal_matrix_products(spark):
    rows, df = frame(spark)
    got = {(r.system, r.rep): r for r in draws.calibration(df, ["system"], 3, reps=REPS).collect()}
    drawn = {}
    for system in ("a", "b"):
        own = sorted((r for r in rows if r[0] == system), key=lambda r: r[1])
        w = whole_weights([r[1] for r in own])
        label, pred, probs = (np.array([r[k] for r in own]) for k in (2, 3, 4))
        conf, ok, n = probs.max(1), (pred == label).astype(float), w.sum(1)
        bin_ = np.minimum((conf * 15).astype(int), 14)
        gaps = w @ ((ok - conf)[:, None] * (bin_[:, None] == np.arange(15)))
        one = lambda x: x[:, None] == np.arange(3)
        tp, both = w @ (one(label) & one(pred)), w @ one(label) + w @ one(pred)
        brier = ((probs - one(label)) ** 2).sum(1)
        want = {"accuracy": w @ ok / n, "mean_confidence": w @ conf / n, "brier": w @ brier / n, "ece": np.abs(gaps).sum(1) / n, "nll": w @ -np.log(probs[range(len(own)), label].clip(1e-12)) / n, "macro_f1": (2 * tp / both).sum(1) / 3}
        for m, values in want.items():
            assert [got[system, r][m] for r in range(REPS)] == pytest.approx(values, abs=1e-12)
        drawn[system] = want
    d = draws.deltas(draws.calibration(df, ["system"], 3, reps=REPS), "system", [("a", "b")], ["ece"]).orderBy("rep").collect()
    assert [r.ece for r in d] == pytest.approx(drawn["a"]["ece"] - drawn["b"]["ece"], abs=1e-12)


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_auroc_in_any_number_of_blocks(spark, blocks):
    rng = np.random.default_rng(8)
    rows = [(s, i, float(v), bool(rng.random() < 0.3)) for s in ("x", "y") for i, v in enumerate(np.where(rng.random(300) < 0.35, 0.0, rng.integers(0, 60, 300) / 7 if s == "x" else rng.random(300)))]
    df = spark.createDataFrame([*rows, ("x", 999, None, True), ("x", 998, float("nan"), False)], "s string, row_id bigint, score double, positive boolean").repartition(4)
    got = {(r.s, r.rep): r.auroc for r in draws.auroc(df, ["s"], reps=REPS, blocks=blocks).collect()}
    for s in ("x", "y"):
        own = [r for r in rows if r[0] == s]
        want = plain_auroc(whole_weights([r[1] for r in own]), np.array([r[2] for r in own]), np.array([r[3] for r in own]))
        assert [got[s, r] for r in range(REPS)] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("blocks", [1, 2, 25])
@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 1.0])
def test_quantiles_of_resamples(spark, blocks, q):
    rng = np.random.default_rng(9)
    rows = [(s, i, float(v)) for s in ("x", "y") for i, v in enumerate(np.where(rng.random(150) < 0.4, 2.0, rng.normal(size=150)))]
    df = spark.createDataFrame([*rows, ("x", 7777, None)], "s string, row_id bigint, v double").repartition(3)
    got = {(r.s, r.rep): r.quantile for r in draws.quantile(df, ["s"], "v", q, reps=REPS, blocks=blocks).collect()}
    for s in ("x", "y"):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[2])
        w = whole_weights([r[1] for r in own]).cumsum(1)
        want = [own[int(np.searchsorted(c, max(q * c[-1], 0.5)))][2] for c in w]
        assert [got[s, r] for r in range(REPS)] == want


def test_intervals_are_those_of_a_multinomial_bootstrap(spark):
    rng = np.random.default_rng(5)
    x = rng.exponential(size=2000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id bigint, x double")
    drawn = draws.sums(df, [], {"x": F.col("x")}).select((F.col("x") / F.col("n")).alias("m"))
    ends = resample.interval(drawn, [], "m").head()
    plain = np.percentile(rng.multinomial(2000, np.full(2000, 1 / 2000), 4000) @ x / 2000, [2.5, 97.5])
    assert ends.lo == pytest.approx(plain[0], abs=0.006) and ends.hi == pytest.approx(plain[1], abs=0.006)


def test_nulls_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, 1.0), ("g", None, 2.0), ("g", 5, None)], "g string, row_id bigint, x double")
    got = {(r.g, r.rep): (r.n, r.x) for r in draws.sums(df, ["g"], {"x": F.col("x")}, reps=3).collect()}
    w, v = whole_weights([-1], 3)[:, 0], whole_weights([5], 3)[:, 0]
    assert got == {**{(None, r): (w[r], w[r]) for r in range(3)}, **{("g", r): (w[r] + v[r], 2 * w[r]) for r in range(3)}}
    none = df.where("x > 9").withColumn("positive", F.lit(True))
    assert draws.sums(none, [], {"x": F.col("x")}).count() == draws.auroc(none, ["g"], "x").count() == draws.quantile(none, ["g"], "x").count() == 0


def test_sums_that_pass_the_bound_are_returned_in_parts(spark):
    _, df = frame(spark, 100)
    want = sorted(draws.sums(df, ["label"], {"x": F.col("row_id")}, reps=5).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(draws.sums(df, ["label"], {"x": F.col("row_id")}, reps=5, held_bytes=1).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("overlap, less, excludes, delta, sign", [(False, True, False, 0.1, -1), (False, False, True, -0.1, 1), (True, True, True, -0.1, -1), (True, True, True, 0.1, 1), (True, False, False, 0.1, 0)])
def test_sign_of_a_comparison(spark, overlap, less, excludes, delta, sign):
    one = spark.range(1).select(rules.signal_sign(F.lit(overlap), F.lit(less), F.lit(excludes), F.lit(delta)).alias("s"), rules.direction(F.lit(delta - 1), F.lit(delta + 1)).alias("d")).head()
    assert one.s == sign and one.d == "unchanged"


def test_weights_are_the_steps_a_word_reaches():
    from uqframe.operators.draws import MULTIPLIERS, STEPS, Weights

    def mix(x):
        for shift, m in zip((16, 15), MULTIPLIERS):
            x = (x ^ x >> shift) * m % 2**32
        return x ^ x >> 16

    w = Weights(np.arange(-3, 200))
    got = w.of(5, 400)
    for i in (0, 3, 4, 100, 202):
        for rep in (5, 6, 77, 399):
            u = mix(int(w.a[i]) ^ mix(int(w.b[i]) ^ mix(rep + 1 ^ int(w.seed[0]))))
            assert got[rep - 5, i] == sum(u >= s for s in STEPS)
    assert got.max() < 12 and Weights(np.zeros(0, np.int64)).of(0, 3).shape == (3, 0)


def test_words_at_a_step_are_told_apart():
    from uqframe.operators import draws

    upper = np.array(draws.STEPS, np.uint64) >> np.uint64(16)
    assert (draws._BY_UPPER[upper.astype(int)] == draws.OPEN).all() and np.count_nonzero(draws._BY_UPPER == draws.OPEN) == len(set(upper.tolist()))
    for s in draws.STEPS[:4]:
        assert draws._BY_UPPER[(s >> 16) - 1] == draws.STEPS.index(s) and draws._BY_UPPER[(s >> 16) + 1] == draws.STEPS.index(s) + 1


def test_blocks_are_narrow_around_a_quantile_only(spark, monkeypatch):
    monkeypatch.setattr(draws, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(4)
    v = np.r_[rng.random(900), np.full(100, 0.25)]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "row_id bigint, v double")
    for q in (0.5, 0.3, 0.01):
        assert draws._blocked(df, [], "v", ["row_id"], None, q).select("__block").distinct().count() <= 2 * len(draws.NEAR) + 1
        got = {r.rep: r.quantile for r in draws.quantile(df, [], "v", q, reps=60).collect()}
        order = np.argsort(v, kind="stable")
        w = draws.Weights(order.astype(np.int64)).of(0, 60).cumsum(axis=1, dtype=np.int64)
        assert got == {r: float(v[order][np.searchsorted(w[r], q * w[r, -1], "left")]) for r in range(60)}


def test_areas_are_added_row_by_row_and_whole(monkeypatch):
    rng = np.random.default_rng(6)
    score, up = np.sort(np.r_[rng.random(200), np.full(60, 0.5), np.repeat(0.25, 5)]), rng.random(265) < 0.3
    w = whole_weights(np.arange(265))
    for rows, tile in ((4096, 1 << 16), (9, 90)):
        monkeypatch.setattr(draws, "AREA_ROWS", rows)
        monkeypatch.setattr(draws, "TILE", tile)
        pos, neg, area = draws.area(score, up, draws.Weights(np.arange(265)), REPS)
        assert (pos == (w * up).sum(1)).all() and (neg == (w * ~up).sum(1)).all()
        assert area / (pos * neg) == pytest.approx(plain_auroc(w, score, up), abs=1e-12)


def test_products_of_counts_and_of_other_numbers():
    rng = np.random.default_rng(7)
    x = np.c_[rng.random((500, 3)), rng.random((500, 4)) < 0.2, np.full(500, 1e6)]
    got = draws._products(draws.Weights(np.arange(500)), x, REPS)
    assert np.allclose(got, whole_weights(np.arange(500)) @ x, rtol=1e-13) and (got[:, 3:7] == np.rint(got[:, 3:7])).all()


def test_a_row_s_weights_are_drawn_once_for_all_systems(spark):
    _, df = frame(spark, 400)
    tasks = draws.together(df).select("row_id", F.spark_partition_id().alias("t")).distinct()
    assert tasks.count() == 400  # both systems' rows of a key lie in one task, beside each other
    some = draws.calibration(df, ["system"], 3, reps=5, measures=("ece",))
    assert some.columns == ["system", "rep", "ece"] and "tp" not in some._jdf.queryExecution().optimizedPlan().toString()
    whole = {(r.system, r.rep): r.ece for r in draws.calibration(df, ["system"], 3, reps=5).collect()}
    assert {(r.system, r.rep): r.ece for r in some.collect()} == pytest.approx(whole, abs=1e-12)
