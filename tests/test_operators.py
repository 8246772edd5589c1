"""Operators against plain Python on edge cases."""

import gzip
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.functions import text as X
from uqframe.functions import vectors as V
from uqframe.operators import contracts, ensembles, metrics, paired, prep, ranking, resample, rules, scorer, selective, temperature, template
from uqframe.sources import readers, shared


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).head()


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_bins_own_their_right_edge(spark):
    edges = [i / 15 for i in range(16)] + [math.nextafter(i / 15, 2) for i in range(1, 15)] + [-1.0]
    df = spark.createDataFrame([(x,) for x in edges], "x double").select("x", V.bin_index(F.col("x")).alias("b"))
    for r in df.collect():
        assert r.b == max(0, sum(r.x > i / 15 for i in range(1, 15)))


def test_vectors(spark):
    r = one(spark, V.argmax_lowest(vec(0.2, 0.4, 0.4)), V.nll(vec(1, 0), F.lit(1)), V.l2_normalize(vec(3, 4)), V.l2_normalize(vec(0, 0)), V.entropy(vec(0.5, 0.5)), V.brier(vec(1, 0), F.lit(1)), V.softmax(vec(1000, 1000)), V.fuse(vec(3, 4), vec(0, 2)))
    assert r.c0 == 1 and math.isclose(r.c1, -math.log(1e-12)) and r.c2 == [0.6, 0.8] and r.c3 == [0, 0]
    assert math.isclose(r.c4, math.log(2)) and r.c5 == 2 and r.c6 == [0.5, 0.5] and np.allclose(r.c7, [0.6, 0.8, 0, 1])


def test_pooling_against_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(5, 4))
    u = spark.createDataFrame([(z.tolist(),)], "z array<array<double>>").select(ensembles.pool(F.col("z")).alias("u")).head().u
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    q = p.mean(axis=0)
    h = lambda x: -(x * np.log(x)).sum(axis=-1)
    assert np.allclose(u.probs, q) and math.isclose(u.pred_entropy, h(q)) and math.isclose(u.exp_entropy, h(p).mean()) and math.isclose(u.mi, h(q) - h(p).mean()) and math.isclose(u.prob_std, p.std(axis=0).mean())
    same = spark.createDataFrame([([[1.0, 2.0]] * 3,)], "z array<array<double>>").select(ensembles.pool(F.col("z")).alias("u")).head().u
    assert abs(same.mi) < 1e-12 and same.prob_std < 1e-12 and np.allclose(same.probs, same.loglin)


@pytest.mark.parametrize(("b", "c", "p"), [(0, 0, 1.0), (84, 45, 0.000755890272), (5, 5, 1.0), (0, 3, 0.25), (1970, 1785, 0.0026712088), (3486, 1785, 2.08e-123)])
def test_mcnemar(spark, b, c, p):
    assert math.isclose(one(spark, paired.mcnemar_exact(F.lit(b), F.lit(c))).c0, p, rel_tol=5e-3 if p < 1e-9 else 1e-7)


def test_worst_cases_match_the_published_bounds(spark):
    rows = [(0.8074, 0.7874, None, 1970, 1785, 0.0026712088), (0.8073, 0.7874, None, 1970, 1786, 0.0028217742), (0.7996, 0.7850, None, 1992, 1857, 0.0307682169), (0.8116, 0.8073, 130, 85, 45, 0.0005715227), (0.8116, 0.8074, 130, 84, 45, 0.0007558903), (0.7996, 0.7914, None, 1933, 1857, 0.2231184778), (0.8073, 0.7996, None, 1857, 1786, 0.2461424520)]
    for hi, lo, cap, b, c, p in rows:
        got = paired.worst_case(spark, hi, lo, 9266, cap).head()
        assert (got.b, got.c) == (b, c) and math.isclose(got.p, p, rel_tol=1e-6)


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "a", 0.03), ("g", "b", 0.03)], "family string, row string, p double")
    got = {(r.family, r.row): round(r.p_holm, 9) for r in paired.holm(df, "family").collect()}
    assert got == {("f", "a"): 0.03, ("f", "b"): 0.06, ("f", "c"): 0.06, ("g", "a"): 0.06, ("g", "b"): 0.06}


def test_auroc_and_selective_with_ties(spark):
    rng = random.Random(2)
    rows = [(i, round(rng.random(), 1), rng.random() < 0.7) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id bigint, score double, ok boolean").withColumn("g", F.lit(1))
    pos, neg = [s for _, s, o in rows if not o], [s for _, s, o in rows if o]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(selective.auroc(df.withColumn("positive", ~F.col("ok")), ["g"]).head().auroc, want)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    hits = np.cumsum([o for _, _, o in order])
    k = np.arange(1, len(rows) + 1)
    m = selective.metrics(df, ["g"]).head()
    assert math.isclose(m.aurc, ((k - hits) / k).mean()) and math.isclose(m.accuracy_at_coverage, hits[399] / 400)
    good = k[hits * 10 >= k * 9]
    assert math.isclose(m.coverage_at_accuracy, (good.max() if len(good) else 0) / len(rows))


def test_auroc_of_one_class_and_equal_scores(spark):
    df = spark.createDataFrame([(1, 0.5, True), (1, 0.5, False), (2, 0.1, True), (2, 0.2, True)], "g int, score double, positive boolean")
    assert {r.g: r.auroc for r in selective.auroc(df, ["g"]).collect()} == {1: 0.5, 2: None}


def test_coverage_is_zero_if_never_accurate(spark):
    df = spark.createDataFrame([(1, i, float(i), o) for i, o in enumerate([False, True, True, False, True])], "g int, row_id bigint, score double, ok boolean")
    assert selective.metrics(df, ["g"]).head().coverage_at_accuracy == 0


def test_macro_f1_kinds(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 2)], "label int, pred int")
    cells = metrics.confusion(df, [])
    f = [2 / 3, 4 / 5, 1.0]
    assert math.isclose(metrics.macro_f1(cells, [], 9).head()[0], sum(f) / 9) and math.isclose(metrics.macro_f1(cells, []).head()[0], sum(f) / 3)
    assert math.isclose(metrics.balanced_accuracy(cells, []).head()[0], (0.5 + 1 + 1) / 3)


def test_reliability_lists_empty_bins(spark):
    df = spark.createDataFrame([(0, 0, [0.95, 0.05])], "label int, pred int, probs array<double>")
    rows = metrics.reliability(df, []).orderBy("bin").collect()
    assert [r.n for r in rows] == [0] * 14 + [1] and rows[0].accuracy is None and rows[14].accuracy == 1


def test_running_sums_equal_one_window(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), rng.choice([0.0, 1.0, rng.random()]), i, rng.randint(0, 5)) for i in range(700)]
    df = spark.createDataFrame(rows, "g int, s double, id bigint, v int")
    got = {r.id: r.t for r in ranking.running(df, ["g"], ["s", "id"], {"t": F.col("v")}).collect()}
    for g in (0, 1):
        total = 0
        for _, _, i, v in sorted(r for r in rows if r[0] == g):
            total += v
            assert got[i] == total


def test_exact_stream_is_numpy_s(spark):
    x = np.random.default_rng(0).random(101)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id bigint, x double")
    got = [r.x for r in resample.exact_stream(df, ["x"], 23, block=7).orderBy("rep").collect()]
    want = x[np.random.default_rng(42).integers(0, 101, (23, 101))].mean(axis=1)
    assert np.allclose(got, want)


def test_intervals_leave_nan_out(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(float("nan"),), (None,)], "v double")
    r = resample.interval(df, [], "v").head()
    assert (round(r.lo, 9), round(r.hi, 9)) == (2.5, 97.5)


def test_temperature_finds_the_scale(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(3000, 5)) * 2
    p = np.exp(z / 2) / np.exp(z / 2).sum(axis=1, keepdims=True)
    labels = [int(rng.choice(5, p=row)) for row in p]
    q = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    df = spark.createDataFrame([(a, b.tolist()) for a, b in zip(labels, q)], "label int, probs array<double>")
    got = temperature.fit(df)
    assert abs(got["temperature"] - 2) < 0.25 and got["converged"] and not got["at_bound"]
    assert temperature.fit(df.limit(0))["temperature"] == 1.0


def test_violations(spark):
    rows = [("val", 1, 0, 0, [0.7, 0.3]), ("val", 1, 0, 0, [0.7, 0.3]), ("test", 2, 9, 0, [0.7, 0.31]), ("other", 3, 1, 0, [0.2, 0.8]), ("test", 4, 1, 1, [None, 1.0])]
    df = spark.createDataFrame(rows, "split string, row_id bigint, label int, pred int, probs array<double>")
    got = {r.rule: r.n for r in contracts.violations(df, 2).collect()}
    assert got["repeated_key"] == 1 and got["label_range"] == 1 and got["split"] == 1 and got["row_sum"] == 2 and got["not_argmax"] == 1 and got["not_finite"] == 1
    with pytest.raises(contracts.ContractViolation):
        contracts.check(df, 2)
    assert all(r.n == 0 for r in contracts.violations(df.limit(0), 2).collect())


def test_numbers_as_printed(spark):
    r = one(spark, X.fixed(F.lit(0.125), 2), X.fixed(F.lit(-0.004), 2), X.fmt_pp(F.lit(-0.0043)), X.fmt_p(F.lit(0.04214)), X.fmt_p(F.lit(0.0004)), X.fmt_p(F.lit(0.09999)), X.fmt_p(F.lit(1.0)), X.fixed(F.lit(float("nan")), 2), X.fmt_ci(F.lit(0.1), F.lit(0.2)), X.fmt_int(F.lit(9266)), X.p_phrase(F.lit(0.0001)), X.fmt_p(F.lit(0.237)))
    assert list(r) == ["0.12", "0.00", "−0.43", "0.0421", "< 0.001", "0.100", "1.00", "n/a", "[0.1000, 0.2000]", "9,266", "p < 0.001", "0.237"]


def test_templates(spark):
    values = spark.createDataFrame([("A", "cost $1 \\ up"), ("B", "b"), ("C", "")], "key string, value string")
    df = spark.createDataFrame([("x ⟦A⟧ ⟦B: some text⟧ ⟦D⟧ ⟦C⟧",), ("⟦A: see ⟦B⟧",), (None,), ("plain",)], "text string")
    got = [r.filled for r in template.fill(df, values).collect()]
    assert got == ["x cost $1 \\ up b ⟦D⟧ ⟦C⟧", "⟦A: see b", None, "plain"]
    assert one(spark, template.leftovers(F.lit("⟦A: see b"))).c0 == "error" and one(spark, template.leftovers(F.lit("the ⟦...⟧"))).c0 == "warning"


def test_rules(spark):
    f = lambda *xs: [F.lit(x) for x in xs]
    r = one(spark, rules.lower_accuracy(*f(-0.01, 0.2)), rules.within_variance(*f(0.2, -0.1, 0.1)), rules.indistinguishable(*f(0.01, -0.1, 0.1)), rules.signal_value(*f(0.6, 0.55, 0.65, 0.8, 0.78, 0.82)), rules.signal_value(*f(0.5, 0.45, 0.55, 0.8, 0.78, 0.82)), rules.direction(*f(0.1, 0.2)), rules.significance(*f(0.03, 0.06)), rules.confidence_state(*f(0.70001, 0.70002)))
    assert list(r) == ["QUALIFIED", "SUPPORTED", "QUALIFIED", "QUALIFIED", "CONTRADICTED", "higher", "nominal only", "matched"]
    rep = spark.createDataFrame([(True, None), (None, True), (None, None)], "by_manifest boolean, by_computed boolean")
    assert rep.agg(rules.reproduced(rep)).head()[0] == "SUPPORTED"


def test_preparation(spark):
    df = spark.createDataFrame([(3, "a", " x "), (1, "a", "y"), (2, "b", None), (4, "b", " \t")], "ord bigint, k string, t string")
    assert sorted(r.ord for r in prep.first_wins(df, "k", "ord").collect()) == [1, 2]
    assert sorted(r.ord for r in prep.non_empty(df, ["t"]).collect()) == [1, 3]
    rows = spark.range(200).withColumn("s", (F.col("id") % 2).cast("string"))
    split = prep.stratified_split(rows, "s", "id").groupBy("s", "split").count().collect()
    assert {(r.s, r.split): r["count"] for r in split} == {(s, n): c for s in "01" for n, c in (("train", 70), ("val", 15), ("test", 15))}


def test_model_over_batches(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 2.0], 1)], "id bigint, v array<double>, label int")
    assert sorted((r.id, r.pred) for r in scorer.centroid_scores(df, scorer.centroids(df, "label", "v"), "id", "v").collect()) == [(1, 0), (2, 1)]
    assert scorer.apply_model(df, "id", "v", lambda x: x / x.sum(axis=1, keepdims=True)).count() == 2


def test_resampled_cells_are_a_bootstrap(spark):
    cells = spark.createDataFrame([(i, 1 + i % 5, i % 3) for i in range(12)], "c int, n bigint, block int")
    seen = {}
    for r in resample.resample_cells(cells, [], ["c"], lambda f, k: {"k": k.tolist()}, "k array<bigint>", 2000).collect():
        seen.setdefault(r.rep, {})[r.block] = r.k
    draws = np.array([[d[i % 3][i // 3] for i in range(12)] for _, d in sorted(seen.items())])
    n = np.array([1 + i % 5 for i in range(12)])
    assert draws.shape == (2000, 12) and (draws.sum(axis=1) == n.sum()).all()
    cov = np.diag(n) - np.outer(n, n) / n.sum()  # of the multinomial
    assert np.abs(draws.mean(axis=0) - n).max() < 0.2 and np.abs(np.cov(draws.T) - cov).max() < 0.5


def test_resampled_auroc_and_f1_are_the_reference_s(spark):
    rng = np.random.default_rng(5)
    score, ok, label = rng.integers(0, 40, 300) / 40, rng.random(300) < 0.6, rng.integers(0, 4, 300)
    a, b = (np.where(rng.random(300) < p, label, rng.integers(0, 4, 300)) for p in (0.5, 0.7))
    df = spark.createDataFrame([(float(s), bool(~o)) for s, o in zip(score, ok)], "score double, positive boolean").withColumn("g", F.lit("x"))
    preds = spark.createDataFrame([tuple(map(int, r)) for r in zip(label, a, b)], "label int, a int, b int")

    def auroc(i):
        up, down = score[i][~ok[i]], score[i][ok[i]]
        return ((up[:, None] > down) + 0.5 * (up[:, None] == down)).mean()

    def macro(y, p):
        return np.mean([2 * ((y == k) & (p == k)).sum() / max(1, (y == k).sum() + (p == k).sum()) for k in range(4)])

    drawn = rng.integers(0, 300, (2000, 300))
    for got, want in (
        (resample.interval(resample.auroc_resamples(df, ["g"], 2000, blocks=6), [], "auroc").head(), [auroc(i) for i in drawn]),
        (resample.interval(resample.paired_resamples(preds, [], 4, 2000), [], "d_macro_f1").head(), [macro(label[i], a[i]) - macro(label[i], b[i]) for i in drawn]),
        (resample.interval(resample.paired_resamples(preds, [], 4, 2000), [], "d_accuracy").head(), [(a == label)[i].mean() - (b == label)[i].mean() for i in drawn]),
    ):
        lo, hi = np.quantile(want, [0.025, 0.975])
        assert abs(got.lo - lo) < 0.1 * (hi - lo) and abs(got.hi - hi) < 0.1 * (hi - lo)


def test_verdicts_rest_on_the_reference_s_resamples(spark, sf_dir, monkeypatch):
    from uqframe.plans import registry

    seen = []
    for name in ("interval", "intervals"):
        own = getattr(resample, name)
        monkeypatch.setattr(resample, name, lambda df, *a, own=own: seen.append(df.select("rep").distinct().count()) or own(df, *a))
    rows = registry.queries()["claim_verdicts"](spark, sf_dir).collect()
    assert [r.claim for r in rows] == ["C1", "C2", "C3", "C4", "C5", "C6"] and seen == [2000, 2000]
    table = {r.row: r for r in registry.queries()["paired_table_ci"](spark, sf_dir).collect()}
    assert sorted(table) == ["R1", "R2", "R3", "R4", "R5", "S-cb"] and table["S-cb"].p_holm is None and table["R5"].p_holm is not None
    assert all(r.d_macro_f1_lo <= r.d_macro_f1 <= r.d_macro_f1_hi and r.d_accuracy_lo <= r.d_accuracy <= r.d_accuracy_hi for r in table.values())
    r5, r1 = table["R5"], table["R1"]
    verdict = {r.claim: r.verdict for r in rows}
    assert verdict["C2"] == ("CONTRADICTED" if r5.p < 0.05 or not r5.d_macro_f1_lo <= 0 <= r5.d_macro_f1_hi else "SUPPORTED")
    same, holds = r1.p_holm >= 0.05, r1.d_macro_f1_lo <= 0 <= r1.d_macro_f1_hi
    assert verdict["C3"] == ("SUPPORTED" if same and holds else "CONTRADICTED" if not same and not holds else "QUALIFIED")


def test_resampled_calibration_is_the_reference_s(spark):
    rng = np.random.default_rng(6)
    probs, label = rng.dirichlet([0.4, 0.4, 0.4], 300), rng.integers(0, 3, 300)
    conf, ok = probs.max(axis=1), (probs.argmax(axis=1) == label).astype(float)
    df = spark.createDataFrame([(i, int(label[i]), int(probs[i].argmax()), probs[i].tolist()) for i in range(300)], "row_id bigint, label int, pred int, probs array<double>")
    brier, nll = ((probs - np.eye(3)[label]) ** 2).sum(axis=1), -np.log(np.clip(probs[np.arange(300), label], 1e-12, 1))
    bins = sum((conf > i / 15).astype(int) for i in range(1, 15))
    drawn = rng.integers(0, 300, (2000, 300))
    want = {"accuracy": ok[drawn].mean(axis=1), "mean_confidence": conf[drawn].mean(axis=1), "brier": brier[drawn].mean(axis=1), "nll": nll[drawn].mean(axis=1)}
    want["ece"] = [np.abs(np.bincount(bins[i], (ok - conf)[i], minlength=15)).sum() / 300 for i in drawn]
    resampled = resample.calibration_resamples(df, [], 2000, blocks=5)
    assert resampled.count() == 2000
    got = resample.intervals(resampled, [], list(want)).head()
    for name, values in want.items():
        lo, hi = np.quantile(values, [0.025, 0.975])
        assert abs(got[f"{name}_lo"] - lo) < 0.1 * (hi - lo) and abs(got[f"{name}_hi"] - hi) < 0.1 * (hi - lo), name


def test_parts_of_the_stream_are_numpy_s(spark):
    for n in (2, 101, 3_000_000_000):  # the last one rejects three words of ten
        values, ok = resample.stream_words(42, 0, 4000, n)
        assert np.array_equal(np.concatenate([v[k] for v, k in (resample.stream_words(42, s, 500, n) for s in range(0, 4000, 500))]), values[ok])
        assert np.array_equal(values[ok], np.random.default_rng(42).integers(0, n, int(ok.sum())))


def test_exact_stream_has_no_most_and_keeps_rows_off_the_driver(spark, monkeypatch):
    def refuse(self):
        raise AssertionError("rows sent to the driver")

    monkeypatch.setattr(resample, "MOST_EXACT", 100, raising=False)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", refuse)
    for n, block in ((101, 64), (1, 64), (7, 1 << 20)):
        x = np.random.default_rng(0).random(n)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id bigint, x double")
        got = [r.x for r in resample.exact_stream(df, ["x"], 23, block=block).orderBy("rep").collect()]
        assert np.allclose(got, x[np.random.default_rng(42).integers(0, n, (23, n))].mean(axis=1))


def test_a_hot_stratum_is_ranked_by_many_tasks(spark):
    import hashlib

    rows = [(i, "a" if i % 10 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, s string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = prep.stratified_split(df, "s", "id")
        got = {r.id: r.split for r in split.collect()}
        sizes = [r[0] for r in split.rdd.mapPartitions(lambda rows: [(sum(1 for _ in rows),)]).collect()]
        assert max(sizes) < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s in ("a", None):
        own = sorted((i for i, t in rows if t == s), key=lambda i: hashlib.md5(f"42-{i}".encode()).hexdigest())
        want = {i: "train" if k < round(0.7 * len(own)) else "val" if k < round(0.85 * len(own)) else "test" for k, i in enumerate(own)}
        assert all(got[i] == v for i, v in want.items())
    assert len(got) == 4000


def test_bounds_raise_instead_of_dropping(spark, monkeypatch):
    values = spark.createDataFrame([(f"K{i}", "v") for i in range(6)], "key string, value string")
    rows = spark.createDataFrame([("⟦K1⟧ and ⟦K5⟧",)], "text string")
    assert template.fill(rows, values).head().filled == "v and v"
    monkeypatch.setattr(template, "MOST_VALUES", 5)
    with pytest.raises(Exception, match="more than 5 values"):
        template.fill(rows, values).collect()
    model = spark.createDataFrame([(i, [float(i == k) for k in range(3)]) for i in range(3)], "label int, centroid array<double>")
    df = spark.createDataFrame([(1, [0.0, 0.0, 1.0])], "id int, embedding array<double>")
    assert scorer.centroid_scores(df, model, "id").head().pred == 2
    monkeypatch.setattr(scorer, "MOST_CLASSES", 2)
    with pytest.raises(Exception, match="more than 2 classes"):
        scorer.centroid_scores(df, model, "id").collect()


def test_class_counts_have_all_classes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "split string, label int")
    got = metrics.class_counts(df, ["split"], spark.range(3).select(F.col("id").cast("int").alias("label")))
    assert sorted((r.split, r.label, r.n) for r in got.collect()) == [("a", 0, 0), ("a", 1, 2), ("a", 2, 0), ("b", 0, 1), ("b", 1, 0), ("b", 2, 0)]


def test_values_are_cleaned_of_all_line_ends_and_illegal_characters(spark):
    rows = [("A", "x \x85 y"), ("B", "x y"), ("C", "bad￾"), ("D", "ok")]
    got = {r.key: (r.s, r.v) for r in spark.createDataFrame(rows, "key string, value string").select("key", template.value_state(F.col("key"), F.col("value")).alias("s"), template.clean_value(F.col("value")).alias("v")).collect()}
    assert got["A"][1] == got["B"][1] == "x y" and got["C"][0] == "illegal character" and got["D"][0] == "ok"


def test_sentences_equal_python_s(spark):
    pattern = re.compile(r"(?<=[.!?])(?<!\bvs\.)(?<!\bal\.)(?<!e\.g\.)(?<!i\.e\.)(?<!\bcf\.)(?<!\bFig\.)\s+(?=[A-Z(\"“])")
    texts = ["One. Two! Three? (four) end", "A vs. B. See Fig. 3 et al. Next. (e.g. This)", "", "no end", 'He said. "Yes." So.']
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.sentences(F.col("t")).alias("s")).collect()}
    assert got == {t: pattern.split(t) for t in texts}


def test_readers_round_trip(spark, tmp_path):
    def gz(name, lines):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("\n".join(lines) + "\n")

    p = ["0.7", "0.2", "0.1"]
    gz("preds__imgA__t1__cb__argmax.csv.gz", ["split,row_id,label,pred,p0,p1,p2", ",".join(["test", "5", "0", "0", *p])])
    gz("preds__imgA__t1__cb__pgs.csv.gz", ["split,row_id,label,pred,p0,p1,p2,mi,pred_entropy,exp_entropy,prob_std,q0,q1,q2,pred_loglin", ",".join(["val", "6", "1", "0", *p, "0.1", "0.5", "0.4", "0.02", *p, "0"])])
    plain, pooled = (readers.read_predictions(spark, str(tmp_path), 3, mode).head() for mode in ("argmax", "pgs"))
    assert (plain.image, plain.text, plain.checkpoint, plain.mode, plain.row_id, plain.probs, plain.mi) == ("imgA", "t1", "cb", "argmax", 5, [0.7, 0.2, 0.1], None)
    assert (pooled.mode, pooled.split, pooled.mi, pooled.probs_loglin) == ("pgs", "val", 0.1, [0.7, 0.2, 0.1])
    with open(tmp_path / "split.csv", "w") as f:
        f.write('row_id,gambar,laporan,label,label_id\n1,a.png,"two ""lines"",\nhere",cat,3\n')
    assert tuple(readers.read_split(spark, str(tmp_path / "split.csv")).head()) == (1, "a.png", 'two "lines",\nhere', "cat", 3)
    (tmp_path / "manifest.json").write_text('{"files": [{"file": "x.csv.gz", "image": "imgA", "metrics": {"test": {"acc": 0.5}}, "reproduces_manuscript": true}]}')
    m = readers.read_manifest(spark, str(tmp_path / "manifest.json")).head()
    assert m.file == "x.csv.gz" and m.metrics["test"]["acc"] == 0.5 and m.reproduces_manuscript
    assert {r.path.rsplit("/", 1)[1] for r in readers.listing(spark, str(tmp_path), "*.csv.gz").collect()} == {"preds__imgA__t1__cb__argmax.csv.gz", "preds__imgA__t1__cb__pgs.csv.gz"}
    kept = readers.read_back(spark.createDataFrame([([0.6, 0.5], 0), ([0.2, 0.8], 0)], "probs array<double>, pred int")).head()
    assert kept.rows == 2 and kept.off == pytest.approx(0.1) and kept.not_argmax == 1


def test_the_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(cluster)


def test_ties_are_cut_by_the_next_column(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), 0.0 if rng.random() < 0.6 else rng.choice([0.5, 1.0, rng.random()]), i) for i in range(3000)] + [("a", None, 9999)]
    df = spark.createDataFrame(rows, "g string, x double, i int").repartition(4)
    out = ranking.running(df, ["g"], ["x", "i"], {"k": F.lit(1)}, ranges=16)
    got = {r.i: r.k for r in out.collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" in plan


def test_auroc_of_counted_resamples_is_that_of_drawn_rows(spark):
    reps, n = 3, 60
    rng = np.random.default_rng(4)
    rows = [(i, k, float(rng.integers(0, 9)) if k == "tied" else float(rng.random()), bool(rng.random() < 0.4)) for i in range(n) for k in ("tied", "own")]
    df = spark.createDataFrame(rows, "pos long, score_id string, score double, positive boolean")
    draws, counts = resample.hash_resamples(spark, n, reps), resample.hash_counts(spark, n, reps)
    drawn = {(r.rep, r.pos): r.cnt for r in draws.collect()}
    assert {(i, r.pos): c for r in counts.collect() for i, c in enumerate(r.cnt) if c} == drawn and sum(drawn.values()) == reps * n
    got = {(r.score_id, r.rep): r.auroc for r in resample.auroc_of_counts(df.join(counts, "pos"), ["score_id"], reps, rows=7).collect()}
    for k in ("tied", "own"):
        for rep in range(reps):
            own = [(s, p, drawn.get((rep, i), 0)) for i, name, s, p in rows if name == k]
            pairs = [(wa * wb, (a > b) + 0.5 * (a == b)) for a, p, wa in own if p for b, q, wb in own if not q]
            assert got[k, rep] == pytest.approx(sum(w * x for w, x in pairs) / sum(w for w, _ in pairs), abs=1e-12)
    one_class = df.withColumn("positive", F.lit(True)).join(counts, "pos")
    assert all(r.auroc is None for r in resample.auroc_of_counts(one_class, ["score_id"], reps).collect())


def test_temperature_losses_are_matrices(spark):
    p, label, grid = np.array([[0.7, 0.2, 0.1], [0.0, 1.0, 0.0]]), np.array([1, 0]), [0.5, 1.0, 2.0]
    logs = np.log(np.clip(p, 1e-12, 1))
    want = [np.log(np.exp(logs / t).sum(axis=1)) - logs[[0, 1], label] / t for t in grid]
    assert np.allclose(temperature.losses(p, label, grid), want)
    rows = [("a", p[0].tolist(), 1), ("a", p[1].tolist(), 0), ("a", None, 0), ("a", p[0].tolist(), 3), (None, [0.5, 0.5], 1), ("c", p[0].tolist(), None)]
    got = {(r.g, r.temperature): r.nll for r in temperature.grid_losses(spark.createDataFrame(rows, "g string, probs array<double>, label int"), grid, ["g"]).collect()}
    assert len(got) == 9 and all(abs(got["a", t] - w.mean()) < 1e-12 and abs(got[None, t] - np.log(2)) < 1e-12 and got["c", t] is None for t, w in zip(grid, want))


def test_groups_of_the_same_rows_share_one_draw(spark):
    rng = np.random.default_rng(8)
    probs = rng.dirichlet([1, 1, 1], 120)
    rows = [(g, i, int(i % 3), int(probs[i].argmax()), probs[i].tolist()) for g in ("x", "y") for i in range(120)] + [("z", i, 0, 0, [0.6, 0.2, 0.2]) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, row_id bigint, label int, pred int, probs array<double>")
    drawn = resample.calibration_resamples(df, ["g"], 50, blocks=3)
    assert "FlatMapGroupsInPandas [block" in drawn._jdf.queryExecution().toString()  # a task has all groups of a block
    got = {(r.g, r.rep): tuple(r)[2:] for r in drawn.collect()}
    assert len(got) == 150 and all(np.allclose(got["x", r], got["y", r]) for r in range(50)) and len({got["x", r] for r in range(50)}) > 40


def test_cells_of_few_rows_are_dealt_row_by_row():
    class Rows:
        """A generator that can draw rows only."""

        integers = np.random.default_rng(9).integers

    n = np.array([1.0, 2, 1, 3, 1])
    drawn = resample._deal(Rows(), np.full(20_000, 8), n)
    assert (drawn.sum(axis=1) == 8).all() and np.abs(drawn.mean(axis=0) - n).max() < 0.05


def test_auroc_by_ranges_of_scores(spark):
    rng = np.random.default_rng(10)
    score, up = np.r_[rng.integers(0, 5, 150) / 5, rng.random(150)], rng.random(300) < 0.3
    rows = [("a", float(s), bool(u)) for s, u in zip(score, up)] + [("b", 0.5, True), ("b", 0.5, False), ("b", None, False), ("c", 1.0, True)]
    df = spark.createDataFrame(rows, "g string, score double, positive boolean")
    cut = resample.ranges(df.where("g = 'a'"), ["g"], "score", 7)
    ends = cut.groupBy("block").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("block").collect()
    assert 4 <= len(ends) <= 8 and all(a.hi < b.lo for a, b in zip(ends, ends[1:])) and "lambda" not in cut._jdf.queryExecution().toString()
    want = ((score[up][:, None] > score[~up]) + 0.5 * (score[up][:, None] == score[~up])).mean()
    got = {r.g: r.auroc for r in selective.auroc(df, ["g"]).collect()}
    assert abs(got["a"] - want) < 1e-12 and got["b"] == 0.75 and got["c"] is None


def test_exact_quantiles_are_merged_in_no_single_task(spark, sf_dir):
    from uqframe.plans import registry

    rows = spark.range(60_001).select((F.xxhash64("id") % 100_003 / 7.0).alias("x")).unionByName(spark.createDataFrame([(None,)], "x double"))
    tied = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id") % 7).alias("x"))
    for df in (rows, tied, rows.limit(2), rows.where("x > 0").limit(1)):
        for q in (0.0, 0.005, 0.5, 0.77, 1.0):
            assert ranking.quantile(df, "x", q) == df.agg(F.percentile("x", F.lit(q))).head()[0]
    assert ranking.quantile(rows.where("false"), "x") is None
    for name in ("mi_summary", "mi_histogram"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"(percentile|median)\(", plan), plan


def test_exact_stream_draws_are_not_shuffled(spark):
    n = 1000
    x = np.random.default_rng(3).random((n, 2))
    x[7, 1] = np.nan
    df = spark.createDataFrame([(i, float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(x)], "row_id bigint, x double, y double").repartition(3)
    want = x[np.random.default_rng(42).integers(0, n, (30, n))].mean(axis=1)
    for held, draws in ((1 << 22, 1 << 28), (137, 5000), (999, 10**9)):
        got = resample.exact_stream(df, ["x", "y"], 30, block=512, held=held, draws=draws).orderBy("rep")
        assert "SortMergeJoin" not in got._jdf.queryExecution().optimizedPlan().toString() and "cnt" not in got._jdf.queryExecution().optimizedPlan().toString()
        rows = got.collect()
        assert [r.rep for r in rows] == list(range(30))
        assert np.allclose([r.x for r in rows], want[:, 0], atol=1e-12) and np.allclose([r.y for r in rows], want[:, 1], atol=1e-12, equal_nan=True) and np.isnan([r.y for r in rows]).any()
