"""Intervals on draws that all systems, arms and scores share: 2,000 resamples in every query, and in its SQL."""

from __future__ import annotations

from uqframe.operators import draws
from uqframe.plans.analysis import _COMPARISONS, _NAMES, _SCORES, _SUPPLEMENT, _named, _score_rows
from uqframe.plans.base import F, POOLED, SERVED, SYS, TEST, S, V, metrics, query, resample, rounded, rules, selective, sql, temperature, test_rows
from uqframe.plans.calibration import _GRID, _GRID_SQL

_ENDS = "round(quantile_cont({0}, 0.025), 6) + 0e0 AS {1}lo, round(quantile_cont({0}, 0.975), 6) + 0e0 AS {1}hi"
_MEASURES = ("accuracy", "mean_confidence", "ece", "brier", "nll", "macro_f1")


def _ci(drawn, keys, values):
    return resample.intervals(drawn, keys, values)


_BINS = ", ".join(f"sum(CASE WHEN bin = {i} THEN cnt * (ok - conf) ELSE 0 END)" for i in range(V.BINS))
_OF = ", ".join("2e0 * sum(CASE WHEN pred = {0} AND label = {0} THEN cnt ELSE 0 END) / nullif(sum(CASE WHEN pred = {0} THEN cnt ELSE 0 END) + sum(CASE WHEN label = {0} THEN cnt ELSE 0 END), 0)".format(k) for k in range(S.CLASSES))


def _drawn_sql(keys: str, rows: str = "rows_") -> str:
    """CTE ``s``: the measures of each resample by ``keys``; needs ``rows_`` and ``w``."""
    return f"""s AS (SELECT {keys}, rep, sum(cnt * ok) / sum(cnt)::DOUBLE AS accuracy, sum(cnt * conf) / sum(cnt) AS mean_confidence, sum(cnt * brier) / sum(cnt) AS brier, sum(cnt * nll) / sum(cnt) AS nll,
list_sum(list_transform([{_BINS}], lambda x: abs(x))) / sum(cnt) AS ece, list_sum(list_transform([{_OF}], lambda x: coalesce(x, 0e0))) / {S.CLASSES} AS macro_f1 FROM {rows} JOIN w USING (row_id) GROUP BY {keys}, rep)"""


_W = ", " + draws.sql("(SELECT row_id FROM samples WHERE split = 'test')")


@query(TEST + _W + ", " + _drawn_sql("image, checkpoint, mode") + " SELECT image, checkpoint, mode, " + ", ".join(_ENDS.format(m, f"{m}_") for m in _MEASURES) + " FROM s GROUP BY image, checkpoint, mode")
def system_intervals(spark, sf_dir):
    """Intervals of all measures of every system, from one set of resamples."""
    return rounded(_ci(draws.calibration(test_rows(spark, sf_dir), SYS, S.CLASSES), SYS, list(_MEASURES)))


_PAIR_ROWS = ", cmp(row, x, y) AS (VALUES " + ", ".join(f"('{r}', '{x}', '{y}')" for r, _, x, y in (*_COMPARISONS, _SUPPLEMENT)) + "), nm(system, image, checkpoint, mode) AS (VALUES " + ", ".join(f"('{n}', '{i}', '{c}', '{m}')" for n, (i, c, m) in {**_NAMES, "F": ("imgA", "cb", "pgs")}.items()) + "), "


@query(TEST + _W + _PAIR_ROWS + _drawn_sql("image, checkpoint, mode") + ", n AS (SELECT system, s.* FROM s JOIN nm USING (image, checkpoint, mode)), d AS (SELECT row, a.accuracy - b.accuracy AS da, a.macro_f1 - b.macro_f1 AS df FROM cmp JOIN n a ON a.system = x JOIN n b ON b.system = y AND b.rep = a.rep) SELECT row, " + _ENDS.format("da", "d_accuracy_") + ", " + _ENDS.format("df", "d_macro_f1_") + " FROM d GROUP BY row")
def paired_intervals(spark, sf_dir):
    """Intervals of both differences of every comparison; all comparisons share their resamples, so they may be set against each other."""
    spec = (*_COMPARISONS, _SUPPLEMENT)
    drawn = draws.calibration(_named(spark, sf_dir, {**_NAMES, "F": ("imgA", "cb", "pgs")}), ["system"], S.CLASSES, measures=("accuracy", "macro_f1"))
    d = draws.deltas(drawn, "system", [(x, y) for _, _, x, y in spec], ["accuracy", "macro_f1"])
    named = F.coalesce(*[F.when((F.col("a") == x) & (F.col("b") == y), F.lit(r)) for r, _, x, y in spec])
    d = d.select(named.alias("row"), F.col("accuracy").alias("d_accuracy"), F.col("macro_f1").alias("d_macro_f1"))
    return rounded(_ci(d, ["row"], ["d_accuracy", "d_macro_f1"]))


#: Measures of the paired calibration, and its arms against the served predictions.
_CAL, _ARMS = ("ece", "brier", "nll"), ("pgs", "ts")


def _arms(spark, sf_dir):
    """Test predictions of the arms served, pgs and ts (served, at the validation loss's best temperature of the grid)."""
    best = temperature.grid_losses(S.predictions(spark, sf_dir, (SERVED,), "val"), _GRID).orderBy("nll", "temperature").first()["temperature"]
    rows = test_rows(spark, sf_dir, (SERVED, POOLED)).select(F.when(F.col("mode") == "pgs", "pgs").otherwise("served").alias("arm"), "row_id", "label", "pred", "probs")
    scaled = rows.where("arm = 'served'").withColumns({"arm": F.lit("ts"), "probs": V.apply_temperature(F.col("probs"), best)})
    return rows.union(scaled.withColumn("pred", V.argmax_lowest(F.col("probs"))))


_ARMS_SQL = "WITH " + sql.frame((SERVED,), "val").replace("preds AS", "vals AS") + f""", best AS (SELECT arg_min(temperature, nll) AS t FROM (SELECT temperature, avg(ln(list_sum(list_transform(lp, lambda x: exp((x - list_max(lp)) / temperature)))) + (list_max(lp) - lp[label + 1]) / temperature) AS nll
FROM (SELECT label, list_transform(probs, lambda x: ln(least(1e0, greatest(x, 1e-12)))) AS lp FROM vals), (SELECT unnest([{_GRID_SQL}]) AS temperature) GROUP BY temperature)), test AS (SELECT * FROM ({"WITH " + sql.frame((SERVED, POOLED), "test")} SELECT * FROM preds)),
e AS (SELECT row_id, label, list_transform(probs, lambda x: exp(ln(least(1e0, greatest(x, 1e-12))) / t)) AS ex FROM test, best WHERE mode = 'argmax'), ts AS (SELECT 'ts' AS arm, row_id, label, list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM e),
preds AS (SELECT CASE mode WHEN 'pgs' THEN 'pgs' ELSE 'served' END AS arm, row_id, label, pred, probs FROM test UNION ALL SELECT arm, row_id, label, (list_position(probs, list_max(probs)) - 1)::INT, probs FROM ts), """ + sql.ROWS
_POINT = f", p AS (SELECT arm, avg(brier) AS brier, avg(nll) AS nll, list_sum(list_transform([{_BINS.replace('cnt * ', '')}], lambda x: abs(x))) / count(*) AS ece FROM rows_ GROUP BY arm)"


@query(_ARMS_SQL + _W + _POINT + ", " + _drawn_sql("arm") + ", d AS (" + " UNION ALL ".join(f"SELECT o.arm, '{m}' AS metric, o.{m} - v.{m} AS v, po.{m} - pv.{m} AS delta FROM s o JOIN s v USING (rep) JOIN p po ON po.arm = o.arm JOIN p pv ON pv.arm = 'served' WHERE v.arm = 'served' AND o.arm <> 'served'" for m in _CAL) + "), i AS (SELECT arm, metric, round(any_value(delta), 6) + 0e0 AS delta, " + _ENDS.format("v", "") + " FROM d GROUP BY arm, metric) SELECT *, CASE WHEN lo > 0 THEN 'higher' WHEN hi < 0 THEN 'lower' ELSE 'unchanged' END AS direction FROM i")
def paired_calibration_ci(spark, sf_dir):
    """Calibration of the averaged and the temperature-scaled arm less the served one, with intervals of the differences."""
    rows = _arms(spark, sf_dir)
    pairs = [(a, "served") for a in _ARMS]
    split = lambda df: df.select("a", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in _CAL])).alias("e")).select(F.col("a").alias("arm"), "e.*")
    ci = resample.interval(split(draws.deltas(draws.calibration(rows, ["arm"], S.CLASSES, measures=_CAL), "arm", pairs, list(_CAL))), ["arm", "metric"], "v")
    point = split(draws.deltas(metrics.calibration(rows, ["arm"]).withColumn("rep", F.lit(0)), "arm", pairs, list(_CAL)))
    out = rounded(point.withColumnRenamed("v", "delta").join(ci, ["arm", "metric"]))
    return out.withColumn("direction", rules.direction(F.col("lo"), F.col("hi")))


#: Pairs of scores whose AUROCs are compared.
_SCORE_PAIRS = (("S5", "S1"), ("S5", "S2"), ("S2", "S1"))
_AUROCS = _SCORES + _W + """, x AS (SELECT rep, score_id, score, sum(CASE WHEN ok THEN 0 ELSE cnt END) AS pos_, sum(CASE WHEN ok THEN cnt ELSE 0 END) AS neg_ FROM scores JOIN w USING (row_id) WHERE score_id IN ('S1', 'S2', 'S5') GROUP BY ALL),
y AS (SELECT *, sum(neg_) OVER (PARTITION BY rep, score_id ORDER BY score) - neg_ AS below FROM x), s AS (SELECT rep, score_id, sum(pos_ * (below + 0.5e0 * neg_)) / nullif(sum(pos_) * sum(neg_), 0)::DOUBLE AS v FROM y GROUP BY ALL),
g AS (SELECT score_id, score, count_if(NOT ok) AS pos_, count_if(ok) AS neg_ FROM scores GROUP BY ALL), h AS (SELECT *, sum(neg_) OVER (PARTITION BY score_id ORDER BY score) - neg_ AS below FROM g), p AS (SELECT score_id, sum(pos_ * (below + 0.5e0 * neg_)) / nullif(sum(pos_) * sum(neg_), 0)::DOUBLE AS v FROM h GROUP BY ALL),
c AS (SELECT score_id, """ + _ENDS.format("v", "") + " FROM s GROUP BY score_id), pairs(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SCORE_PAIRS) + """),
d AS (SELECT a, b, round(any_value(pa.v - pb.v), 6) AS d_auroc, """ + _ENDS.format("x.v - y.v", "") + " FROM pairs JOIN s x ON x.score_id = a JOIN s y ON y.score_id = b AND y.rep = x.rep JOIN p pa ON pa.score_id = a JOIN p pb ON pb.score_id = b GROUP BY a, b) "


def _aurocs(spark, sf_dir):
    """(point AUROCs, AUROCs of the resamples) of the compared scores."""
    rows = _score_rows(spark, sf_dir).where(F.col("score_id").isin(*dict.fromkeys(s for p in _SCORE_PAIRS for s in p))).withColumn("positive", ~F.col("ok"))
    return selective.auroc(rows, ["score_id"]), draws.auroc(rows, ["score_id"])


def _auroc_deltas(point, drawn):
    d = draws.deltas(point.withColumn("rep", F.lit(0)), "score_id", list(_SCORE_PAIRS), ["auroc"]).select("a", "b", F.col("auroc").alias("d_auroc"))
    return rounded(d.join(resample.interval(draws.deltas(drawn, "score_id", list(_SCORE_PAIRS), ["auroc"]), ["a", "b"], "auroc"), ["a", "b"]))


@query(_AUROCS + "SELECT * FROM d")
def paired_auroc_ci(spark, sf_dir):
    """Differences of the AUROCs of three pairs of scores, in the same resamples."""
    return _auroc_deltas(*_aurocs(spark, sf_dir))


@query(_AUROCS + ", o AS (SELECT bool_or(x.lo <= y.hi AND y.lo <= x.hi) AS overlap, bool_or(px.v < py.v) AS less FROM c x, c y, p px, p py WHERE x.score_id = 'S5' AND px.score_id = 'S5' AND y.score_id = 'S1' AND py.score_id = 'S1') SELECT overlap, lo > 0 OR hi < 0 AS paired_excludes_zero, (CASE WHEN NOT overlap THEN CASE WHEN less THEN -1 ELSE 1 END WHEN lo > 0 OR hi < 0 THEN CASE WHEN d_auroc < 0 THEN -1 ELSE 1 END ELSE 0 END)::INT AS sign, d_auroc, lo, hi FROM o, d WHERE a = 'S5' AND b = 'S1'")
def mi_vs_served(spark, sf_dir):
    """How mutual information compares with the served confidence: their own intervals first, else the paired difference."""
    point, drawn = _aurocs(spark, sf_dir)
    drawn = drawn.persist()
    own = rounded(resample.interval(drawn, ["score_id"], "auroc")).join(point, "score_id")
    at = own.agg(*[F.max(F.when(F.col("score_id") == s, F.col(c))).alias(f"{c}_{s}") for s in ("S1", "S5") for c in ("auroc", "lo", "hi")])
    d = _auroc_deltas(point, drawn).where("a = 'S5' and b = 'S1'").join(F.broadcast(at))
    overlap = resample.overlap(F.col("lo_S5"), F.col("hi_S5"), F.col("lo_S1"), F.col("hi_S1"))
    excludes = resample.excludes_zero(F.col("lo"), F.col("hi"))
    return d.select(overlap.alias("overlap"), excludes.alias("paired_excludes_zero"), rules.signal_sign(overlap, F.col("auroc_S5") < F.col("auroc_S1"), excludes, F.col("d_auroc")).alias("sign"), "d_auroc", "lo", "hi")


_MEDIAN = TEST + _W + ", t AS (SELECT image, checkpoint, mode, rep, round(nll, 12) AS nll, cnt FROM rows_ JOIN w USING (row_id) WHERE checkpoint = 'pgs'), r AS (SELECT *, sum(cnt) OVER (PARTITION BY image, checkpoint, mode, rep ORDER BY nll) AS upto, sum(cnt) OVER (PARTITION BY image, checkpoint, mode, rep) AS n FROM t), q AS (SELECT image, checkpoint, mode, rep, min(nll) AS v FROM r WHERE upto >= 0.5e0 * n GROUP BY ALL) SELECT image, checkpoint, mode, " + _ENDS.format("v", "") + " FROM q GROUP BY ALL"


@query(_MEDIAN)
def boot_median_nll_ci(spark, sf_dir):
    """Interval of the median loss: a statistic of a resample that is no sum of rows."""
    rows = test_rows(spark, sf_dir).where("checkpoint = 'pgs'").select(*SYS, "row_id", F.round(V.nll(F.col("probs"), F.col("label")), 12).alias("nll"))
    return rounded(resample.interval(draws.quantile(rows, SYS, "nll"), SYS, "quantile"))
