"""The report's values under their contract's keys, and the decisions that its sentences rest on."""

from __future__ import annotations

from uqframe.functions import text as X
from uqframe.operators import draws, template
from uqframe.plans.analysis import _COMPARISONS, _NAMES, _SCORES, _named, _paired, _score_rows, paired
from uqframe.plans.base import F, S, V, Window, metrics, query, resample, rules, selective, sql, temperature, test_rows
from uqframe.plans.calibration import _GRID, _GRID_SQL
from uqframe.plans.preparation import _ROWS, _template
from uqframe.plans.shared_draws import _drawn_sql

_SCORE_IDS = [f"S{i}" for i in range(1, 7)]
#: Rows of the calibration table: checkpoint and mode of the deployed encoder; the last one is the served path after scaling.
_T5 = {"R1": ("cb", "argmax"), "R2": ("cb", "pgs"), "R3": ("pgs", "argmax"), "R4": ("pgs", "pgs")}


def required_keys() -> list[str]:
    """The contract's keys of numbers, by table, row and measure."""
    of = lambda table, rows, measures: [f"T{table}_R{r}_{m}" for r in range(1, rows + 1) for m in measures]
    t5, t6, t7 = of(5, 5, ("ACC", "CONF", "ECE", "BRIER", "NLL")), of(6, 5, ("DACC", "DF1", "BC", "P", "PHOLM")), of(7, 6, ("AUROC", "AURC", "ACC80", "COV90"))
    return [*t5, "T5_TEMP", *t6, *t7, "T1_ECE", "T1_ENC", "T1_AUROC"]


def _temperature(spark, sf_dir):
    """The temperature of the grid with the least validation loss of the served path."""
    return temperature.grid_losses(S.predictions(spark, sf_dir, (("imgA", "pgs", "argmax"),), "val"), _GRID).orderBy("nll", "temperature").first()["temperature"]


def _calibration(spark, sf_dir):
    """(temperature, row, measures, ece_lo, ece_hi) of the calibration table."""
    t = _temperature(spark, sf_dir)
    name = F.coalesce(*[F.when((F.col("checkpoint") == c) & (F.col("mode") == m), F.lit(r)) for r, (c, m) in _T5.items()])
    rows = test_rows(spark, sf_dir, tuple(("imgA", c, m) for c, m in _T5.values())).select(name.alias("row"), "row_id", "label", "pred", "probs")
    scaled = rows.where("row = 'R3'").withColumns({"row": F.lit("R5"), "probs": V.apply_temperature(F.col("probs"), t)})
    every = rows.union(scaled)
    ci = resample.intervals(draws.calibration(every, ["row"], S.CLASSES, measures=("ece",)), ["row"], ["ece"])
    return t, metrics.calibration(every, ["row"]).join(ci, "row")


def _differences(spark, sf_dir):
    """The paired table: d_accuracy, d_macro_f1, their intervals, b, c, p and p_holm of each row."""
    rows = _named(spark, sf_dir)
    pairs = [(a, b) for _, _, a, b in _COMPARISONS]
    name = F.coalesce(*[F.when((F.col("a") == x) & (F.col("b") == y), F.lit(r)) for r, _, x, y in _COMPARISONS])
    of = lambda drawn: draws.deltas(drawn, "system", pairs, ["accuracy", "macro_f1"]).select(name.alias("row"), F.col("accuracy").alias("d_accuracy"), F.col("macro_f1").alias("d_macro_f1"))
    whole = metrics.accuracy(rows, ["system"]).join(metrics.macro_f1(metrics.confusion(rows, ["system"]), ["system"], S.CLASSES), "system").withColumn("rep", F.lit(0))
    ci = resample.intervals(of(draws.calibration(rows, ["system"], S.CLASSES, measures=("accuracy", "macro_f1"))), ["row"], ["d_accuracy", "d_macro_f1"])
    tests = paired.holm(_paired(spark, sf_dir), "family").select("row", "b", "c", "p", "p_holm")
    return of(whole).join(ci, "row").join(tests, "row")


def _selective(spark, sf_dir):
    """score_id, auroc, auroc_lo, auroc_hi, aurc, accuracy_at_coverage, coverage_at_accuracy, n and errors of the scores."""
    rows = _score_rows(spark, sf_dir).withColumn("positive", ~F.col("ok"))
    ci = resample.intervals(draws.auroc(rows, ["score_id"]), ["score_id"], ["auroc"])
    return selective.auroc(rows, ["score_id"]).join(ci, "score_id").join(selective.metrics(rows, ["score_id"]), "score_id")


def _listed(df, prefix, row, values):
    entries = F.array(*[F.struct(F.concat(F.lit(f"{prefix}_"), row, F.lit(f"_{k}")).alias("key"), v.alias("value")) for k, v in values.items()])
    return df.select(F.explode(entries).alias("e")).select("e.*")


# the same in SQL
_END = "quantile_cont({0}, 0.025) AS {1}_lo, quantile_cont({0}, 0.975) AS {1}_hi"
_M = "replace(printf('%.4f', {0}), '-', '−')"
_CI = "'[' || replace(printf('{2}', {0}), '-', '−') || ', ' || replace(printf('{2}', {1}), '-', '−') || ']'"
_PP = "CASE WHEN printf('%.2f', abs(100e0 * {0})) = '0.00' THEN '0.00' WHEN {0} > 0 THEN '+' || printf('%.2f', 100e0 * {0}) ELSE '−' || printf('%.2f', -100e0 * {0}) END"
_PP_ONE = "CASE WHEN printf('%.2f', abs(100e0 * {0})) = '0.00' THEN '0.00' ELSE replace(printf('%.2f', 100e0 * {0}), '-', '−') END"
_P = "CASE WHEN {0} < 0.001 THEN '< 0.001' " + " ".join(f"WHEN {{0}} < {10.0 ** (e + 1)!r} THEN CASE WHEN round({{0}}, {2 - e}) >= {10.0 ** (e + 1)!r} THEN printf('%.{1 - e}f', {{0}}) ELSE printf('%.{2 - e}f', {{0}}) END" for e in (-3, -2, -1)) + " ELSE printf('%.2f', {0}) END"

_CAL_SQL = "WITH " + sql.frame((("imgA", "pgs", "argmax"),), "val").replace("preds AS", "vals AS") + f""", best AS (SELECT arg_min(temperature, nll) AS t FROM (SELECT temperature, avg(ln(list_sum(list_transform(lp, lambda x: exp((x - list_max(lp)) / temperature)))) + (list_max(lp) - lp[label + 1]) / temperature) AS nll
FROM (SELECT label, list_transform(probs, lambda x: ln(least(1e0, greatest(x, 1e-12)))) AS lp FROM vals), (SELECT unnest([{_GRID_SQL}]) AS temperature) GROUP BY temperature)), test AS (SELECT * FROM ({"WITH " + sql.frame(tuple(("imgA", c, m) for c, m in _T5.values()), "test")} SELECT * FROM preds)),
preds AS (SELECT CASE checkpoint || mode {" ".join(f"WHEN '{c}{m}' THEN '{r}'" for r, (c, m) in _T5.items())} END AS row, row_id, label, pred, probs FROM test
UNION ALL SELECT 'R5', row_id, label, pred, list_transform(ex, lambda x: x / list_sum(ex)) FROM (SELECT row_id, label, pred, list_transform(probs, lambda x: exp(ln(least(1e0, greatest(x, 1e-12))) / t)) AS ex FROM test, best WHERE checkpoint = 'pgs' AND mode = 'argmax')),
{sql.ROWS}, {draws.sql("(SELECT row_id FROM samples WHERE split = 'test')")}, {_drawn_sql("row")}, u AS (SELECT *, 1 AS cnt, 0 AS rep FROM rows_), p AS ({_drawn_sql("row", "u").removeprefix("s AS (").removesuffix(")").replace(" JOIN w USING (row_id)", "")}),
cal AS (SELECT p.*, i.* EXCLUDE (row) FROM p JOIN (SELECT row, {_END.format("ece", "ece")} FROM s GROUP BY row) i USING (row)) """
_DIFF_SQL = "WITH " + sql.frame(tuple(_NAMES.values()), "test") + ", " + sql.ROWS + ", " + draws.sql("(SELECT row_id FROM samples WHERE split = 'test')") + f""", nm(system, image, checkpoint, mode) AS (VALUES {", ".join(f"('{n}', '{i}', '{c}', '{m}')" for n, (i, c, m) in _NAMES.items())}),
cmp(row, family, x, y) AS (VALUES {", ".join(str(c) for c in _COMPARISONS)}), {_drawn_sql("image, checkpoint, mode")}, u AS (SELECT *, 1 AS cnt, 0 AS rep FROM rows_), p0 AS ({_drawn_sql("image, checkpoint, mode", "u").removeprefix("s AS (").removesuffix(")").replace(" JOIN w USING (row_id)", "")}),
n AS (SELECT system, s.* FROM s JOIN nm USING (image, checkpoint, mode)), n0 AS (SELECT system, p0.* FROM p0 JOIN nm USING (image, checkpoint, mode)),
i AS (SELECT row, {_END.format("a.accuracy - b.accuracy", "a")}, {_END.format("a.macro_f1 - b.macro_f1", "f")} FROM cmp JOIN n a ON a.system = x JOIN n b ON b.system = y AND b.rep = a.rep GROUP BY row),
o AS (SELECT system, row_id, ok = 1 AS ok FROM rows_ JOIN nm USING (image, checkpoint, mode)), bc AS (SELECT row, any_value(family) AS family, count_if(a.ok AND NOT b.ok)::BIGINT AS b, count_if(NOT a.ok AND b.ok)::BIGINT AS c FROM cmp JOIN o a ON a.system = x JOIN o b ON b.system = y AND b.row_id = a.row_id GROUP BY row),
pv AS (SELECT *, CASE WHEN b + c = 0 THEN 1e0 ELSE least(1e0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2e0))))) END AS p FROM bc),
hs AS (SELECT *, least(1e0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, row) + 1) * p) AS q FROM pv), hm AS (SELECT *, max(q) OVER (PARTITION BY family ORDER BY p, row) AS p_holm FROM hs),
diff AS (SELECT hm.row, b, c, p, p_holm, xa.accuracy - xb.accuracy AS da, xa.macro_f1 - xb.macro_f1 AS df, i.* EXCLUDE (row) FROM hm JOIN i USING (row) JOIN n0 xa ON xa.system = (SELECT x FROM cmp WHERE cmp.row = hm.row) JOIN n0 xb ON xb.system = (SELECT y FROM cmp WHERE cmp.row = hm.row)) """
_SEL_SQL = _SCORES + ", " + draws.sql("(SELECT row_id FROM samples WHERE split = 'test')") + f""", x AS (SELECT rep, score_id, score, sum(CASE WHEN ok THEN 0 ELSE cnt END) AS pos_, sum(CASE WHEN ok THEN cnt ELSE 0 END) AS neg_ FROM scores JOIN w USING (row_id) GROUP BY ALL),
y AS (SELECT *, sum(neg_) OVER (PARTITION BY rep, score_id ORDER BY score) - neg_ AS below FROM x), s AS (SELECT rep, score_id, sum(pos_ * (below + 0.5e0 * neg_)) / nullif(sum(pos_) * sum(neg_), 0)::DOUBLE AS v FROM y GROUP BY ALL),
g AS (SELECT score_id, score, count_if(NOT ok) AS pos_, count_if(ok) AS neg_ FROM scores GROUP BY ALL), h AS (SELECT *, sum(neg_) OVER (PARTITION BY score_id ORDER BY score) - neg_ AS below FROM g), p AS (SELECT score_id, sum(pos_ * (below + 0.5e0 * neg_)) / nullif(sum(pos_) * sum(neg_), 0)::DOUBLE AS auroc FROM h GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER z AS k, sum(ok::INT) OVER z AS hits, count(*) OVER (PARTITION BY score_id) AS n FROM scores WINDOW z AS (PARTITION BY score_id ORDER BY score, row_id)),
m AS (SELECT score_id, avg((k - hits) / k::DOUBLE) AS aurc, max(CASE WHEN k = greatest(1, least(n, round_even(0.8e0 * n, 0))) THEN hits / k::DOUBLE END) AS acc, coalesce(max(CASE WHEN hits * 10 >= k * 9 THEN k END), 0) / max(n)::DOUBLE AS cov, max(CASE WHEN k = n THEN hits / n::DOUBLE END) AS whole FROM ranked GROUP BY score_id),
sel AS (SELECT p.*, m.* EXCLUDE (score_id), i.* EXCLUDE (score_id) FROM p JOIN m USING (score_id) JOIN (SELECT score_id, {_END.format("v", "a")} FROM s GROUP BY score_id) i USING (score_id)) """


def _sql_listed(frame, prefix, row, values):
    return "SELECT unnest(k) AS key, unnest(v) AS value FROM (SELECT [" + ", ".join(f"'{prefix}_' || {row} || '_{k}'" for k in values) + "] AS k, [" + ", ".join(values.values()) + f"] AS v FROM {frame})"


_VALUES_SQL = "SELECT * FROM (" + _CAL_SQL + _sql_listed("cal", "T5", "row", {"ACC": _M.format("accuracy"), "CONF": _M.format("mean_confidence"), "ECE": _M.format("ece") + " || ' ' || " + _CI.format("ece_lo", "ece_hi", "%.4f"), "BRIER": _M.format("brier"), "NLL": _M.format("nll")}) + """
UNION ALL SELECT 'T5_TEMP', printf('%.2f', t) FROM best UNION ALL SELECT 'T1_ECE', max(CASE row WHEN 'R3' THEN printf('%.4f', ece) END) || ' vs. ' || max(CASE row WHEN 'R4' THEN printf('%.4f', ece) END) FROM cal)
UNION ALL SELECT * FROM (""" + _DIFF_SQL + _sql_listed("diff", "T6", "row", {
    "DACC": _PP.format("da") + " || ' [' || " + _PP_ONE.format("a_lo") + " || ', ' || " + _PP_ONE.format("a_hi") + " || ']'",
    "DF1": _PP.format("df") + " || ' [' || " + _PP_ONE.format("f_lo") + " || ', ' || " + _PP_ONE.format("f_hi") + " || ']'",
    "BC": "format('{:,}', b) || ' / ' || format('{:,}', c)", "P": _P.format("p"), "PHOLM": _P.format("p_holm"),
}) + " UNION ALL SELECT 'T1_ENC', 'Δmacro-F1 = ' || " + _PP.format("df") + " || ' pp; Holm-adjusted p ' || CASE WHEN p_holm < 0.001 THEN '' ELSE '= ' END || " + _P.format("p_holm") + """ FROM diff WHERE row = 'R1')
UNION ALL SELECT * FROM (""" + _SEL_SQL + _sql_listed("sel", "T7", "replace(score_id, 'S', 'R')", {"AUROC": _M.format("auroc") + " || ' ' || " + _CI.format("a_lo", "a_hi", "%.4f"), "AURC": "printf('%.2f', 100e0 * aurc)", "ACC80": _M.format("acc"), "COV90": "printf('%.3f', cov)"}) + """
UNION ALL SELECT 'T1_AUROC', max(CASE score_id WHEN 'S1' THEN printf('%.4f', auroc) END) || ' vs. ' || max(CASE score_id WHEN 'S5' THEN printf('%.4f', auroc) END) FROM sel)"""  # fmt: skip


@query(_VALUES_SQL)
def report_values(spark, sf_dir):
    """Every number of the report under its key, as printed."""
    t, cal = _calibration(spark, sf_dir)
    # a few rows each, dear to make and read by several entries: made once
    cal, diff, sel = cal.persist(), _differences(spark, sf_dir).persist(), _selective(spark, sf_dir).persist()
    col, m = F.col, X.fmt_metric
    t5 = _listed(cal, "T5", col("row"), {"ACC": m(col("accuracy")), "CONF": m(col("mean_confidence")), "ECE": X.fmt_metric_ci(col("ece"), col("ece_lo"), col("ece_hi")), "BRIER": m(col("brier")), "NLL": m(col("nll"))})
    change = lambda c: X.fmt_pp_ci(col(c), col(f"{c}_lo"), col(f"{c}_hi"))
    t6 = _listed(diff, "T6", col("row"), {"DACC": change("d_accuracy"), "DF1": change("d_macro_f1"), "BC": F.concat(X.fmt_int(col("b")), F.lit(" / "), X.fmt_int(col("c"))), "P": X.fmt_p(col("p")), "PHOLM": X.fmt_p(col("p_holm"))})
    t7 = _listed(sel, "T7", F.replace("score_id", F.lit("S"), F.lit("R")), {"AUROC": X.fmt_metric_ci(col("auroc"), col("auroc_lo"), col("auroc_hi")), "AURC": X.fmt_aurc(col("aurc")), "ACC80": m(col("accuracy_at_coverage")), "COV90": X.fmt_cov(col("coverage_at_accuracy"))})
    both = lambda df, by, a, b, c: F.concat(m(F.max(F.when(col(by) == a, col(c)))), F.lit(" vs. "), m(F.max(F.when(col(by) == b, col(c)))))
    lone = spark.range(1).select(F.lit("T5_TEMP").alias("key"), X.fmt_temp(F.lit(float(t))).alias("value"))
    one = cal.agg(both(cal, "row", "R3", "R4", "ece").alias("value")).select(F.lit("T1_ECE").alias("key"), "value")
    enc = diff.where("row = 'R1'").select(F.lit("T1_ENC").alias("key"), F.concat(F.lit("Δmacro-F1 = "), X.fmt_pp(col("d_macro_f1")), F.lit(" pp; "), X.p_phrase(col("p_holm"), "Holm-adjusted p")).alias("value"))
    auroc = sel.agg(both(sel, "score_id", "S1", "S5", "auroc").alias("value")).select(F.lit("T1_AUROC").alias("key"), "value")
    out = t5
    for more in (lone, t6, t7, one, enc, auroc):
        out = out.unionByName(more)
    return out


_DECISION = "SELECT '{0}' AS decision, {1} AS subject, {2} AS state"


@query("SELECT * FROM (" + _CAL_SQL + ", q AS (SELECT " + ", ".join(f"max(CASE row WHEN '{r}' THEN {c} END) AS {c}_{r}" for r in ("R3", "R4", "R5") for c in ("ece", "ece_lo", "ece_hi")) + """ FROM cal) SELECT 'averaging' AS decision, 'ece' AS subject, CASE WHEN ece_lo_R4 <= ece_hi_R3 AND ece_lo_R3 <= ece_hi_R4 THEN 'unchanged' WHEN ece_R4 < ece_R3 THEN 'improved' ELSE 'worsened' END AS state FROM q
UNION ALL SELECT 'scaling', 'ece', CASE WHEN printf('%.4f', ece_R5) = printf('%.4f', ece_R3) THEN 'leaves' WHEN ece_R5 > ece_R3 THEN 'raises' ELSE 'lowers' END FROM q) UNION ALL SELECT * FROM (""" + _SEL_SQL + """, o AS (SELECT *, row_number() OVER (ORDER BY auroc DESC, score_id) AS place FROM sel)
SELECT 'deferral', score_id, CASE WHEN printf('%.4f', acc) = printf('%.4f', whole) THEN 'leaves' WHEN acc > whole THEN 'raises' ELSE 'lowers' END FROM sel UNION ALL SELECT 'coverage', score_id, CASE WHEN cov <= 0 THEN 'none' WHEN cov >= 1 THEN 'full' ELSE 'partial' END FROM sel
UNION ALL SELECT 'chance', score_id, CASE WHEN a_hi < 0.5 THEN 'below' WHEN a_lo > 0.5 THEN 'above' ELSE 'includes' END FROM sel UNION ALL SELECT 'best', a.score_id, CASE WHEN a.a_lo <= b.a_hi AND b.a_lo <= a.a_hi THEN 'overlaps ' ELSE 'ahead of ' END || b.score_id FROM o a, o b WHERE a.place = 1 AND b.place = 2)""")
def report_decisions(spark, sf_dir):
    """What the report's sentences say, as states: calibration, deferral and coverage by each score, chance, the best score."""
    _, cal = _calibration(spark, sf_dir)
    sel, col = _selective(spark, sf_dir).persist(), F.col  # six rows, dear to make and read by two entries: made once
    at = cal.agg(*[F.max(F.when(col("row") == r, col(c))).alias(f"{c}_{r}") for r in ("R3", "R4", "R5") for c in ("ece", "ece_lo", "ece_hi")])
    row = lambda decision, subject, state: F.struct(F.lit(decision).alias("decision"), subject.alias("subject"), state.alias("state"))
    change = rules.calibration_change(*[col(f"{c}_{r}") for r in ("R4", "R3") for c in ("ece", "ece_lo", "ece_hi")])
    first = at.select(F.explode(F.array(row("averaging", F.lit("ece"), change), row("scaling", F.lit("ece"), rules.deferral_effect(col("ece_R5"), col("ece_R3"))))).alias("e"))
    whole = (col("n") - col("errors")) / col("n")
    each = sel.select(F.explode(F.array(row("deferral", col("score_id"), rules.deferral_effect(col("accuracy_at_coverage"), whole)), row("coverage", col("score_id"), rules.coverage_state(col("coverage_at_accuracy"))), row("chance", col("score_id"), rules.chance_state(col("auroc_lo"), col("auroc_hi"))))).alias("e"))
    order = Window.orderBy(F.desc("auroc"), "score_id")  # six scores
    after = lambda c: F.lead(c).over(order).alias(f"next_{c}")
    placed = sel.select("score_id", "auroc_lo", "auroc_hi", F.row_number().over(order).alias("place"), after("score_id"), after("auroc_lo"), after("auroc_hi")).where("place = 1")
    meets = resample.overlap(col("auroc_lo"), col("auroc_hi"), col("next_auroc_lo"), col("next_auroc_hi"))
    best = placed.select(row("best", col("score_id"), F.concat(F.when(meets, "overlaps ").otherwise("ahead of "), col("next_score_id"))).alias("e"))
    return first.union(each).union(best).select("e.*")


_ASKED = "c AS (SELECT DISTINCT 'K' || (n_nationkey % 30) AS key FROM nation)"


@query("WITH " + _ROWS + ", " + _ASKED + """, u AS (SELECT key, count(*) AS tokens FROM (SELECT unnest(regexp_extract_all(text, '⟦([A-Z0-9_]+)(?::[^⟦⟧]*)?⟧', 1)) AS key FROM t) GROUP BY key)
SELECT key, coalesce(tokens, 0) AS tokens, CASE WHEN tokens > 0 AND v.key IS NOT NULL THEN 'replaced' WHEN tokens > 0 THEN 'missing' WHEN v.key IS NOT NULL THEN 'unused' ELSE 'contract absent' END AS state FROM u FULL JOIN (SELECT DISTINCT key FROM v) v USING (key) FULL JOIN c USING (key)""")
def fill_report(spark, sf_dir):
    """Every key of texts, values and contract, and what a fill makes of it."""
    rows, values = _template(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("K"), (F.col("n_nationkey") % 30).cast("string")).alias("key"))
    return template.report(rows, values, asked)


_EXACT = "least(1e0, 2 * list_sum(list_transform(range(0, c + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2e0)))))"


@query("WITH " + sql.frame(tuple(_NAMES.values()), "test") + f""", nm(system, image, checkpoint, mode) AS (VALUES {", ".join(f"('{n}', '{i}', '{c}', '{m}')" for n, (i, c, m) in _NAMES.items())}), o AS (SELECT system, row_id, pred, pred = label AS ok FROM preds JOIN nm USING (image, checkpoint, mode)),
cmp(row, family, x, y) AS (VALUES {", ".join(str(c) for c in _COMPARISONS)}), d AS (SELECT row, count(*) AS n, round(avg(a.ok::INT), 4) AS aa, round(avg(b.ok::INT), 4) AS ab, count_if(a.pred <> b.pred)::BIGINT AS most FROM cmp JOIN o a ON a.system = x JOIN o b ON b.system = y AND b.row_id = a.row_id GROUP BY row),
v AS (SELECT row, n, greatest(aa, ab) AS hi, least(aa, ab) AS lo, CASE WHEN row IN ('R4', 'R5') THEN most END AS cap FROM d), kb AS (SELECT * FROM (SELECT v.*, unnest(range(0, n + 1)) AS kb FROM v) WHERE round(kb / n::DOUBLE, 4) = hi), kw AS (SELECT row, kw FROM (SELECT v.*, unnest(range(0, n + 1)) AS kw FROM v) WHERE round(kw / n::DOUBLE, 4) = lo), k AS (SELECT * FROM kb JOIN kw USING (row) WHERE kb > kw),
m AS (SELECT *, 2 * least(n - kb, n - kw - (kb - kw)) + (kb - kw) AS free FROM k), t AS (SELECT *, CASE WHEN cap IS NULL THEN free ELSE least(free, cap - (cap - (kb - kw)) % 2) END AS t FROM m), x AS (SELECT *, (t - (kb - kw)) // 2 AS c, (t - (kb - kw)) // 2 + (kb - kw) AS b FROM t WHERE t >= kb - kw), p AS (SELECT *, {_EXACT} AS p FROM x)
SELECT row, b::BIGINT AS b, c::BIGINT AS c, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY p DESC, kb, kw) AS place FROM p) WHERE place = 1""")
def worst_case_of_systems(spark, sf_dir):
    """The largest p that each comparison's printed accuracies allow; modes of one checkpoint may not differ more often than they do."""
    wide = paired.pivot_systems(_named(spark, sf_dir), list(_NAMES))
    right = lambda s: F.avg((F.col(f"{s}_pred") == F.col("label")).cast("double"))
    got = wide.agg(F.count(F.lit(1)).alias("n"), *[F.round(right(s), 4).alias(s) for s in _NAMES], *[F.count_if(F.col(f"{x}_pred") != F.col(f"{y}_pred")).alias(r) for r, _, x, y in _COMPARISONS])
    entry = lambda r, x, y: F.struct(F.lit(r).alias("row"), F.greatest(x, y).alias("better"), F.least(x, y).alias("worse"), (F.col(r) if r in ("R4", "R5") else F.lit(None).cast("bigint")).alias("most"))
    rows = got.select("n", F.explode(F.array(*[entry(r, x, y) for r, _, x, y in _COMPARISONS])).alias("e")).select("n", "e.*")
    return paired.worst_cases(rows, ["row"]).select("row", "b", "c", F.round("p", 6).alias("p"))


_VALUE = "CASE conv_id % 6 WHEN 0 THEN text WHEN 1 THEN '-' || turn || text WHEN 2 THEN text || chr(10216) || '⟦' WHEN 3 THEN ' ' || chr(9) || ' ' WHEN 4 THEN text || chr(1) END"


@query(rf"""WITH v AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN lower(role) ELSE upper(role) || '_' || conv_id END AS key, {_VALUE} AS value FROM conversations),
w AS (SELECT *, regexp_replace(regexp_replace(value, '\s*[\t\r\n]+\s*', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM v)
SELECT conv_id, turn, CASE WHEN NOT regexp_matches(key, '^[A-Z0-9_]+$') THEN 'bad key' WHEN value IS NULL THEN 'not a string' WHEN regexp_matches(value, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'illegal character' WHEN c = '' THEN 'empty' WHEN regexp_matches(c, '[⟦⟧]') THEN 'bracket' WHEN regexp_matches(c, '(^|[^\w.])-\d') THEN 'ascii minus' ELSE 'ok' END AS state FROM w""")
def value_states_of_texts(spark, sf_dir):
    """The first rule that values made of conversations break."""
    rows, k = spark.read.parquet(f"{sf_dir}/conversations.parquet"), F.col("conv_id") % 6
    value = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("-"), F.col("turn").cast("string"), F.col("text"))).when(k == 2, F.concat("text", F.lit("⟨⟦"))).when(k == 3, F.lit(" \t ")).when(k == 4, F.concat("text", F.lit("\x01")))
    key = F.when(F.col("conv_id") % 7 == 0, F.lower("role")).otherwise(F.concat(F.upper("role"), F.lit("_"), F.col("conv_id").cast("string")))
    return rows.select("conv_id", "turn", template.value_state(key, value).alias("state"))
