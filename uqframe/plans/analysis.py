"""Selective prediction, paired tests, resampling, validation queries."""

from __future__ import annotations

from uqframe.plans.base import F, PAIR, POOLED, SERVED, SYS, TEST, S, V, Window, X, contracts, metrics, paired, prep, query, r6, ranking, resample, rounded, rules, selective, sql, table, temperature, test_rows
from uqframe.sources import shared

#: Resamples of the queries that have SQL, as it says.
REPS = 20
#: Resamples behind the verdicts, as many as the reference draws.
VERDICT_REPS = 2_000
_NAMES = {"A": SERVED, "B": POOLED, "C": ("imgB", "pgs", "pgs"), "D": ("imgC", "pgs", "pgs"), "E": ("imgA", "cb", "argmax")}


def _score_rows(spark, sf_dir):
    """The scores of both systems, kept once a session: ranking reads them several times."""

    def make():
        df = test_rows(spark, sf_dir, (SERVED, POOLED))
        return selective.scores_long(df.where("mode = 'argmax'"), df.where("mode = 'pgs'"))

    return shared.kept(spark, "scores", sf_dir, make, ["score_id"]).select("row_id", "score_id", "score", "ok")


def _named(spark, sf_dir, names=_NAMES):
    df = test_rows(spark, sf_dir, tuple(names.values()))
    name = F.coalesce(*[F.when((F.col("image") == i) & (F.col("checkpoint") == c) & (F.col("mode") == m), F.lit(n)) for n, (i, c, m) in names.items()])
    return df.withColumn("system", name)


_SCORES = PAIR + """, u AS (SELECT a.row_id, a.ok = 1 AS ok_a, b.ok = 1 AS ok_b, a.conf AS ca, b.conf AS cb, b.pred_entropy AS pe, b.exp_entropy AS ee, b.mi AS mi, b.prob_std AS sd FROM rows_ a JOIN rows_ b USING (row_id) WHERE a.mode = 'argmax' AND b.mode = 'pgs'),
scores AS (SELECT row_id, 'S1' AS score_id, round(1 - ca, 12) AS score, ok_a AS ok FROM u UNION ALL SELECT row_id, 'S2', round(1 - cb, 12), ok_b FROM u UNION ALL SELECT row_id, 'S3', round(pe, 12), ok_b FROM u UNION ALL SELECT row_id, 'S4', round(ee, 12), ok_b FROM u UNION ALL SELECT row_id, 'S5', round(mi, 12), ok_b FROM u UNION ALL SELECT row_id, 'S6', round(sd, 12), ok_b FROM u) """
_RANKED = _SCORES + ", ranked AS (SELECT *, row_number() OVER w AS k, sum(ok::INT) OVER w AS hits, count(*) OVER (PARTITION BY score_id) AS n FROM scores WINDOW w AS (PARTITION BY score_id ORDER BY score, row_id)) "
_AUROC = "(sum(CASE WHEN NOT ok THEN r END) - sum((NOT ok)::INT) * (sum((NOT ok)::INT) + 1) / 2e0) / (sum((NOT ok)::INT) * sum(ok::INT))::DOUBLE"
_MIDRANK = ", mid AS (SELECT *, (rank() OVER (PARTITION BY score_id ORDER BY score) + (count(*) OVER (PARTITION BY score_id, score) - 1) / 2e0) AS r FROM scores) "


@query(_SCORES + "SELECT score_id, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN ok THEN score END), 6) AS mean_right, round(avg(CASE WHEN NOT ok THEN score END), 6) AS mean_wrong, count_if(NOT ok)::BIGINT AS errors FROM scores GROUP BY score_id")
def uncertainty_scores_long(spark, sf_dir):
    s = _score_rows(spark, sf_dir)
    return rounded(s.groupBy("score_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.when(F.col("ok"), F.col("score"))).alias("mean_right"), F.avg(F.when(~F.col("ok"), F.col("score"))).alias("mean_wrong"), F.count_if(~F.col("ok")).alias("errors")))


def _auroc(spark, sf_dir, scores=("S1", "S2", "S3", "S4", "S5", "S6")):
    return selective.auroc(_score_rows(spark, sf_dir).where(F.col("score_id").isin(*scores)).withColumn("positive", ~F.col("ok")), ["score_id"])


@query(_SCORES + _MIDRANK + f"SELECT score_id, round({_AUROC}, 6) AS auroc FROM mid GROUP BY score_id")
def auroc_by_score(spark, sf_dir):
    return rounded(_auroc(spark, sf_dir))


@query("SELECT l_returnflag, round((sum(CASE WHEN p THEN r END) - sum(p::INT) * (sum(p::INT) + 1) / 2e0) / (sum(p::INT) * sum((NOT p)::INT))::DOUBLE, 6) AS auroc FROM (SELECT l_returnflag, l_quantity > 25 AS p, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2e0 AS r FROM lineitem) GROUP BY l_returnflag")
def auroc_tied_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_discount").alias("score"), (F.col("l_quantity") > 25).alias("positive"))
    return rounded(selective.auroc(rows, ["l_returnflag"]))


_SELECTIVE = "round(avg((k - hits) / k::DOUBLE), 6) AS aurc, round(max(CASE WHEN k = greatest(1, least(n, round_even(0.8e0 * n, 0))) THEN hits / k::DOUBLE END), 6) AS accuracy_at_coverage, round(coalesce(max(CASE WHEN hits * 10 >= k * 9 THEN k END), 0) / max(n)::DOUBLE, 6) AS coverage_at_accuracy"


@query(_RANKED + f"SELECT score_id, max(n) AS n, count_if(NOT ok)::BIGINT AS errors, {_SELECTIVE} FROM ranked GROUP BY score_id")
def aurc_by_score(spark, sf_dir):
    return rounded(selective.metrics(_score_rows(spark, sf_dir), ["score_id"]))


@query(_RANKED + "SELECT score_id, round(max(CASE WHEN k = greatest(1, least(n, round_even(0.8e0 * n, 0))) THEN hits / k::DOUBLE END), 6) AS accuracy_at_coverage FROM ranked GROUP BY score_id")
def acc_at_coverage(spark, sf_dir):
    return rounded(selective.metrics(_score_rows(spark, sf_dir), ["score_id"]).select("score_id", "accuracy_at_coverage"))


@query(_RANKED + "SELECT score_id, round(coalesce(max(CASE WHEN hits * 10 >= k * 9 THEN k END), 0) / max(n)::DOUBLE, 6) AS coverage_at_accuracy FROM ranked GROUP BY score_id")
def coverage_at_accuracy(spark, sf_dir):
    return rounded(selective.metrics(_score_rows(spark, sf_dir), ["score_id"]).select("score_id", "coverage_at_accuracy"))


@query(_RANKED + ", g AS (SELECT unnest(range(1, 101))::INT AS step) SELECT score_id, step, k, round(hits / k::DOUBLE, 6) AS accuracy FROM ranked JOIN g ON k = greatest(1, least(n, round_even(step / 100e0 * n, 0)))")
def selective_curve_grid(spark, sf_dir):
    return rounded(selective.curve(_score_rows(spark, sf_dir), ["score_id"]))


@query(_SCORES + ", t AS (SELECT score_id, count(*) AS n, sum(ok::INT) AS good FROM scores GROUP BY score_id), g AS (SELECT unnest(range(1, 101))::INT AS step), x AS (SELECT *, greatest(1, least(n, round_even(step / 100e0 * n, 0)))::BIGINT AS k FROM t, g) SELECT score_id, step, k, round(least(k, good) / k::DOUBLE, 6) AS accuracy FROM x")
def oracle_curve(spark, sf_dir):
    return rounded(selective.oracle_curve(_score_rows(spark, sf_dir), ["score_id"]))


@query(_SCORES + _MIDRANK + f", a AS (SELECT score_id, round({_AUROC}, 6) AS auroc FROM mid GROUP BY score_id) SELECT score_id, auroc, place::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY auroc DESC, score_id) AS place FROM a WHERE auroc IS NOT NULL) WHERE place <= 2")
def best_two_scores(spark, sf_dir):
    a = rounded(_auroc(spark, sf_dir)).where("auroc is not null").orderBy(F.desc("auroc"), "score_id").limit(2)
    return a.select("score_id", "auroc", F.row_number().over(Window.orderBy(F.desc("auroc"), "score_id")).alias("place"))


@query(_SCORES + ", p AS (SELECT ok, score FROM scores WHERE score_id = 'S5'), f AS (SELECT pow(10, floor(log10(quantile_cont(score, 0.005)))) AS floor_, max(score) AS hi FROM p WHERE score > 0), b AS (SELECT ok, least(38, greatest(0, floor(39 * ln(greatest(score, floor_) / floor_) / ln(hi / floor_))))::INT AS bin FROM p, f) SELECT ok, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY ok)::DOUBLE, 6) AS weight FROM b GROUP BY ok, bin")
def mi_histogram(spark, sf_dir):
    p = _score_rows(spark, sf_dir).where("score_id = 'S5'").select("ok", "score")
    positive = p.where("score > 0")
    low = F.lit(ranking.quantile(positive, "score", 0.005)).cast("double")
    f = positive.agg(F.pow(F.lit(10.0), F.floor(F.log10(low))).alias("floor_"), F.max("score").alias("hi"))
    at = F.floor(39 * F.ln(F.greatest("score", "floor_") / F.col("floor_")) / F.ln(F.col("hi") / F.col("floor_")))
    b = p.join(F.broadcast(f)).select("ok", F.least(F.lit(38), F.greatest(F.lit(0), at)).cast("int").alias("bin"))
    n = b.groupBy("ok", "bin").agg(F.count(F.lit(1)).alias("n"))
    return n.select("ok", "bin", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy("ok"))).alias("weight"))


@query(_SCORES + "SELECT count_if(score = 0)::BIGINT AS zeros, round(min(CASE WHEN score > 0 THEN score END), 6) AS least_positive, round(median(CASE WHEN ok THEN score END), 6) AS median_right, round(median(CASE WHEN NOT ok THEN score END), 6) AS median_wrong, round(avg(score), 6) AS mean FROM scores WHERE score_id = 'S5'")
def mi_summary(spark, sf_dir):
    p = _score_rows(spark, sf_dir).where("score_id = 'S5'")
    medians = {"median_right": ranking.quantile(p.where("ok"), "score"), "median_wrong": ranking.quantile(p.where("not ok"), "score")}
    return rounded(p.agg(F.count_if(F.col("score") == 0).alias("zeros"), F.min(F.when(F.col("score") > 0, F.col("score"))).alias("least_positive"), *[F.lit(m).cast("double").alias(n) for n, m in medians.items()], F.avg("score").alias("mean")))


_WIDE = "WITH " + sql.frame(tuple(_NAMES.values()), "test") + ", w AS (SELECT row_id, max(label) AS label, " + ", ".join(f"max(CASE WHEN image = '{i}' AND checkpoint = '{c}' AND mode = '{m}' THEN pred END) AS {n}" for n, (i, c, m) in _NAMES.items()) + " FROM preds GROUP BY row_id), cmp(row, family, x, y) AS (VALUES ('R1', 'encoders', 'B', 'C'), ('R2', 'encoders', 'B', 'D'), ('R3', 'encoders', 'C', 'D'), ('R4', 'modes', 'B', 'A'), ('R5', 'modes', 'B', 'E')), l AS (" + " UNION ALL ".join(f"SELECT row_id, '{n}' AS s, {n} = label AS ok, {n} AS pred FROM w" for n in _NAMES) + "), d AS (SELECT row, family, count_if(a.ok AND NOT b.ok)::BIGINT AS b, count_if(NOT a.ok AND b.ok)::BIGINT AS c, round(avg(a.ok::INT) - avg(b.ok::INT), 6) + 0e0 AS d_accuracy, count_if(a.pred <> b.pred)::BIGINT AS differ FROM cmp JOIN l a ON a.s = x JOIN l b ON b.s = y AND b.row_id = a.row_id GROUP BY row, family), p AS (SELECT *, CASE WHEN b + c = 0 THEN 1e0 ELSE least(1e0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2e0))))) END AS p FROM d) "

_COMPARISONS = (("R1", "encoders", "B", "C"), ("R2", "encoders", "B", "D"), ("R3", "encoders", "C", "D"), ("R4", "modes", "B", "A"), ("R5", "modes", "B", "E"))


def _paired(spark, sf_dir):
    wide = paired.pivot_systems(_named(spark, sf_dir), list(_NAMES))
    ok = {n: F.col(f"{n}_pred") == F.col("label") for n in _NAMES}
    entries = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(f).alias("family"), ok[a].alias("a"), ok[b].alias("b"), (F.col(f"{a}_pred") != F.col(f"{b}_pred")).alias("x")) for r, f, a, b in _COMPARISONS])
    long = wide.select(F.explode(entries).alias("e")).select("e.*")
    d = long.groupBy("row", "family").agg(*paired.discordant(F.col("a"), F.col("b")), F.avg(F.col("a").cast("double")).alias("aa"), F.avg(F.col("b").cast("double")).alias("ab"), F.count_if(F.col("x")).alias("differ"))
    return d.select("row", "family", "b", "c", (F.col("aa") - F.col("ab")).alias("d_accuracy"), "differ", paired.mcnemar_exact(F.col("b"), F.col("c")).alias("p"))


@query(_WIDE + "SELECT row, b, c FROM d")
def discordant_counts(spark, sf_dir):
    return _paired(spark, sf_dir).select("row", "b", "c")


@query(_WIDE + "SELECT row, round(p, 6) AS p FROM p")
def mcnemar_exact(spark, sf_dir):
    return rounded(_paired(spark, sf_dir).select("row", "p"))


_HOLM = ", s AS (SELECT *, least(1e0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, row) + 1) * p) AS q FROM p) SELECT row, family, {} round(p, 6) AS p, round(max(q) OVER (PARTITION BY family ORDER BY p, row), 6) AS p_holm FROM s"


@query(_WIDE + _HOLM.format(""))
def holm_families(spark, sf_dir):
    return rounded(paired.holm(_paired(spark, sf_dir), "family").select("row", "family", "p", "p_holm"))


@query(_WIDE + "SELECT row, differ FROM d")
def top1_disagreements(spark, sf_dir):
    return _paired(spark, sf_dir).select("row", "differ")


@query(_WIDE + _HOLM.format("b, c, d_accuracy,"))
def paired_table(spark, sf_dir):
    return rounded(paired.holm(_paired(spark, sf_dir), "family").select("row", "family", "b", "c", "d_accuracy", "p", "p_holm"))


#: Printed accuracies of the published comparisons, and the bound on disagreements where one is printed.
PUBLISHED = ((0.8074, 0.7874, None), (0.8073, 0.7874, None), (0.7996, 0.7850, None), (0.8074, 0.6238, None), (0.8116, 0.8073, 130), (0.8116, 0.8074, 130), (0.7996, 0.7914, None), (0.8073, 0.7996, None))
PUBLISHED_N = 9266

_WORST = f"""WITH v(row, hi, lo, cap) AS (VALUES {", ".join(f"({i}, {h}e0, {w}e0, {'NULL' if c is None else c})" for i, (h, w, c) in enumerate(PUBLISHED))}),
k AS (SELECT row, cap, b.k AS kb, w.k AS kw FROM v, (SELECT unnest(range(0, {PUBLISHED_N + 1})) AS k) b, (SELECT unnest(range(0, {PUBLISHED_N + 1})) AS k) w WHERE round(b.k / {PUBLISHED_N}e0, 4) = hi AND round(w.k / {PUBLISHED_N}e0, 4) = lo AND b.k > w.k),
m AS (SELECT *, 2 * least({PUBLISHED_N} - kb, {PUBLISHED_N} - kw - (kb - kw)) + (kb - kw) AS most FROM k),
n AS (SELECT *, CASE WHEN cap IS NULL THEN most ELSE least(most, cap - abs((cap - (kb - kw)) % 2)) END AS t FROM m),
x AS (SELECT row, kb, kw, ((t - (kb - kw)) // 2) + (kb - kw) AS b, (t - (kb - kw)) // 2 AS c FROM n),
p AS (SELECT *, least(1e0, 2 * list_sum(list_transform(range(0, c + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2e0))))) AS p FROM x)
SELECT row::INT AS row, b::BIGINT AS b, c::BIGINT AS c, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY p DESC, kb, kw) AS place FROM p) WHERE place = 1"""


@query(_WORST)
def mcnemar_worst_case(spark, sf_dir):
    out = None
    for i, (better, worse, cap) in enumerate(PUBLISHED):
        one = paired.worst_case(spark, better, worse, PUBLISHED_N, cap).select(F.lit(i).alias("row"), "b", "c", r6("p").alias("p"))
        out = one if out is None else out.union(one)
    return out


# resampling: the same hashed draws in both engines
_DRAWS = f", n_ AS (SELECT count(*) AS n FROM samples WHERE split = 'test'), draws AS (SELECT rep, ('0x' || substr(md5(rep || '-' || draw), 1, 8))::BIGINT % n AS pos FROM n_, (SELECT unnest(range(0, {REPS})) AS rep), LATERAL (SELECT unnest(range(0, n)) AS draw)), rs AS (SELECT rep, pos, count(*) AS cnt FROM draws GROUP BY rep, pos), px AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM samples WHERE split = 'test') "
_CI = "round(quantile_cont({0}, 0.025), 6) + 0e0 AS lo, round(quantile_cont({0}, 0.975), 6) + 0e0 AS hi"


def _resamples(spark, sf_dir, rows):
    placed = resample.positions(S.samples(spark, sf_dir).where("split = 'test'").select("row_id"))
    n = placed.count()
    return rows.join(placed, "row_id"), resample.hash_resamples(spark, n, REPS)


@query(TEST + _DRAWS + ", s AS (SELECT image, checkpoint, mode, rep, sum(cnt * ok) / sum(cnt)::DOUBLE AS v FROM rs JOIN px USING (pos) JOIN rows_ USING (row_id) GROUP BY ALL) SELECT image, checkpoint, mode, " + _CI.format("v") + " FROM s GROUP BY ALL")
def boot_accuracy_ci(spark, sf_dir):
    rows, draws = _resamples(spark, sf_dir, test_rows(spark, sf_dir))
    s = resample.resampled(rows, draws, SYS, {"ok": metrics.correct()}).withColumn("v", F.col("ok") / F.col("n"))
    return rounded(resample.interval(s, SYS, "v"))


@query(PAIR + _DRAWS + ", g AS (SELECT mode, rep, bin, sum(cnt * ok) - sum(cnt * conf) AS gap, sum(cnt) AS n FROM rs JOIN px USING (pos) JOIN rows_ USING (row_id) GROUP BY ALL), s AS (SELECT mode, rep, sum(abs(gap)) / sum(n)::DOUBLE AS v FROM g GROUP BY ALL) SELECT mode, " + _CI.format("v") + " FROM s GROUP BY mode")
def boot_ece_ci(spark, sf_dir):
    rows, draws = _resamples(spark, sf_dir, test_rows(spark, sf_dir, (SERVED, POOLED)))
    conf = V.confidence(F.col("probs"))
    g = resample.resampled(rows.withColumn("bin", V.bin_index(conf)), draws, ["mode", "bin"], {"ok": metrics.correct(), "conf": conf})
    s = g.groupBy("rep", "mode").agg((F.sum(F.abs(F.col("ok") - F.col("conf"))) / F.sum("n")).alias("v"))
    return rounded(resample.interval(s, ["mode"], "v"))


@query(PAIR + _DRAWS + ", z AS (SELECT mode, rep, label, pred, sum(cnt) AS n FROM rs JOIN px USING (pos) JOIN rows_ USING (row_id) GROUP BY ALL), f AS (SELECT mode, rep, k, 2e0 * sum(CASE WHEN label = k AND pred = k THEN n ELSE 0 END) / nullif(sum(CASE WHEN label = k THEN n ELSE 0 END) + sum(CASE WHEN pred = k THEN n ELSE 0 END), 0) AS f1 FROM z, (SELECT unnest(range(0, 9)) AS k) GROUP BY ALL), m AS (SELECT mode, rep, sum(coalesce(f1, 0)) / 9 AS v FROM f GROUP BY ALL), d AS (SELECT rep, sum(CASE mode WHEN 'pgs' THEN v ELSE -v END) AS v FROM m GROUP BY rep) SELECT " + _CI.format("v") + " FROM d")
def boot_macro_f1_delta_ci(spark, sf_dir):
    rows, draws = _resamples(spark, sf_dir, test_rows(spark, sf_dir, (SERVED, POOLED)))
    cells = draws.join(rows.select("pos", "mode", "label", "pred"), "pos").groupBy("rep", "mode", "label", "pred").agg(F.sum("cnt").alias("n"))
    m = metrics.macro_f1(cells, ["rep", "mode"], S.CLASSES)
    d = m.groupBy("rep").agg(F.sum(F.when(F.col("mode") == "pgs", F.col("macro_f1")).otherwise(-F.col("macro_f1"))).alias("v"))
    return rounded(resample.interval(d, [], "v"))


_WAUROC = _SCORES + _DRAWS + ", x AS (SELECT rep, score_id, score, sum(CASE WHEN ok THEN 0 ELSE cnt END) AS pos_, sum(CASE WHEN ok THEN cnt ELSE 0 END) AS neg_ FROM rs JOIN px USING (pos) JOIN scores USING (row_id) WHERE score_id IN ('S1', 'S5') GROUP BY ALL), y AS (SELECT *, sum(neg_) OVER (PARTITION BY rep, score_id ORDER BY score) - neg_ AS below FROM x), s AS (SELECT rep, score_id, sum(pos_ * (below + 0.5e0 * neg_)) / nullif(sum(pos_) * sum(neg_), 0)::DOUBLE AS v FROM y GROUP BY ALL) "


def _boot_auroc(spark, sf_dir):
    """AUROC of S1 and S5 in each resample. Kept once a session, 20 rows a score: both queries of it read the same resamples."""

    def make():
        placed = resample.positions(S.samples(spark, sf_dir).where("split = 'test'").select("row_id"))
        n = S.samples(spark, sf_dir).where("split = 'test'").count()
        rows = _score_rows(spark, sf_dir).where("score_id in ('S1', 'S5')").join(placed, "row_id").select("pos", "score_id", "score", (~F.col("ok")).alias("positive"))
        # Spark takes the draws for as small as their range, and would broadcast them
        return resample.auroc_of_counts(rows.join(resample.hash_counts(spark, n, REPS).hint("merge"), "pos"), ["score_id"], REPS)

    return shared.kept(spark, "boot-auroc", sf_dir, make)


@query(_WAUROC + "SELECT score_id, " + _CI.format("v") + " FROM s GROUP BY score_id")
def boot_auroc_ci(spark, sf_dir):
    return rounded(resample.interval(_boot_auroc(spark, sf_dir), ["score_id"], "auroc"))


@query(_WAUROC + ", d AS (SELECT rep, sum(CASE score_id WHEN 'S5' THEN v ELSE -v END) AS v FROM s GROUP BY rep) SELECT " + _CI.format("v") + " FROM d")
def boot_auroc_delta_ci(spark, sf_dir):
    d = _boot_auroc(spark, sf_dir).groupBy("rep").agg(F.sum(F.when(F.col("score_id") == "S5", F.col("auroc")).otherwise(-F.col("auroc"))).alias("v"))
    return rounded(resample.interval(d, [], "v"))


@query(PAIR + _DRAWS + ", s AS (SELECT rep, sum(CASE mode WHEN 'pgs' THEN cnt * brier ELSE -cnt * brier END) / (sum(cnt) / 2e0) AS b, sum(CASE mode WHEN 'pgs' THEN cnt * nll ELSE -cnt * nll END) / (sum(cnt) / 2e0) AS l FROM rs JOIN px USING (pos) JOIN rows_ USING (row_id) GROUP BY rep) SELECT 'brier' AS metric, " + _CI.format("b") + " FROM s UNION ALL SELECT 'nll', " + _CI.format("l") + " FROM s")
def boot_calibration_delta_ci(spark, sf_dir):
    rows, draws = _resamples(spark, sf_dir, test_rows(spark, sf_dir, (SERVED, POOLED)))
    sign = F.when(F.col("mode") == "pgs", 1.0).otherwise(-1.0)
    s = resample.resampled(rows, draws, [], {"brier": sign * V.brier(F.col("probs"), F.col("label")), "nll": sign * V.nll(F.col("probs"), F.col("label"))})
    long = s.select("rep", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) / (F.col("n") / 2)).alias("v")) for m in ("brier", "nll")])).alias("e")).select("rep", "e.*")
    return rounded(resample.interval(long, ["metric"], "v"))


@query()
def boot_exact_stream(spark, sf_dir):
    rows = test_rows(spark, sf_dir, (SERVED,)).select("row_id", metrics.correct().alias("accuracy"), V.nll(F.col("probs"), F.col("label")).alias("nll"))
    drawn = resample.exact_stream(rows, ["accuracy", "nll"], 200)
    long = drawn.select("rep", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("accuracy", "nll")])).alias("e")).select("rep", "e.*")
    return rounded(resample.interval(long, ["metric"], "v"))


# validation
@query("WITH " + sql.frame() + " SELECT 'repeated_key' AS rule, 0::BIGINT AS n UNION ALL SELECT unnest(['split', 'label_range', 'pred_range', 'width', 'not_finite', 'out_of_range', 'row_sum', 'not_argmax', 'mi_negative', 'pred_entropy_negative', 'exp_entropy_negative', 'prob_std_negative', 'mi_identity']), 0::BIGINT")
def contract_violations(spark, sf_dir):
    return contracts.violations(S.predictions(spark, sf_dir), S.CLASSES, keys=(*SYS, "split", "row_id"))


@query("WITH " + sql.frame((SERVED,), "test") + " SELECT count_if(probs[(pred + row_id % 2) % 9 + 1] >= list_max(probs) - 1e-9)::BIGINT AS fits, count(*) AS n FROM preds")
def argmax_tie_check(spark, sf_dir):
    moved = ((F.col("pred") + F.col("row_id") % 2) % 9).cast("int")
    return test_rows(spark, sf_dir, (SERVED,)).agg(F.count_if(V.argmax_tie_ok(F.col("probs"), moved)).alias("fits"), F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT o_orderkey AS row_id, 'train' AS split FROM orders WHERE o_orderkey % 5 < 3 UNION ALL SELECT o_orderkey, 'test' FROM orders WHERE o_orderkey % 5 > 1) SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.row_id) AS n FROM s a JOIN s b USING (row_id) WHERE a.split < b.split GROUP BY ALL")
def split_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return contracts.overlaps(o.where("row_id % 5 < 3").withColumn("split", F.lit("train")).union(o.where("row_id % 5 > 1").withColumn("split", F.lit("test"))))


@query("SELECT c.c_nationkey AS code, n.n_name AS name, count(*) AS n FROM (SELECT c_nationkey, c_nationkey % 24 AS claimed FROM customer) c JOIN nation n ON n.n_nationkey = c.claimed WHERE c.claimed <> c.c_nationkey GROUP BY ALL")
def label_dictionary_check(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_nationkey") % 24).alias("claimed"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, F.col("claimed") == F.col("n_nationkey")).where("claimed <> c_nationkey").groupBy(F.col("c_nationkey").alias("code"), F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("WITH listed AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 30), present AS (SELECT p_partkey AS k FROM part WHERE p_size < 40) SELECT k, 'missing' AS state FROM listed WHERE k NOT IN (SELECT k FROM present) UNION ALL SELECT k, 'not listed' FROM present WHERE k NOT IN (SELECT k FROM listed)")
def manifest_reconcile(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("k"))
    return contracts.reconcile(listed, table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("k")), "k")


@query("WITH " + sql.frame((SERVED, POOLED), "test") + " SELECT count_if(a.row_id IS NULL)::BIGINT AS missing, count_if(b.row_id IS NULL)::BIGINT AS unexpected, count_if(a.label <> b.label)::BIGINT AS label_differs, count_if(a.label = b.label)::BIGINT AS aligned FROM (SELECT * FROM preds WHERE mode = 'argmax' AND row_id % 7 <> 0) b FULL JOIN (SELECT * FROM preds WHERE mode = 'pgs' AND row_id % 11 <> 0) a ON a.row_id = b.row_id")
def align_systems(spark, sf_dir):
    df = test_rows(spark, sf_dir, (SERVED, POOLED))
    return contracts.align(df.where("mode = 'pgs' and row_id % 11 <> 0"), df.where("mode = 'argmax' and row_id % 7 <> 0"), ["row_id"])


_EXPECTED = ((0.7424, "imgA"), (0.75, "imgB"), (0.7, "imgC"))


@query(TEST + f", e(v, image) AS (VALUES {', '.join(f"({v}e0, '{i}')" for v, i in _EXPECTED)}), a AS (SELECT image, checkpoint, mode, avg(ok) AS accuracy FROM rows_ GROUP BY ALL) SELECT image, checkpoint, mode, round(accuracy, 6) AS accuracy, arg_min(v, abs(accuracy - v)) AS nearest, round(min(abs(accuracy - v)) * 100, 4) AS off_pp, bool_or(round(accuracy, 4) = v) AS reproduced FROM a JOIN e USING (image) GROUP BY ALL")
def reproduction_check(spark, sf_dir):
    acc = metrics.accuracy(test_rows(spark, sf_dir), SYS)
    e = spark.createDataFrame(list(_EXPECTED), "v double, image string")
    off = F.abs(F.col("accuracy") - F.col("v"))
    return acc.join(F.broadcast(e), "image").groupBy(*SYS, r6("accuracy").alias("accuracy")).agg(F.min_by("v", off).alias("nearest"), F.round(F.min(off) * 100, 4).alias("off_pp"), F.bool_or(F.round("accuracy", 4) == F.col("v")).alias("reproduced"))


#: The comparison that no family adjusts: averaging against the argmax at the baseline checkpoint.
_SUPPLEMENT = ("S-cb", "supplementary", "F", "E")


def _compared(spark, sf_dir, comparisons):
    """A row for each test sample and comparison: row, family, label, and the predictions a and b."""
    names = {**_NAMES, "F": ("imgA", "cb", "pgs")}
    wide = paired.pivot_systems(_named(spark, sf_dir, names), list(names))
    entries = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(f).alias("family"), F.col(f"{x}_pred").alias("a"), F.col(f"{y}_pred").alias("b")) for r, f, x, y in comparisons])
    return wide.select("label", F.explode(entries).alias("e")).select("label", "e.*")


def _paired_ci(spark, sf_dir, comparisons):
    drawn = resample.paired_resamples(_compared(spark, sf_dir, comparisons), ["row"], S.CLASSES, VERDICT_REPS)
    return resample.intervals(drawn, ["row"], ["d_accuracy", "d_macro_f1"])


@query()
def paired_table_ci(spark, sf_dir):
    """The paired table with both differences, their intervals and the supplementary row."""
    spec = (*_COMPARISONS, _SUPPLEMENT)
    rows = _compared(spark, sf_dir, spec)
    right = lambda c: F.col(c) == F.col("label")
    d = rows.groupBy("row", "family").agg(F.count(F.lit(1)).alias("n"), *paired.discordant(right("a"), right("b")), (F.avg(right("a").cast("double")) - F.avg(right("b").cast("double"))).alias("d_accuracy"), F.count_if(F.col("a") != F.col("b")).alias("differ"))
    sides = F.array(*[F.struct(F.lit(sign).alias("sign"), F.col(c).alias("pred")) for c, sign in (("a", 1.0), ("b", -1.0))])
    cells = metrics.confusion(rows.select("row", "label", F.explode(sides).alias("s")).select("row", "label", "s.*"), ["row", "sign"])
    f1 = metrics.macro_f1(cells, ["row", "sign"], S.CLASSES).groupBy("row").agg(F.sum(F.col("sign") * F.col("macro_f1")).alias("d_macro_f1"))
    t = paired.holm(d.withColumn("p", paired.mcnemar_exact(F.col("b"), F.col("c"))), "family").withColumn("p_holm", F.when(F.col("family") != _SUPPLEMENT[1], F.col("p_holm")))
    return rounded(t.join(f1, "row").join(_paired_ci(spark, sf_dir, spec), "row"))


@query()
def calibration_table_ci(spark, sf_dir):
    """Calibration of the deployed pair with intervals: both checkpoints and modes, and the served path after temperature scaling."""
    keys = ["checkpoint", "mode", "scaled"]
    rows = test_rows(spark, sf_dir).where(F.col("image") == SERVED[0]).select("checkpoint", "mode", F.lit(False).alias("scaled"), "row_id", "label", "pred", "probs")
    t = temperature.fit(S.predictions(spark, sf_dir, (SERVED,), "val"))["temperature"]
    served = rows.where((F.col("checkpoint") == SERVED[1]) & (F.col("mode") == SERVED[2]))
    every = rows.union(served.withColumns({"scaled": F.lit(True), "probs": V.apply_temperature(F.col("probs"), t)}))
    ci = resample.intervals(resample.calibration_resamples(every, keys, VERDICT_REPS), keys, ["accuracy", "mean_confidence", "ece", "brier", "nll"])
    return rounded(metrics.calibration(every, keys).join(ci, keys))


def _verdict_auroc(spark, sf_dir):
    rows = _score_rows(spark, sf_dir).where("score_id in ('S1', 'S5')").withColumn("positive", ~F.col("ok"))
    return rounded(resample.interval(resample.auroc_resamples(rows, ["score_id"], VERDICT_REPS), ["score_id"], "auroc"))


@query()
def claim_verdicts(spark, sf_dir):
    t = paired.holm(_paired(spark, sf_dir), "family")
    by_row = _paired_ci(spark, sf_dir, [x for x in _COMPARISONS if x[0] in ("R1", "R5")])
    f1 = by_row.agg(*[F.max(F.when(F.col("row") == r, F.col(f"d_macro_f1_{e}"))).alias(f"f1_{e}_{r}") for r in ("R1", "R5") for e in ("lo", "hi")])
    c5 = reproduction_check(spark, sf_dir).select(F.lit(None).cast("boolean").alias("by_manifest"), F.col("reproduced").alias("by_computed"))  # no manifest stands beside the frame
    ci = _verdict_auroc(spark, sf_dir).join(rounded(_auroc(spark, sf_dir, ("S1", "S5"))), "score_id")
    s = ci.agg(*[F.max(F.when(F.col("score_id") == k, F.col(c))).alias(f"{c}_{k}") for k in ("S1", "S5") for c in ("auroc", "lo", "hi")])
    one = t.agg(*[F.max(F.when(F.col("row") == r, F.col(c))).alias(f"{c}_{r}") for r in ("R1", "R4", "R5") for c in ("d_accuracy", "p", "p_holm", "differ")]).join(F.broadcast(f1)).join(F.broadcast(s)).join(F.broadcast(c5.agg(rules.reproduced(c5).alias("c5"))))
    c = F.col
    verdicts = [("C1", rules.lower_accuracy(c("d_accuracy_R4"), c("p_R4"))), ("C2", rules.within_variance(c("p_R5"), c("f1_lo_R5"), c("f1_hi_R5"))), ("C3", rules.indistinguishable(c("p_holm_R1"), c("f1_lo_R1"), c("f1_hi_R1"))), ("C4", rules.signal_value(c("auroc_S5"), c("lo_S5"), c("hi_S5"), c("auroc_S1"), c("lo_S1"), c("hi_S1"))), ("C5", c("c5")), ("C6", rules.disagreements(c("differ_R4")))]
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("claim"), v.alias("verdict")) for k, v in verdicts])).alias("e")).select("e.*")
