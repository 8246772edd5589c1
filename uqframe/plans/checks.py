"""Queries of split tables, strict alignment, export plans, reproduction flags, raw metadata and result tables."""

from __future__ import annotations

import uuid

from uqframe.functions import text as X
from uqframe.plans.analysis import _paired
from uqframe.plans.base import F, POOLED, SERVED, SYS, TEST, S, V, contracts, metrics, prep, query, r6, rounded, rules, sql, table, test_rows
from uqframe.plans.report_queries import _DIFF_SQL, _SEL_SQL, _differences, _selective
from uqframe.sources import files, readers
from uqframe.sources.shared import shared_dir

_SPLITS = ("train", "val", "test")


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 101 = 0 THEN -o_orderkey ELSE o_orderkey END AS row_id, CASE WHEN o_orderkey % 103 = 0 THEN 'dev' WHEN o_orderkey % 5 < 3 THEN 'train' ELSE 'val' END AS split, CASE WHEN o_orderkey % 107 = 0 THEN 9 ELSE (o_orderkey % 7)::INT END AS label FROM orders),
s AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE row_id % 109 = 0 UNION ALL SELECT row_id, 'test', label FROM o WHERE row_id % 113 = 0 AND split = 'train' AND label < 3), i AS (SELECT row_id, split, count(*) AS k FROM s GROUP BY ALL), m AS (SELECT row_id FROM i GROUP BY row_id HAVING count(*) > 1),
r AS (SELECT split, 'negative_id' AS rule, count_if(row_id < 0)::BIGINT AS n FROM s GROUP BY split UNION ALL SELECT split, 'label_range', count_if(NOT label BETWEEN 0 AND 8)::BIGINT FROM s GROUP BY split UNION ALL SELECT split, 'unknown_split', count(*) FROM s WHERE split = 'dev' GROUP BY split
UNION ALL SELECT split, 'repeated_id', sum(k - 1)::BIGINT FROM i GROUP BY split UNION ALL SELECT split, 'shared_id', count(*) FROM i WHERE row_id IN (SELECT row_id FROM m) GROUP BY split
UNION ALL SELECT split, 'missing_class', count(*) FROM (SELECT unnest(['train', 'val', 'test']) AS split) d, (SELECT unnest(range(0, 9)) AS label) c WHERE (split, label) NOT IN (SELECT (split, label::BIGINT) FROM s) GROUP BY split) SELECT * FROM r WHERE n > 0""")
def split_contract(spark, sf_dir):
    """What planted faults break in a set of splits: ids, labels, classes, ids of several splits."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.when(k % 101 == 0, -k).otherwise(k).alias("row_id"), F.when(k % 103 == 0, "dev").when(k % 5 < 3, "train").otherwise("val").alias("split"), F.when(k % 107 == 0, 9).otherwise((k % 7).cast("int")).alias("label"))
    s = o.union(o.where("row_id % 109 = 0")).union(o.where("row_id % 113 = 0 and split = 'train' and label < 3").withColumn("split", F.lit("test")).select("row_id", "split", "label"))
    return contracts.split_faults(s, 9, _SPLITS)


@query("SELECT 'embeddings' AS split, rule, n FROM (SELECT 'not_finite' AS rule, count_if(vec_id % 10 = 0 OR vec_id % 7 = 0)::BIGINT AS n FROM embeddings UNION ALL SELECT 'width', count_if(vec_id % 9 = 0)::BIGINT FROM embeddings UNION ALL SELECT 'label_range', count_if(NOT label BETWEEN 0 AND 2)::BIGINT FROM embeddings) WHERE n > 0")
def feature_contract(spark, sf_dir):
    """Feature vectors with planted NaN, infinities and missing entries."""
    k = F.col("vec_id")
    v = F.transform("embedding", lambda x, i: F.when((k % 10 == 0) & (i == 3), float("nan")).when((k % 7 == 0) & (i == 5), float("inf")).otherwise(x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select(F.lit("embeddings").alias("split"), k.alias("row_id"), "label", F.when(k % 9 == 0, F.slice(v, 1, 63)).otherwise(v).alias("v"))
    return contracts.split_faults(e, 3, ("embeddings",), "v", 64)


@query("WITH " + sql.frame((SERVED, POOLED), "test") + " SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1)::BIGINT AS pos, max(CASE mode WHEN 'argmax' THEN pred END) AS served, max(CASE mode WHEN 'pgs' THEN pred END) AS pooled FROM preds GROUP BY row_id")
def strict_alignment(spark, sf_dir):
    """Two systems in one order of rows, after a check that they have the same rows and labels."""
    from uqframe.operators import resample

    df = test_rows(spark, sf_dir, (SERVED, POOLED))
    base = resample.positions(df.where("mode = 'argmax'").select("split", "row_id", "label", F.col("pred").alias("served")))
    both = contracts.aligned(df.where("mode = 'pgs'").select("split", "row_id", "label", F.col("pred").alias("pooled")), base, ["split", "row_id"], "pos")
    return both.join(base.select("row_id", "served"), "row_id").select("row_id", "pos", "served", "pooled")


@query("""WITH t AS (SELECT DISTINCT 'img' || (p_partkey % 3) || '__txt' || (p_partkey % 4) AS tag FROM part), f AS (SELECT DISTINCT 'preds__img' || (s_suppkey % 3) || '__txt' || (s_suppkey % 5) || '__' || CASE WHEN s_suppkey % 2 = 0 THEN 'cb' ELSE 'pgs' END || '__argmax.csv.gz' AS file FROM supplier)
SELECT tag, checkpoint, mode, 'preds__' || tag || '__' || checkpoint || '__' || mode || '.csv.gz' AS file, file IN (SELECT file FROM f) AS there FROM t, (SELECT unnest(['cb', 'pgs']) AS checkpoint), (SELECT unnest(['argmax', 'pgs']) AS mode)""")
def export_plan(spark, sf_dir):
    """Files that pairs of encoders, checkpoints and modes ask for, and which are there."""
    k = lambda c, n: (F.col(c) % n).cast("string")
    tags = table(spark, sf_dir, "part").select(F.concat(F.lit("img"), k("p_partkey", 3), F.lit("__txt"), k("p_partkey", 4)).alias("tag")).distinct()
    have = table(spark, sf_dir, "supplier").select(F.concat(F.lit("preds__img"), k("s_suppkey", 3), F.lit("__txt"), k("s_suppkey", 5), F.lit("__"), F.when(F.col("s_suppkey") % 2 == 0, "cb").otherwise("pgs"), F.lit("__argmax.csv.gz")).alias("file"))
    return contracts.export_plan(tags, ("cb", "pgs"), ("argmax", "pgs"), have)


_FLAGS_SQL = "WITH " + sql.frame() + """, a AS (SELECT image, checkpoint, mode, avg((pred = label)::INT) FILTER (split = 'test') AS accuracy, round(avg((pred = label)::INT) FILTER (split = 'val'), 4) AS val FROM preds GROUP BY ALL),
x AS (SELECT *, CASE WHEN image = 'imgC' THEN NULL WHEN checkpoint = 'cb' THEN [val] ELSE [val, round(accuracy, 4)] END AS expected, CASE WHEN mode = 'pgs' THEN accuracy + CASE WHEN image = 'imgB' THEN 0.01e0 ELSE 0e0 END END AS recorded FROM a),
y AS (SELECT *, list_transform(expected, lambda e: abs(e - accuracy)) AS off, CASE WHEN expected IS NOT NULL THEN len(list_filter(expected, lambda e: printf('%.4f', e) = printf('%.4f', accuracy))) > 0 END AS by_computed,
CASE WHEN expected IS NOT NULL AND recorded IS NOT NULL THEN len(list_filter(expected, lambda e: printf('%.4f', e) = printf('%.4f', recorded))) > 0 END AS by_manifest FROM x) """


def _flags(spark, sf_dir):
    """Accuracies of the systems against expectations of the validation split, and what a list recorded of some."""
    a = S.predictions(spark, sf_dir).groupBy(*SYS).agg(F.avg(F.when(F.col("split") == "test", metrics.correct())).alias("accuracy"), F.round(F.avg(F.when(F.col("split") == "val", metrics.correct())), 4).alias("val"))
    expected = F.when(F.col("image") == "imgC", None).when(F.col("checkpoint") == "cb", F.array("val")).otherwise(F.array(F.col("val"), F.round("accuracy", 4)))
    recorded = F.when(F.col("mode") == "pgs", F.col("accuracy") + F.when(F.col("image") == "imgB", 0.01).otherwise(0.0))
    return contracts.reproduction(a.withColumns({"expected": expected, "recorded": recorded}), SYS, "accuracy", "expected", "recorded")


@query(_FLAGS_SQL + """SELECT image, checkpoint, mode, round(accuracy, 6) AS accuracy, expected[list_position(off, list_min(off))] AS nearest, round(100 * (accuracy - expected[list_position(off, list_min(off))]), 4) + 0e0 AS off_pp,
coalesce(by_computed::VARCHAR, 'unknown') AS by_computed, coalesce(by_manifest::VARCHAR, 'unknown') AS by_manifest, coalesce((abs(recorded - accuracy) > 5e-5)::VARCHAR, 'unknown') AS drifted FROM y""")
def reproduction_flags(spark, sf_dir):
    """Recomputed accuracies against expected ones and what a list recorded; unknown where there is nothing to compare."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("by_computed", "by_manifest", "drifted")}
    return _flags(spark, sf_dir).withColumns({"accuracy": r6("accuracy"), "off_pp": F.round("off_pp", 4) + F.lit(0.0), **shown})


_APART = "(f_lo > 0 OR f_hi < 0)"


@query("SELECT * FROM (" + _DIFF_SQL + f"""SELECT 'C1' AS claim, CASE WHEN da < 0 AND p < 0.05 THEN 'SUPPORTED' WHEN da < 0 THEN 'QUALIFIED' ELSE 'CONTRADICTED' END AS verdict FROM diff WHERE row = 'R4'
UNION ALL SELECT 'C2', CASE WHEN p < 0.05 OR {_APART} THEN 'CONTRADICTED' ELSE 'SUPPORTED' END FROM diff WHERE row = 'R5' UNION ALL SELECT 'C3', CASE WHEN p_holm >= 0.05 AND NOT {_APART} THEN 'SUPPORTED' WHEN p_holm < 0.05 AND {_APART} THEN 'CONTRADICTED' ELSE 'QUALIFIED' END FROM diff WHERE row = 'R1'
UNION ALL SELECT 'C6', CASE WHEN count_if(a.pred <> b.pred) = 130 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END FROM preds a JOIN preds b USING (image, checkpoint, row_id) WHERE image = 'imgA' AND checkpoint = 'pgs' AND a.mode = 'argmax' AND b.mode = 'pgs')
UNION ALL SELECT * FROM (""" + _SEL_SQL + """SELECT 'C4', CASE WHEN a.a_lo <= 0.5 THEN 'CONTRADICTED' WHEN NOT (a.a_lo <= b.a_hi AND b.a_lo <= a.a_hi) AND a.auroc < b.auroc THEN 'QUALIFIED' ELSE 'SUPPORTED' END FROM sel a, sel b WHERE a.score_id = 'S5' AND b.score_id = 'S1')
UNION ALL SELECT * FROM (""" + _FLAGS_SQL + """SELECT 'C5', CASE WHEN count_if(NOT coalesce(by_manifest, true) OR NOT coalesce(by_computed, true)) > 0 THEN 'CONTRADICTED' WHEN count_if(by_manifest <> by_computed) > 0 OR count_if(by_manifest IS NOT NULL OR by_computed IS NOT NULL) = 0 THEN 'QUALIFIED' ELSE 'SUPPORTED' END FROM y)""")
def claim_states(spark, sf_dir):
    """The six verdicts on shared draws, with the list's flags beside the recomputed ones."""
    diff, sel, col = _differences(spark, sf_dir), _selective(spark, sf_dir), F.col
    at = lambda df, by, keys, columns: df.agg(*[F.max(F.when(col(by) == k, col(c))).alias(f"{c}_{k}") for k in keys for c in columns])
    d = at(diff, "row", ("R1", "R4", "R5"), ("d_accuracy", "p", "p_holm", "d_macro_f1_lo", "d_macro_f1_hi"))
    s = at(sel, "score_id", ("S1", "S5"), ("auroc", "auroc_lo", "auroc_hi"))
    flags = _flags(spark, sf_dir)
    differ = _paired(spark, sf_dir).where("row = 'R4'").select("differ")
    one = d.join(F.broadcast(s)).join(F.broadcast(flags.agg(rules.reproduced(flags).alias("c5")))).join(F.broadcast(differ))  # one row each
    f1 = lambda r: (col(f"d_macro_f1_lo_{r}"), col(f"d_macro_f1_hi_{r}"))
    verdicts = {"C1": rules.lower_accuracy(col("d_accuracy_R4"), col("p_R4")), "C2": rules.within_variance(col("p_R5"), *f1("R5")), "C3": rules.indistinguishable(col("p_holm_R1"), *f1("R1")), "C4": rules.signal_value(*[col(f"{c}_{k}") for k in ("S5", "S1") for c in ("auroc", "auroc_lo", "auroc_hi")]), "C5": col("c5"), "C6": rules.disagreements(col("differ"))}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("claim"), v.alias("verdict")) for k, v in verdicts.items()])).alias("e")).select("e.*")


@query("SELECT doc_id, sha256(text) AS sha256, lang FROM documents WHERE text IS NOT NULL")
def metadata_scan(spark, sf_dir):
    """Texts with quotes, commas and line ends, written as a raw CSV and scanned."""
    folder = f"{shared_dir(spark)}/uqframe-metadata-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "lang")
    docs.write.csv(folder, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    back = readers.read_metadata(spark, folder, "doc_id long, text string, lang string")
    return back.select("doc_id", F.sha2("text", 256).alias("sha256"), "lang")


@query("""WITH d AS (SELECT *, length(coalesce(text, '')) > 0 AS a, lang IN ('en', 'fr') AS b, n_chars >= 200 AS c FROM documents), n AS (SELECT count(*) AS r, count_if(a)::BIGINT AS ra, count_if(a AND b)::BIGINT AS rb, count_if(a AND b AND c)::BIGINT AS rc FROM d)
SELECT * FROM (SELECT 0 AS place, 'raw' AS step, r AS rows, 0::BIGINT AS dropped FROM n UNION ALL SELECT 1, 'text', ra, r - ra FROM n UNION ALL SELECT 2, 'language', rb, ra - rb FROM n UNION ALL SELECT 3, 'length', rc, rb - rc FROM n)""")
def drop_counts(spark, sf_dir):
    """Rows left after each condition of a preparation, and rows it dropped."""
    d = table(spark, sf_dir, "documents")
    return prep.drop_counts(d, {"text": F.length("text") > 0, "language": F.col("lang").isin("en", "fr"), "length": F.col("n_chars") >= 200})


@query(_SEL_SQL + """SELECT score_id, round(auroc, 6) AS auroc, round(a_lo, 6) AS auroc_lo, round(a_hi, 6) AS auroc_hi, round(aurc, 6) AS aurc, round(acc, 6) AS accuracy_at_coverage, round(cov, 6) AS coverage_at_accuracy, e.* EXCLUDE (score_id) FROM sel JOIN
(SELECT score_id, count(*) AS n, count_if(NOT ok)::BIGINT AS errors FROM scores GROUP BY score_id) e USING (score_id)""")
def selective_table(spark, sf_dir):
    """The whole table of selective prediction, with intervals of the AUROCs."""
    return rounded(_selective(spark, sf_dir)).select("score_id", "auroc", "auroc_lo", "auroc_hi", "aurc", "accuracy_at_coverage", "coverage_at_accuracy", "n", "errors")


@query(TEST + """, a AS (SELECT image, checkpoint, mode, printf('%.4f', avg(ok)) AS accuracy FROM rows_ GROUP BY ALL), b AS (SELECT label, count(*) AS n FROM rows_ GROUP BY label)
SELECT 'accuracies.csv' AS file, (row_number() OVER (ORDER BY image, checkpoint, mode))::INT AS line, image || ',' || checkpoint || ',' || mode || ',' || accuracy AS text FROM a UNION ALL SELECT 'accuracies.csv', 0, 'image,checkpoint,mode,accuracy'
UNION ALL SELECT 'labels.csv', (row_number() OVER (ORDER BY label))::INT, label || ',' || n FROM b UNION ALL SELECT 'labels.csv', 0, 'label,n'""")
def result_tables(spark, sf_dir):
    """Result tables written as CSV files, and their lines as they stand there."""
    folder = f"{shared_dir(spark)}/uqframe-tables-{uuid.uuid4().hex}"
    rows = test_rows(spark, sf_dir)
    accuracies = metrics.accuracy(rows, SYS).select(*SYS, X.fmt_metric(F.col("accuracy")).alias("accuracy"))
    files.write_tables(spark, folder, {"accuracies": accuracies, "labels": rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))})
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "text"))
    return lines


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 10")
def head_rows(spark, sf_dir):
    """The first ten vectors' labels: a report of the top rows."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").orderBy("vec_id").limit(10)


_F1_OF = "list_sum(list_transform([{0}], lambda x: coalesce(x, 0e0))) / 9"
_F1_TERMS = ", ".join("2e0 * count_if({{0}} = {0} AND label = {0}) / nullif(count_if({{0}} = {0}) + count_if(label = {0}), 0)".format(k) for k in range(S.CLASSES))


@query("WITH " + sql.frame((SERVED, POOLED)) + ", p AS (SELECT *, (list_position(probs_loglin, list_max(probs_loglin)) - 1)::INT AS second FROM preds) SELECT image, checkpoint, mode, split, count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy, round(" + _F1_OF.format(_F1_TERMS.format("pred")) + ", 6) AS macro_f1, CASE WHEN mode = 'pgs' AND split = 'test' THEN round(avg((second = label)::INT), 6) END AS accuracy_loglin, CASE WHEN mode = 'pgs' AND split = 'test' THEN round(" + _F1_OF.format(_F1_TERMS.format("second")) + ", 6) END AS macro_f1_loglin, CASE WHEN mode = 'pgs' AND split = 'test' THEN round(avg(prob_std), 6) END AS mean_prob_std, CASE WHEN mode = 'pgs' AND split = 'test' THEN round(avg(mi), 6) END AS mean_mi FROM p GROUP BY image, checkpoint, mode, split")
def split_metrics(spark, sf_dir):
    """Metrics of each split, and what only the test split of the pooled system has."""
    return rounded(metrics.split_metrics(S.predictions(spark, sf_dir, (SERVED, POOLED)), SYS, S.CLASSES))


@query("WITH s AS (SELECT CASE event_id % 6 WHEN 0 THEN 'http_404' WHEN 1 THEN 'http_503' WHEN 2 THEN 'missing_id' WHEN 3 THEN 'timeout' WHEN 4 THEN 'not_an_image' END AS status FROM events) SELECT CASE WHEN status IS NULL THEN 'none' WHEN status IN ('http_404', 'http_410', 'missing_id', 'not_an_image') THEN 'permanent' ELSE 'transient' END AS kind, count(*) AS n FROM s GROUP BY ALL")
def failure_kinds(spark, sf_dir):
    """Fetches by whether a retry may mend them."""
    k = F.col("event_id") % 6
    status = F.when(k == 0, "http_404").when(k == 1, "http_503").when(k == 2, "missing_id").when(k == 3, "timeout").when(k == 4, "not_an_image")
    return table(spark, sf_dir, "events").select(prep.failure_kind(status).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN l_quantity::BIGINT::VARCHAR WHEN 1 THEN l_quantity::BIGINT || '.0' WHEN 2 THEN l_quantity::BIGINT || '.5' ELSE 'n' || l_quantity::BIGINT END AS x, l_quantity::BIGINT AS q FROM lineitem) SELECT l_orderkey % 4 AS form, count(*) AS n, coalesce(sum(CASE WHEN l_orderkey % 4 < 2 THEN q END), 0)::BIGINT AS total FROM t GROUP BY ALL")
def integer_coercion(spark, sf_dir):
    """Integers among texts: plain, with a zero fraction, with another one, and none at all."""
    q, k = F.col("l_quantity").cast("bigint").cast("string"), F.col("l_orderkey") % 4
    text = F.when(k == 0, q).when(k == 1, F.concat(q, F.lit(".0"))).when(k == 2, F.concat(q, F.lit(".5"))).otherwise(F.concat(F.lit("n"), q))
    own = table(spark, sf_dir, "lineitem").select(k.alias("form"), contracts.integer_of(text).alias("i"))
    return own.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("i"), F.lit(0)).alias("total"))


@query("SELECT s_suppkey, 'img' || (s_suppkey % 3) || ',x' || CASE WHEN s_suppkey % 2 = 1 THEN ',y' ELSE '' END AS parts, 'img' || s_suppkey || '/a.png' AS path FROM supplier")
def list_forms(spark, sf_dir):
    """Parts of lists with bars, and paths with either slash."""
    k = lambda n: (F.col("s_suppkey") % n).cast("string")
    listed = F.concat(F.lit("img"), k(3), F.lit("||x|"), F.when(F.col("s_suppkey") % 2 == 1, "y").otherwise("x"), F.lit("|"))
    path = F.concat(F.lit("crm\\img"), F.col("s_suppkey").cast("string"), F.lit("\\a.png"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(X.clean_list(listed), ",").alias("parts"), X.slash_path(path, "crm/").alias("path"))


@query("SELECT event_type, count(*) AS n, count_if(event_id % 5 > 0 AND event_id % 7 > 0)::BIGINT AS kept, round(sum(CASE WHEN event_id % 5 > 0 AND event_id % 7 > 0 THEN value ELSE 0 END), 4) AS total FROM events GROUP BY event_type")
def finite_values(spark, sf_dir):
    """Numbers as a JSON document may hold them: NaN and infinities become null."""
    k = F.col("event_id")
    x = V.finite(F.when(k % 5 == 0, float("nan")).when(k % 7 == 0, float("-inf")).otherwise(F.col("value")))
    return table(spark, sf_dir, "events").select("event_type", x.alias("x")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("kept"), F.round(F.sum("x"), 4).alias("total"))


@query("SELECT count(*) FILTER (doc_id % 10 > 3 AND length(regexp_replace(text, '\\s', '', 'g')) > 0) AS kept, count(*) AS n FROM documents")
def non_empty_rows(spark, sf_dir):
    """Rows whose text is neither null nor blank, some of them blanked."""
    k = F.col("doc_id") % 10
    text = F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, " \t\n").when(k == 3, "  ").otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents").select(text.alias("text"))
    return prep.non_empty(d, ["text"]).agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"))))
