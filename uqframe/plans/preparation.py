"""Preparation, text, template, scorer and monitor queries."""

from __future__ import annotations

from uqframe.operators import scorer
from uqframe.plans.base import F, POOLED, SERVED, SYS, TEST, S, V, Window, X, metrics, prep, query, r6, rounded, sql, table, template, test_rows
from uqframe.sources import readers, shared
from uqframe.streaming import monitor


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(url || '  see ' || url || ' end', 'https?://\S+|www\.\S+', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def clean_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", X.without_urls(F.concat("url", F.lit("  see "), "url", F.lit(" end"))).alias("text"))


@query("SELECT doc_id, sha256(text) AS h FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_first(spark, sf_dir):
    d = prep.first_wins(table(spark, sf_dir, "documents").select("text", "doc_id"), "text", "doc_id")
    return d.select("doc_id", F.sha2("text", 256).alias("h"))


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type, min(event_id) AS first_at FROM events GROUP BY user_id")
def last_value_wins(spark, sf_dir):
    return prep.last_wins(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", F.col("event_type").alias("last_type"), "first_at")


_LANGS = (("en", 0), ("de", 1), ("fr", 2))


@query("SELECT doc_id, label_id FROM documents JOIN (VALUES ('en', 0), ('de', 1), ('fr', 2)) d(lang, label_id) USING (lang)")
def label_map(spark, sf_dir):
    d = spark.createDataFrame(list(_LANGS), "lang string, label_id int")
    return prep.encode(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.broadcast(d), "lang").select("doc_id", "label_id")


@query("""WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, CASE WHEN k <= round_even(n * 0.7e0, 0) THEN 'train' WHEN k <= round_even(n * 0.85e0, 0) THEN 'val' ELSE 'test' END AS split FROM x""")
def stratified_split(spark, sf_dir):
    return prep.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "split")


@query("SELECT count(*) AS rows, count(DISTINCT lang) AS distinct_lang, count(DISTINCT text) AS distinct_text, min(source) AS min_source, max(source) AS max_source FROM documents")
def data_summary(spark, sf_dir):
    return prep.summary(table(spark, sf_dir, "documents"), ["lang", "text"], ["source"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id IN (SELECT doc_id FROM labels)")
def availability_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return prep.available(table(spark, sf_dir, "documents").select("doc_id"), labels.where("toxic = 1").select("doc_id"), labels.select("doc_id"), "doc_id")


@query("SELECT count(*) AS n, count(DISTINCT row_id)::BIGINT AS ids, min(row_id) AS first_id, max(row_id) AS last_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents)")
def dense_row_ids(spark, sf_dir):
    from uqframe.operators import resample

    ids = resample.positions(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("ids"), F.min("pos").alias("first_id"), F.max("pos").alias("last_id"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN -1e0 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0")
def upsert_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    return prep.upsert(c, c.where("c_custkey % 10 = 0").withColumn("balance", F.lit(-1.0)), ["c_custkey"])


@query("SELECT user_id % 5 AS g, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("g"), F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(TEST + "SELECT image, checkpoint, mode, round(avg(ok), 4) AS accuracy FROM rows_ WHERE mode = 'pgs' GROUP BY ALL")
def read_back_parquet(spark, sf_dir):
    """Write the pooled systems as a partitioned table into the shared folder, read it, and use what was read."""
    import uuid

    folder = f"{shared.shared_dir(spark)}/predictions-{uuid.uuid4().hex}"
    readers.write_predictions(test_rows(spark, sf_dir).where("mode = 'pgs'"), folder)
    return metrics.accuracy(spark.read.parquet(folder), SYS).select(*SYS, F.round("accuracy", 4).alias("accuracy"))


_ROWS = "t AS (SELECT conv_id, turn, text || ' ⟦K' || (conv_id % 4) || '⟧ and ⟦ROLE: of ' || role || '⟧ ⟦x' AS text FROM conversations), v(key, value) AS (VALUES ('K0', 'zero $1'), ('K1', 'one \\2'), ('K2', ' two' || chr(10) || ' lines '), ('ROLE', 'the role'), ('GONE', 'never')) "


def _template(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" ⟦K"), (F.col("conv_id") % 4).cast("string"), F.lit("⟧ and ⟦ROLE: of "), "role", F.lit("⟧ ⟦x")).alias("text"))
    values = spark.createDataFrame([("K0", "zero $1"), ("K1", "one \\2"), ("K2", " two\n lines "), ("ROLE", "the role"), ("GONE", "never")], "key string, value string")
    return rows, values


@query("WITH " + _ROWS + "SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '⟦([A-Z0-9_]+)(?::[^⟦⟧]*)?⟧', 1), ',') AS keys FROM t")
def token_extract(spark, sf_dir):
    rows, _ = _template(spark, sf_dir)
    return rows.select("conv_id", "turn", F.array_join(template.tokens(F.col("text")), ",").alias("keys"))


_FILLED = "replace(replace(replace(regexp_replace(text, '⟦ROLE(:[^⟦⟧]*)?⟧', 'the role', 'g'), '⟦K0⟧', 'zero $1'), '⟦K1⟧', 'one ' || chr(92) || '2'), '⟦K2⟧', 'two lines')"


@query("WITH " + _ROWS + f"SELECT conv_id, turn, sha256({_FILLED}) AS filled FROM t")
def token_fill(spark, sf_dir):
    rows, values = _template(spark, sf_dir)
    return template.fill(rows, values).select("conv_id", "turn", F.sha2("filled", 256).alias("filled"))


@query("WITH " + _ROWS + ", j AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM t GROUP BY conv_id)" + f" SELECT conv_id, sha256({_FILLED}) AS filled FROM j")
def token_fill_segments(spark, sf_dir):
    rows, values = _template(spark, sf_dir)
    return template.fill_segments(rows, values, "conv_id", "turn").select("conv_id", F.sha2("filled", 256).alias("filled"))


@query("WITH " + _ROWS + ", u AS (SELECT key, count(*) AS used FROM (SELECT unnest(regexp_extract_all(text, '⟦([A-Z0-9_]+)(?::[^⟦⟧]*)?⟧', 1)) AS key FROM t) GROUP BY key) SELECT coalesce(u.key, v.key) AS key, coalesce(used, 0) AS used, CASE WHEN v.key IS NULL THEN 'missing' WHEN u.key IS NULL THEN 'absent' ELSE 'replaced' END AS state FROM u FULL JOIN v ON u.key = v.key")
def token_status(spark, sf_dir):
    return template.status(*_template(spark, sf_dir))


@query("WITH " + _ROWS + "SELECT CASE WHEN regexp_matches(regexp_replace(text, '⟦([A-Z0-9_]+)(?::[^⟦⟧]*)?⟧', '', 'g'), '⟦\\s*[A-Za-z0-9_]|[A-Za-z0-9_]\\s*⟧') THEN 'error' ELSE 'none' END AS state, count(*) AS n FROM t GROUP BY ALL")
def token_leftovers(spark, sf_dir):
    rows, _ = _template(spark, sf_dir)
    return rows.groupBy(template.leftovers(F.col("text")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


_VALUES = (("A1", "0.8116"), ("low", "x"), ("B", ""), ("C", "a⟦b"), ("D", "-0.5"), ("E", " two\n lines"), ("F", "bad\x01char"), ("G", None))


@query("SELECT * FROM (VALUES ('A1', 'ok'), ('low', 'bad key'), ('B', 'empty'), ('C', 'bracket'), ('D', 'ascii minus'), ('E', 'ok'), ('F', 'illegal character'), ('G', 'not a string')) t(key, state)")
def value_states(spark, sf_dir):
    v = spark.createDataFrame(list(_VALUES), "key string, value string")
    return v.select("key", template.value_state(F.col("key"), F.col("value")).alias("state"))


@query("SELECT doc_id, sentence, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, '.'))) AS sentence FROM documents) WHERE contains(lower(sentence), 'license') GROUP BY ALL")
def phrase_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\.")).alias("s")).select("doc_id", F.trim("s").alias("sentence"))
    return d.where(F.lower("sentence").contains("license")).groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT page_id, regexp_extract('preds__' || (page_id % 3) || '__mE5__' || CASE WHEN page_id % 2 = 0 THEN 'cb' ELSE 'pgs' END || '__argmax.csv.gz', 'preds__(.+?)__(.+?)__(cb|pgs)__(argmax|pgs)\\.csv\\.gz$', 3) AS checkpoint FROM pages")
def file_key(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("preds__"), (F.col("page_id") % 3).cast("string"), F.lit("__mE5__"), F.when(F.col("page_id") % 2 == 0, "cb").otherwise("pgs"), F.lit("__argmax.csv.gz")).alias("path"))
    return p.select("page_id", readers.key_of(F.col("path"))[2])


@query(r"SELECT n_regionkey, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END AS names FROM (SELECT n_regionkey, list_sort(list(n_name)) AS l FROM nation GROUP BY n_regionkey)")
def english_list(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    return n.select("n_regionkey", X.join_english(F.col("l")).alias("names"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 AND printf('%.2f', abs(c_acctbal) / 7) <> '0.00' THEN '−' WHEN c_acctbal > 0 AND printf('%.2f', c_acctbal / 7) <> '0.00' THEN '+' ELSE '' END || printf('%.2f', abs(c_acctbal) / 7) AS pp FROM customer")
def formatted_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.fixed(F.col("c_acctbal") / 7, 2, plus=True).alias("pp"))


@query(TEST + ", a AS (SELECT image, checkpoint, mode, avg(ok) AS accuracy, avg(conf) AS conf FROM rows_ GROUP BY ALL) SELECT image || '/' || checkpoint || '/' || mode AS key, printf('%.4f', accuracy) || ' (' || printf('%.4f', conf) || ')' AS value FROM a")
def fill_values(spark, sf_dir):
    a = test_rows(spark, sf_dir).groupBy(*SYS).agg(F.avg(metrics.correct()).alias("accuracy"), F.avg(V.confidence(F.col("probs"))).alias("conf"))
    return a.select(F.concat_ws("/", *SYS).alias("key"), F.concat(X.fmt_metric(F.col("accuracy")), F.lit(" ("), X.fmt_metric(F.col("conf")), F.lit(")")).alias("value"))


_CENTROID = """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-9)) AS v FROM embeddings),
e AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM u) GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS c FROM e GROUP BY label),
d AS (SELECT vec_id, c.label AS k, list_sum(list_transform(range(1, 65), lambda i: v[i] * c[i])) AS s FROM u, c) """


@query(_CENTROID + "SELECT vec_id, arg_max(k, (s, -k)) AS pred, round(max(exp(s)) / sum(exp(s)), 6) AS confidence FROM d GROUP BY vec_id")
def centroid_scorer(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(scorer.centroid_scores(e, scorer.centroids(e), "vec_id"))


@query("WITH z AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS z FROM embeddings) SELECT vec_id, (list_position(z, list_max(z)) - 1)::INT AS pred, round(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS confidence FROM z")
def scorer_udf(spark, sf_dir):
    import numpy as np

    def predict(x):
        z = x[:, :4]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    p = scorer.apply_model(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", predict)
    return p.select("vec_id", V.argmax_lowest(F.col("probs")).alias("pred"), r6(V.confidence(F.col("probs"))).alias("confidence"))


@query("""WITH e AS (SELECT date_trunc('day', ts) AS start, least(1e0, abs(value) / 100e0) AS confidence, (event_id % 3 > 0)::INT AS ok FROM events), b AS (SELECT start, len(list_filter(range(1, 15), lambda i: confidence > i / 15e0)) AS bin, count(*) AS n, sum(ok) AS hits, sum(confidence) AS c FROM e GROUP BY ALL)
SELECT start, sum(n)::BIGINT AS n, round(sum(abs(hits - c)) / sum(n)::DOUBLE, 4) AS ece FROM b GROUP BY start""")
def calibration_monitor(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", F.least(F.lit(1.0), F.abs("value") / 100.0).alias("confidence"), (F.col("event_id") % 3 > 0).alias("ok"))
    return monitor.calibration_error(monitor.binned(e)).select("start", "n", F.round("ece", 4).alias("ece"))
