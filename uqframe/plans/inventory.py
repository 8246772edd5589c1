"""Queries of lists, names, model contracts and planted contract faults."""

from __future__ import annotations

from uqframe.functions import text as X
from uqframe.plans.base import F, POOLED, SERVED, S, contracts, query, sql, table
from uqframe.sources.readers import CHECKPOINT

_NAMES = {"imgA": "Encoder A", "imgB": "Encoder B"}


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'][n_nationkey + 1] ELSE format('{:,}', n_nationkey * 1000) END AS word FROM nation")
def number_words(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", X.number_word(F.when(n < 10, n).otherwise(n * 1000)).alias("word"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN '+' ELSE '−' END || printf('%.4f', abs(s_acctbal::DOUBLE) / 100) AS shown FROM supplier")
def signed_numbers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.sign4(F.col("s_acctbal").cast("double") / 100).alias("shown"))


_TAGS = "' img' || (s_suppkey % 3) || '__t1 ,img' || (s_suppkey % 2) || '__t' || (s_suppkey % 4) || ',,img2__t1,bad' || (s_suppkey % 5)"


@query(f"""WITH x AS (SELECT s_suppkey, list_filter(list_transform(string_split({_TAGS}, ','), lambda t: trim(t)), lambda t: t <> '') AS l FROM supplier),
d AS (SELECT s_suppkey, unnest(list_filter(l, lambda t, i: list_position(l, t) = i)) AS tag, unnest(range(0, len(list_filter(l, lambda t, i: list_position(l, t) = i)))) AS pos FROM x)
SELECT s_suppkey, pos::INT AS pos, tag, CASE WHEN tag LIKE '%\\_\\_%' ESCAPE '\\' THEN split_part(tag, '__', 1) END AS image, CASE WHEN tag LIKE '%\\_\\_%' ESCAPE '\\' THEN split_part(tag, '__', 2) END AS text FROM d""")
def pair_list(spark, sf_dir):
    k = lambda n: (F.col("s_suppkey") % n).cast("string")
    s = F.concat(F.lit(" img"), k(3), F.lit("__t1 ,img"), k(2), F.lit("__t"), k(4), F.lit(",,img2__t1,bad"), k(5))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(X.listed_tags(s)).alias("pos", "tag"))
    parts = X.tag_parts(F.col("tag"))
    return rows.select("s_suppkey", "pos", "tag", parts["image"].alias("image"), parts["text"].alias("text"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'val,test' WHEN 1 THEN 'val,test' WHEN 2 THEN 'test' END AS splits FROM supplier")
def split_order(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    asked = F.when(k == 0, "test, val").when(k == 1, "val,test,val").when(k == 2, ",test").otherwise("test,dev")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(X.in_order(asked, ("val", "test")), ",").alias("splits"))


@query("WITH " + sql.frame() + " SELECT CASE image WHEN 'imgA' THEN 'Encoder A' WHEN 'imgB' THEN 'Encoder B' ELSE image END AS name, CASE image WHEN 'imgC' THEN 1 WHEN 'imgA' THEN 2 ELSE 3 END AS place, count(*) AS n FROM preds GROUP BY ALL")
def display_names(spark, sf_dir):
    order = F.array(*[F.lit(x) for x in ("imgC", "imgA", "imgB")])
    df = S.predictions(spark, sf_dir).groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    return df.select(X.display_name(F.col("image"), _NAMES).alias("name"), F.array_position(order, F.col("image")).cast("int").alias("place"), "n").orderBy("place")


@query("SELECT DISTINCT 'img' || (p_partkey % 3) || '__txt' || (p_partkey % 4) AS tag FROM part WHERE p_partkey % 7 < 5")
def checkpoint_tags(spark, sf_dir):
    k = lambda n: (F.col("p_partkey") % n).cast("string")
    name = F.concat(F.lit("dir/img"), k(3), F.lit("__txt"), k(4), F.when(F.col("p_partkey") % 7 < 3, "__cb.cbm").when(F.col("p_partkey") % 7 < 5, "__pgs.cbm").otherwise("__old.cbm"))
    tag = F.regexp_extract(name, CHECKPOINT, 1)
    return table(spark, sf_dir, "part").select(tag.alias("tag")).where("tag <> ''").distinct().orderBy("tag")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'loss' WHEN s_suppkey % 7 = 0 THEN 'classes' WHEN s_suppkey % 5 = 0 THEN 'features' WHEN s_suppkey % 13 = 0 THEN 'trees' END AS fault,
(s_suppkey % 3 = 0) <> (s_suppkey % 2 = 0) AS swapped FROM supplier""")
def model_contract(spark, sf_dir):
    k = F.col("s_suppkey")
    loss = F.when(k % 11 == 0, "MultiClassOneVsAll").when(k % 2 == 0, "MultiClass:class_names=9").otherwise("MultiClass")
    classes = F.when(k % 7 == 0, F.sequence(F.lit(1), F.lit(9))).otherwise(F.sequence(F.lit(0), F.lit(8)))
    fault = contracts.model_fault(loss, classes, F.when(k % 5 == 0, 1024).otherwise(1536), F.when(k % 13 == 0, 0).otherwise(100), S.CLASSES, 1536)
    return table(spark, sf_dir, "supplier").select("s_suppkey", fault.alias("fault"), contracts.swapped(F.when(k % 2 == 0, "pgs").otherwise("cb"), k % 3 == 0).alias("swapped"))


_BROKEN = "sum(CASE WHEN coalesce({}, true) THEN 1 ELSE 0 END)::BIGINT"
_RULES = {
    "split": "split NOT IN ('val', 'test')", "label_range": "NOT label BETWEEN 0 AND 8", "pred_range": "NOT pred BETWEEN 0 AND 8", "width": "len(probs) <> 9",
    "not_finite": "len(list_filter(probs, lambda x: isinf(x))) > 0", "out_of_range": "len(list_filter(probs, lambda x: x < 0 OR x > 1 + 1e-9)) > 0",
    "row_sum": "abs(list_sum(probs) - 1) > 1e-6", "not_argmax": "probs[CASE WHEN pred < 0 THEN NULL ELSE pred + 1 END] < list_max(probs) - 1e-9",
}


@query("WITH " + sql.frame((SERVED,)) + """, once AS (SELECT row_id, CASE WHEN row_id % 89 = 0 THEN 'dev' ELSE split END AS split, CASE WHEN row_id % 97 = 0 THEN 12 ELSE label END AS label, CASE WHEN row_id % 83 = 0 THEN -1 ELSE pred END AS pred,
CASE WHEN row_id % 79 = 0 THEN probs[1:8] WHEN row_id % 73 = 0 THEN list_transform(probs, lambda x: 2e0 * x) WHEN row_id % 71 = 0 THEN list_concat(['Infinity'::DOUBLE], probs[2:9]) WHEN row_id % 67 = 0 THEN list_transform(probs, lambda x: x - 0.05e0) ELSE probs END AS probs FROM preds),
f AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE row_id % 61 = 0) """ + " UNION ALL ".join(f"SELECT '{r}' AS rule, {_BROKEN.format(c)} AS n FROM f" for r, c in _RULES.items()) + " UNION ALL SELECT 'repeated_key', (count(*) - count(DISTINCT (split, row_id)))::BIGINT FROM f")
def contract_faults(spark, sf_dir):
    """The contract's counters over a frame with planted faults of every kind."""
    k = F.col("row_id")
    infinite = F.concat(F.array(F.lit(float("inf"))), F.slice("probs", 2, 8))
    probs = F.when(k % 79 == 0, F.slice("probs", 1, 8)).when(k % 73 == 0, F.transform("probs", lambda x: 2.0 * x)).when(k % 71 == 0, infinite).when(k % 67 == 0, F.transform("probs", lambda x: x - 0.05)).otherwise(F.col("probs"))
    once = S.predictions(spark, sf_dir, (SERVED,)).select("row_id", F.when(k % 89 == 0, "dev").otherwise(F.col("split")).alias("split"), F.when(k % 97 == 0, 12).otherwise(F.col("label")).alias("label"), F.when(k % 83 == 0, -1).otherwise(F.col("pred")).alias("pred"), probs.alias("probs"))
    return contracts.violations(once.unionByName(once.where(k % 61 == 0)), S.CLASSES)


@query("WITH " + sql.frame((POOLED,), "test") + ", c AS (SELECT row_id, ((row_id * 7919) % 10007) / 10007e0 AS u, probs FROM preds) SELECT row_id, least(8, len(list_filter(range(1, 10), lambda i: list_sum(probs[1:i]) <= u)))::INT AS drawn FROM c")
def categorical_sample(spark, sf_dir):
    """Inverse-CDF draw of a class for each row, by a uniform number of its key."""
    u = (F.col("row_id") * 7919 % 10007) / F.lit(10007.0)
    upto = F.transform("probs", lambda _, i: F.aggregate(F.slice("probs", 1, i + 1), F.lit(0.0), lambda s, x: s + x))
    drawn = F.least(F.lit(8), F.size(F.filter(upto, lambda c: c <= u)))
    return S.predictions(spark, sf_dir, (POOLED,), "test").select("row_id", drawn.alias("drawn"))


@query()
def sentence_split(spark, sf_dir):
    """Sentences of all documents: DuckDB's regular expressions have no look-behind, so tests compare with Python's."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
