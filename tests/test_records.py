"""Edits, multimaps, exact shares, bits, pooled ensembles and derived tables against plain Python."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.functions import vectors as V
from uqframe.operators import edits, ensembles, prep, scorer
from uqframe.sources import cache

EDITS = "edit int, needle string, old string, new string, after string, insert string"


def plain_edits(texts, rows, everywhere):
    held = {e[0]: [k for k, t in texts if t and e[1] and e[1] in t] for e in rows}
    out = {}
    for k, t in texts:
        own, was = [], t
        for e, needle, old, new, after, insert in sorted(rows):
            if not was or not needle or needle not in was:
                continue
            if not everywhere and len(held[e]) != 1:
                own.append((e, "repeated"))
            elif old is None and after is None:
                t = t + (insert or "")
                own.append((e, "applied"))
            elif not (old if old is not None else after) or (old if old is not None else after) not in t:
                own.append((e, "target missing"))
            else:
                t = t.replace(old, new or "", 1) if old is not None else t.replace(after, after + (insert or ""), 1)
                own.append((e, "applied"))
        out[k] = (t, own)
    return out


@pytest.mark.parametrize("everywhere", [True, False])
def test_edits_equal_plain_replacement(spark, everywhere):
    rng = random.Random(4)
    words = ["ab", "abc", "bc", "c", "é", "xx", " "]
    text = lambda n: "".join(rng.choices(words, k=n))
    texts = [(i, text(rng.randint(0, 12))) for i in range(60)] + [(100, None), (101, ""), (102, "only here abc")]
    pick = lambda n: rng.choice([None, text(n), text(n)])
    rows = [(i, rng.choice([text(1), text(2), "only here", "nowhere", "", None]), pick(1), pick(1), pick(1), pick(1)) for i in range(40)]
    df = spark.createDataFrame(texts, "edited int, text string").repartition(3)
    e = spark.createDataFrame(rows, EDITS)
    got = edits.apply(df.withColumnRenamed("edited", "k").withColumn("row", F.lit(1)), e, everywhere=everywhere).collect()
    want = plain_edits(texts, rows, everywhere)
    assert {r.k: (r.edited, [tuple(o) for o in r.outcomes]) for r in got} == want and all(r.row == 1 for r in got)
    assert edits.apply(df, e, everywhere=everywhere).columns == ["text", "edited", "outcomes"]
    report = {r.edit: (r.texts, r.applied, r.state) for r in edits.report(df, e, everywhere=everywhere).collect()}
    for row in rows:
        own = [o for _, outs in want.values() for i, o in outs if i == row[0]]
        state = "unmatched" if not own else "repeated" if "repeated" in own else "target missing" if "target missing" in own else "applied"
        assert report[row[0]] == (len(own), own.count("applied"), state)


def test_edits_without_edits_and_too_many(spark, monkeypatch):
    df, none = spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], EDITS)
    assert [tuple(r) for r in edits.apply(df, none).collect()] == [("a", "a", [])] and edits.report(df, none).count() == 0
    monkeypatch.setattr(edits, "MOST_EDITS", 1)
    with pytest.raises(ValueError):
        edits.apply(df, spark.createDataFrame([(1,), (2,)], "edit int"))


def test_multimaps_keep_order_and_split_hot_keys(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", None, ""]), rng.choice([None, *range(150)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "part string, value int, at int").repartition(4)
    want = {}
    for k, v, _ in rows:
        if v is not None:
            want.setdefault(k, {}).setdefault(v)
    got = {}
    for r in sorted(prep.multimap(df, "part", "value", "at", 20).collect(), key=lambda r: r[1]):
        assert len(r["values"]) <= 20
        got.setdefault(r[0], []).extend(r["values"])
    assert got == {k: list(v) for k, v in want.items()}
    assert prep.multimap(df.limit(0), "part", "value", "at").count() == 0


@pytest.mark.parametrize("share", [0.0, 0.01, 0.25, 0.5, 1.0])
@pytest.mark.parametrize("buckets", [1, 4, 1 << 14])
def test_shares_are_exact(spark, share, buckets):
    rows = [(i, "hot" if i % 3 else None) for i in range(300)] + [(1000 + i, "") for i in range(7)] + [(5, "same")] * 9
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "key int, name string, row string, bucket int").repartition(5)
    got = prep.exact_share(df, "name", "key", share, buckets=buckets).collect()
    assert len(got) == len(rows)
    order = lambda k: (hashlib.md5(f"42-{k}".encode()).hexdigest(), k)
    for g in ("hot", None, "", "same"):
        own = sorted((r[0] for r in rows if r[1] == g), key=order)
        picked = sorted((r.key for r in got if r.name == g and r.picked), key=order)
        assert picked == own[: round(share * len(own))]
    assert df.columns + ["picked"] == prep.exact_share(df, "name", "key", share).columns


def test_bits(spark):
    one = lambda x: math.nan if x is None else x
    values = [0.0, -0.0, 1.0, 1.0 + 2**-52, math.nan, math.inf, -math.inf, 5e-324, -5e-324]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double").select("a", "b", V.same_bits(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        assert r.s == (struct.pack("<d", one(r.a)) == struct.pack("<d", one(r.b)))
    rows = [([1.0, None], [1.0, None], 0), ([1.0], [1.0, 2.0], 1), ([], [], 0), (None, [1.0], None), ([0.0, 1.0], [-0.0, 1.5], 2), ([None], [1.0], 1), ([1.0, 2.0], [1.0, None], 1)]
    d = spark.createDataFrame(rows, "a array<double>, b array<double>, n int").select("n", V.bits_that_differ(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in d] == [r.n for r in d]


def test_ensembles_equal_the_columns_operator(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    w = rng.normal(size=(3, 5, 4))
    got = {r.id: r for r in scorer.apply_ensemble(df, "id", "v", lambda x: np.einsum("ni,imk->nmk", x, w), 5, 4, keep_members=True).collect()}
    want = df.where("v is not null").select("id", ensembles.pool(spark_members(w, F.col("v"))).alias("u")).collect()
    for r in want:
        g = got[r.id]
        for term in ("mi", "pred_entropy", "exp_entropy", "prob_std"):
            assert g[term] == pytest.approx(r.u[term], abs=1e-12)
        assert np.allclose(g.probs, r.u.probs) and np.allclose(g.loglin, r.u.loglin) and g.pred == int(np.argmax(g.probs)) and g.pred_loglin == int(np.argmax(g.loglin)) and np.shape(g.members) == (5, 4)
    assert got[99].probs is None and got[99].members is None and len(got) == 51
    assert scorer.apply_ensemble(df.limit(0), "id", "v", lambda x: x, 5, 4).count() == 0


def spark_members(w, v):
    return F.array(*[F.array(*[sum((F.get(v, i) * float(w[i, m, k]) for i in range(w.shape[0])), F.lit(0.0)) for k in range(w.shape[2])]) for m in range(w.shape[1])])


def test_outputs_of_another_shape_or_without_end_raise(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0])], "id int, v array<double>")
    with pytest.raises(Exception, match="shape"):
        scorer.apply_ensemble(df, "id", "v", lambda x: np.zeros((len(x), 2, 2)), 3, 2).collect()
    with pytest.raises(Exception, match="has key 7"):
        scorer.apply_ensemble(df, "id", "v", lambda x: np.full((len(x), 3, 2), np.inf), 3, 2).collect()


def test_only_changed_files_are_read_again(spark, tmp_path):
    inputs, out = tmp_path / "in", str(tmp_path / "out")
    inputs.mkdir()

    def put(name, values):
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"x": pa.array(values, pa.int64())}), inputs / f"{name}.parquet")

    read = []

    def make(df):
        read.append(sorted(p.rsplit("/", 1)[1] for p in df.inputFiles()))
        return df.select(cache.SOURCE, F.array("x", F.lit(1).cast("long")).alias("v"))

    def run(**options):
        read.clear()
        steps = {r.file[:-8]: r.state for r in cache.refresh(spark, str(inputs), out, make, "v", **options).collect()}
        return steps, [f for own in read for f in own], sorted((r[cache.SOURCE][:-8], r.v[0]) for r in cache.read(spark, out).collect())

    put("a", [1, 2]), put("b", [3]), put("c", [])
    steps, seen, rows = run()
    assert steps == {"a": "new", "b": "new", "c": "new"} and seen == ["a.parquet", "b.parquet", "c.parquet"] and rows == [("a", 1), ("a", 2), ("b", 3)]
    steps, seen, rows = run()
    assert set(steps.values()) == {"fresh"} and seen == [] and len(rows) == 3
    put("b", [4, 5]), put("d", [6])
    (inputs / "a.parquet").unlink()
    steps, seen, rows = run()
    assert steps == {"a": "gone", "b": "changed", "c": "fresh", "d": "new"} and seen == ["b.parquet", "d.parquet"] and rows == [("b", 4), ("b", 5), ("d", 6)]
    steps, seen, _ = run(width=3)
    assert {steps["b"], steps["d"]} == {"width"} and "b.parquet" in seen
    put("b", [7])
    with pytest.raises(Exception, match="lost"):
        cache.refresh(spark, str(inputs), out, lambda df: df.select(cache.SOURCE, F.raise_error(F.lit("lost")).alias("v")))
    assert sorted(r.v[0] for r in cache.read(spark, out).collect()) == [4, 5, 6]  # as before


def test_derived_refresh_holds_where_sorted_partitions_come_in_another_order(spark, sf_dir, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from uqframe.plans import registry

    calls = iter(range(1000))  # as on a cluster, where coalesce takes partitions by their hosts: another order at each call
    monkeypatch.setattr(DataFrame, "coalesce", lambda df, n: df.repartition(n).sortWithinPartitions(F.xxhash64(F.col(df.columns[0]), F.col(df.columns[1]), F.lit(next(calls)))))
    states = sorted(r.state for r in registry.queries()["derived_refresh"](spark, sf_dir).collect())
    assert states == ["changed", "fresh", "fresh", "gone", "new"]
