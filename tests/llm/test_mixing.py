"""Source mixing: the exponent's bisection, and budgets met row by row."""

import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from uqframe.llm import mixing, queries


def test_temperature_reaches_the_entropy():
    tokens = [1000, 100, 10]
    p = mixing.temperature(tokens, sum(tokens), entropy=0.6, most_passes=1e9)
    assert p.entropy == pytest.approx(0.6 * math.log(3), abs=1e-9)
    assert p.weights == pytest.approx([(t**p.exponent) / sum(u**p.exponent for u in tokens) for t in tokens])
    assert mixing.temperature([5, 5], 10).exponent == 1.0
    assert mixing.temperature([7], 7).weights == (1.0,)
    assert mixing.temperature([], 0).weights == ()


def test_temperature_keeps_the_limit_of_passes():
    tokens = [10_000, 10]
    p = mixing.temperature(tokens, sum(tokens), entropy=1.0, most_passes=4)
    assert max(sum(tokens) * w / t for w, t in zip(p.weights, tokens)) == pytest.approx(4, rel=1e-6)


def test_a_budget_beyond_all_passes_raises():
    with pytest.raises(ValueError, match="passes"):
        mixing.temperature([100, 10], 1100, most_passes=4)
    assert mixing.temperature([100, 10], 440, most_passes=4).exponent == pytest.approx(1.0)


def test_budgets_are_met_within_a_row(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", " ".join(["w"] * (i % 11))) for i in range(1500)] + [(2000, None, "a b"), (2001, "", "c"), (2002, "empty", ""), (2003, "empty", None)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id bigint, source string, text string, s string, n int").repartition(4)
    plan, p = mixing.draw_plan(df)
    own = {r.s: r for r in plan.collect()}
    drawn = mixing.mix(df).collect()
    passes = Counter(r.doc_id for r in drawn)
    assert sorted(r["__pass"] for r in drawn if r.doc_id == 2000) == list(range(passes[2000]))
    size = {k: len((t or "").split()) for k, _, t in rows}
    name = {k: "" if s is None else "s" + s for k, s, _ in rows}
    given = Counter()
    for k, n in passes.items():
        given[name[k]] += n * size[k]
    for s, r in own.items():
        assert r.budget <= given[s] < r.budget + 11
        counts = {passes[k] for k in name if name[k] == s}
        assert counts <= {r.passes, r.passes + 1}
    assert passes[2002] == passes[2003] == 1
    assert sum(r.weight for r in own.values()) == pytest.approx(1)
    assert Counter(r.doc_id for r in mixing.mix(df.repartition(7)).collect()) == passes


def test_each_pass_is_a_permutation_of_its_own(spark):
    rows = [(i, "small", f"t{i} a b") for i in range(700)] + [(i, "large", f"t{i} " * 40) for i in range(1000, 1600)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    plan, _ = mixing.draw_plan(df)
    own = {r.s[1:]: r for r in plan.collect()}
    assert own["small"].passes >= 2 and own["small"].blocks > 1
    orders = {}
    for r in mixing.mix(df).collect():
        orders.setdefault((r.source, r["__pass"]), []).append((r["__block"], r["__row"], r.doc_id))
    orders = {k: [x[2] for x in sorted(v)] for k, v in orders.items()}
    for s, r in own.items():
        whole = [orders[s, p] for p in range(r.passes)]
        every = sorted(k for k, source, _ in rows if source == s)
        assert all(sorted(x) == every for x in whole) and len({tuple(x) for x in whole}) == r.passes
        # the part of one more pass is where that pass's own order begins: whole blocks, then a part of one
        part = orders.get((s, r.passes), [])
        assert r.rest <= sum(len(t.split()) for k, source, t in rows if source == s and k in set(part)) < r.rest + 41 or not r.rest


def test_empty_and_repeated_rows(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0
    same = spark.createDataFrame([(1, "a", "x y")] * 5 + [(None, "b", "z")], "doc_id bigint, source string, text string")
    assert mixing.mix(same).where(F.col("source") == "b").count() >= 1
    assert len({tuple(r) for r in mixing.mix(same).where("doc_id = 1").groupBy("__pass").count().select("count").collect()}) == 1


def of(*values):
    """xxhash64 over a row's values as Spark chains it, signed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def test_whole_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()]
    by = {}
    for k, source, text in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        by.setdefault("" if source is None else "s" + source, []).append((k, source, n, of("17 row", k, of(text or ""))))
    names = sorted(s for s in by if sum(r[2] for r in by[s]))
    tokens = [sum(r[2] for r in by[s]) for s in names]
    budgets = dict(zip(names, (round(sum(tokens) * w) for w in mixing.temperature(tokens, sum(tokens)).weights)))
    want = Counter()
    for s, rows in by.items():
        total, blocks = sum(r[2] for r in rows), max(1, len(rows) // mixing.BLOCK_ROWS)
        passes, rest = divmod(budgets[s], total) if total else (1, 0)
        at = lambda r, p: (of("17 block", s, of(r[3]) % blocks, p), of("17 place", r[3], p))
        drawn, upto = dict.fromkeys(rows, passes), 0
        for place in sorted({at(r, passes) for r in rows}):
            if upto >= rest:
                break
            for r in rows:
                if at(r, passes) == place:
                    drawn[r] += 1
                    upto += r[2]
        for r, n in drawn.items():
            want.update((r[0], r[1], p, *at(r, p), r[2]) for p in range(n))
    assert Counter(map(tuple, queries.op1_source_mixing(spark, sf_dir).collect())) == want
