"""Whitening against exact rational covariances and a plain eigen-solve."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from uqframe.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, key string, x string, n int"


def grid(v):
    return tuple(math.floor(64 * c) + 1_000_000 for c in v)


def good(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)


def exact_covariance(fit):
    n, d = len(fit), len(fit[0])
    mean = [Fraction(sum(x[i] for x in fit), n) for i in range(d)]
    return [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]


def check(rows, vectors, components):
    """``rows`` of the query for (vec_id, vector) pairs."""
    kept = [(k, grid(v)) for k, v in vectors if good(v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    total = np.array(fit).sum(axis=0)
    v = np.array([[float(c) for c in r] for r in exact_covariance(fit)]) if n * d * d < 200_000 else np.cov(np.array(fit, float).T, bias=True)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(components, d)
    assert len(rows) == len(kept) * count
    by = {}
    for r in rows:
        by.setdefault(r.component, []).append((r.vec_id, r.deviation, r.whitened, r.n, r.explained, r.identity_error))
    order = lambda a: sorted(a, key=lambda t: (t[0] is None, t[0] or 0, *t[1:2]))
    expect = [(k, sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, total)), x) for k, x in kept]
    for c in range(1, count + 1):
        got = order(by[c])
        assert [(g[0], g[1]) for g in got] == [(e[0], e[1]) for e in order(expect)]
        assert {g[3] for g in got} == {n}
        assert got[0][4] == pytest.approx(values[c - 1] / np.trace(v), rel=1e-4, abs=1e-12)
        assert got[0][5] <= 1e-4
        w = np.array([g[2] for g in got])
        plain = np.array([(np.array(e[2]) - total / n) @ axes[:, c - 1] / math.sqrt(values[c - 1]) for e in order(expect)])
        assert np.abs(np.abs(w) - np.abs(plain)).max() < 1e-6


def test_slices_give_the_exact_sum():
    rng = np.random.default_rng(5)
    high = rng.normal(size=(300, 4)) * [1e6, 1.0, 1e-3, 7.0]
    low = high * rng.normal(size=(300, 4)) * 1e-17
    m = whitening.Moments(4)
    for part in np.array_split(np.arange(300), 3):
        own = whitening.Moments(4)
        own.add(high[part], low[part])
        m.plus(own.high, own.low)
    for i in range(4):
        for j in range(4):
            exact = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(e)) for a, b, c, e in zip(high[:, i], low[:, i], high[:, j], low[:, j]))
            found = Fraction(m.high[i, j]) + Fraction(m.low[i, j])
            assert abs(found - exact) < Fraction(1, 2**70) * Fraction(1e12) * 300
            if i == j == 0:
                assert abs(found - exact) < exact / 2**75


def test_cancelling_rows_keep_what_a_double_loses():
    # values near 1e6 that differ by one grid step: a naive sum of squares has no digit of the variance left
    rng = random.Random(1)
    fit = [[1_000_000 + rng.randint(0, 1), 1_000_000 + rng.randint(0, 3)] for _ in range(1000)]
    mean = np.array(fit).mean(axis=0)
    m = whitening.Moments(2)
    m.add(np.array(fit) - mean, np.zeros((1000, 2)))
    assert np.allclose((m.high + m.low) / 1000, np.cov(np.array(fit).T, bias=True), rtol=1e-14)


def sample(n, d, seed):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1 + k) for k in range(d)]) for i in range(n)]


def test_rows_are_dropped_and_repeated_vectors_fit_once(spark):
    vectors = sample(120, 5, 2)
    same = vectors[3][1]
    vectors += [(500 + i, same) for i in range(200)] + [(None, same), (7, same), (7, same)]
    vectors += [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [1e3, -1e3, 0.0, 0.0, -0.0])]
    vectors = [(k, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for k, v in vectors]
    df = spark.createDataFrame([(k, v, "a", "b", 1) for k, v in vectors], SCHEMA).repartition(6)
    done = whitening.whiten(df, components=3)
    rows = done.selectExpr("vec_id", "n", "cast(deviation as bigint) deviation", "identity_error", "posexplode(arrays_zip(whitened, explained)) as (at, c)")
    check(rows.selectExpr("*", "at + 1 as component", "c.whitened", "c.explained").collect(), vectors, 3)


def test_many_parts_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "ROWS_PER_DIM", 1)
    fit = [grid(v) for _, v in sample(90, 3, 4)]
    df = spark.createDataFrame([(list(x),) for x in fit], "x array<bigint>").repartition(9)
    model = whitening.learn(df, 3)
    v = exact_covariance(fit)
    assert sum(model.eigenvalues) == pytest.approx(float(sum(v[i][i] for i in range(3))), rel=1e-13)
    assert model.identity_error < 1e-12 and sum(model.explained) == pytest.approx(1)


def test_no_rows_one_vector_and_no_variance(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0], "", "", 0)] * 3, SCHEMA)).collect()
    assert [(r.vec_id, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, [0.0, 0.0], [0.0, 0.0], 0.0)] * 3
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0], "", "", 0) for i in range(10)], SCHEMA)).collect()
    assert all(r.whitened[1] == 0.0 for r in line) and sum(r.whitened[0] ** 2 for r in line) == pytest.approx(10)
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0], "", "", 0), (2, [1.0, 2.0], "", "", 0)], SCHEMA))


def test_deviations_beyond_a_long():
    x = np.array([[10**11, -(10**11)], [0, 5]])
    m = whitening.Whitening(10**6, (3, 4), np.zeros(2), np.zeros(2), np.ones(2), np.eye(2), (), 0.0)
    assert [int(v) for v in m.deviations(x).to_pylist()] == [(10**17 - 3) ** 2 + (10**17 + 4) ** 2, 9 + (5 * 10**6 - 4) ** 2]


def test_whole_query(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(queries.op13_embedding_whitening(spark, sf_dir).collect(), vectors, 16)
