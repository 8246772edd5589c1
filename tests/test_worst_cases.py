"""Worst cases of printed accuracies against every pair of counts; exact tails of many pairs."""

import math
import time

from pyspark.sql import functions as F

from uqframe.operators import paired


def tail(b, c):
    n, m = b + c, min(b, c)
    term = total = 1
    for i in range(1, m + 1):
        term = term * (n - i + 1) // i
        total += term
    return min(1.0, 2 * total / 2**n)


def test_equals_all_pairs(spark):
    cases = [("a", 3001, 0.75, 0.7423, None), ("b", 3001, 0.75, 0.7423, 40), ("c", 2999, 0.61, 0.6099, 7), ("d", 25_000, 0.5, 0.5, None), ("e", 3001, 0.75, 0.7423, 3), ("f", 20_001, 0.9, 0.1, None), ("g", 40_001, 0.75, 0.7, 30), ("h", 40_001, 0.75, 0.749, 40)]
    got = {r.row: (r.k_better, r.k_worse, r.b, r.c, r.p) for r in paired.worst_cases(spark.createDataFrame(cases, "row string, n bigint, better double, worse double, most bigint"), ["row"]).collect()}
    for name, n, hi, lo, most in cases:
        fits = lambda a: [k for k in range(int((a - 1e-4) * n), int((a + 1e-4) * n) + 2) if round(k / n, 4) == a]
        tried = []
        for kb in fits(hi):
            for kw in fits(lo):
                d = kb - kw
                t = 2 * (n - kb) + d
                if most is not None:
                    t = min(t, most - int(math.fmod(most - d, 2)))
                if d > 0 and t >= d:
                    tried.append((kb, kw, (t - d) // 2 + d, (t - d) // 2))
        if not tried:
            assert name not in got
        elif name == "d":  # neighbours: p is 1
            assert got[name][:2] == (min(x[0] for x in tried), min(x[1] for x in tried)) and got[name][0] - got[name][1] == 1 and abs(got[name][4] - 1) < 1e-12
        elif name == "f":  # p is 0 in a double
            assert got[name][:4] == min(tried) and got[name][4] == 0
        else:
            p, kb, kw, b, c = max((tail(b, c), -kb, -kw, b, c) for kb, kw, b, c in tried)
            assert got[name][:4] == (-kb, -kw, b, c) and abs(got[name][4] - p) < 1e-9 * p


def test_exact_tail_of_many_pairs(spark):
    pairs = [(2100, 2050), (2500, 2001), (5000, 5000), (5001, 5000), (30_000, 29_500), (9000, 2001)]
    got = spark.createDataFrame(pairs, "b bigint, c bigint").select("b", "c", paired.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        assert abs(r.p - tail(r.b, r.c)) <= 1e-9 * tail(r.b, r.c)


def test_large_samples_end(spark):
    df = spark.createDataFrame([("a", 27_000_000, 0.75, 0.7499, None)], "row string, n bigint, better double, worse double, most bigint")
    start = time.time()
    assert paired.worst_cases(df, ["row"]).count() == 1 and time.time() - start < 60
