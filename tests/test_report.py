"""Report values, decisions and fill reports against plain rules."""

import math

import pytest
from pyspark.sql import functions as F

from uqframe.functions import text as X
from uqframe.operators import paired, rules, template
from uqframe.plans import registry, report_queries


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).head())


def test_values_have_the_contract_s_keys(spark, sf_dir):
    got = registry.queries()["report_values"](spark, sf_dir).collect()
    keys = report_queries.required_keys()
    assert len(keys) == 78 == len(set(keys)) and sorted(r.key for r in got) == sorted(keys)
    assert all(r.value and "nan" not in r.value.lower() and "\n" not in r.value and "-" not in r.value.replace("Holm-", "").replace("macro-F1", "") for r in got)


def test_formats(spark):
    got = one(spark, X.fmt_temp(F.lit(0.905)), X.fmt_cov(F.lit(0.12345)), X.fmt_aurc(F.lit(0.056789)), X.fmt_cov(F.lit(None).cast("double")), X.markdown_row([F.lit("a|b"), F.lit(None).cast("string"), F.lit("x\ny"), F.lit(3)]), X.fmt_pp(F.lit(-0.0043)), X.fmt_p(F.lit(0.0421)), X.fmt_p(F.lit(0.00099)), X.fmt_metric_ci(F.lit(-0.5), F.lit(-1.0), F.lit(0.25)))
    assert got == [f"{0.905:.2f}", "0.123", "5.68", "n/a", "| a\\|b |  | x y | 3 |", "−0.43", "0.0421", "< 0.001", "−0.5000 [−1.0000, 0.2500]"]


@pytest.mark.parametrize("places", [0, 2, 3, 4, 5])
def test_numbers_print_their_exact_binary_value(spark, places):
    import random

    rng = random.Random(places)
    xs = [0.905, 0.125, 2.675, 1.005, 0.5, 1.5, 2.5, 0.00005, 1e-9, 123456.78125, 4e9 + 0.5, 1e15, 1e-300, 0.0]
    xs += [rng.randint(0, 10**6) / 10 ** (places + 1) for _ in range(3000)] + [rng.randint(0, 2**20) / 2**14 for _ in range(2000)] + [rng.random() * 10 ** rng.randint(-6, 6) for _ in range(2000)]
    xs += [math.nextafter(x, s) for x in xs[:1500] for s in (0, 1e9)]
    xs = [x for x in xs if abs(x) < 2**53 / (2 * 10**places)]  # beyond, Java prints the shortest digits
    df = spark.createDataFrame([(x,) for x in xs] + [(-x,) for x in xs], "x double")
    for r in df.select("x", X.fixed(F.col("x"), places).alias("s")).collect():
        want = f"{r.x:.{places}f}"
        assert r.s == (want.lstrip("-") if float(want) == 0 else want.replace("-", "−")), r.x


def test_decision_states(spark):
    f = lambda *xs: [F.lit(float(x)) for x in xs]
    assert one(spark, rules.calibration_change(*f(0.03, 0.02, 0.04), *f(0.05, 0.035, 0.06)), rules.calibration_change(*f(0.03, 0.02, 0.04), *f(0.05, 0.045, 0.06)), rules.calibration_change(*f(0.05, 0.045, 0.06), *f(0.03, 0.02, 0.04))) == ["unchanged", "improved", "worsened"]
    assert one(spark, rules.deferral_effect(*f(0.80001, 0.80003)), rules.deferral_effect(*f(0.9, 0.8)), rules.deferral_effect(*f(0.7, 0.8))) == ["leaves", "raises", "lowers"]
    assert one(spark, *[rules.coverage_state(F.lit(x)) for x in (0.0, 0.4, 1.0)], rules.chance_state(*f(0.4, 0.49)), rules.chance_state(*f(0.4, 0.5)), rules.chance_state(*f(0.51, 0.6))) == ["none", "partial", "full", "below", "includes", "above"]


def test_fill_report_and_exit_code(spark):
    values = spark.createDataFrame([("A", "1"), ("B", ""), ("C", "3")], "key string, value string")
    contract = spark.createDataFrame([("A",), ("D",), ("B",)], "key string")
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    got = {r.key: (r.tokens, r.state) for r in template.report(texts("⟦A⟧ ⟦A: x⟧", "⟦B⟧", None, "⟦E⟧"), values, contract).collect()}
    assert got == {"A": (2, "replaced"), "B": (1, "missing"), "E": (1, "missing"), "C": (0, "unused"), "D": (0, "contract absent")}
    code = lambda *t, **o: template.exit_code(texts(*t), values, contract, **o).head()
    assert code("⟦A⟧").code == 0 and code("⟦B⟧").code == 1 and code("⟦B⟧", allow_missing=True).code == 0 and code("⟦A", allow_missing=True).code == 1
    assert code("⟦A", None).fragments == 1
    assert template.exit_code(texts("x").where("false"), values, contract).head().code == 0


def test_the_complementary_error_function(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.0, 2.9999, 3.0, 3.5, 5.0, 9.0, 20.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", paired.erfc(F.col("x")).alias("e")).collect()
    for r in got:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-9)


def test_worst_cases_of_printed_accuracies(spark):
    rows = [("a", 0.8074, 0.7874, 9266, None), ("b", 0.8116, 0.8073, 9266, 130), ("c", 0.8116, 0.8074, 9266, 130), ("d", 0.5, 0.25, 4, None), ("e", 0.5, 0.5, 4, None), ("f", 0.3, 0.2, 4, None)]
    df = spark.createDataFrame(rows, "row string, better double, worse double, n long, most long")
    got = {r.row: r for r in paired.worst_cases(df, ["row"]).collect()}
    assert set(got) == {"a", "b", "c", "d"}  # equal accuracies and ones that no count prints as have no case
    for k, b, c, p in (("a", 1970, 1785, 0.0026712088), ("b", 85, 45, 0.0005715227), ("c", 84, 45, 0.0007558903)):
        assert (got[k].b, got[k].c) == (b, c) and got[k].p == pytest.approx(p, rel=1e-7)
        assert got[k].p_corrected == pytest.approx(math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / (b + c) / 2)), rel=1e-10)
    assert (got["d"].k_better, got["d"].k_worse) == (2, 1)
