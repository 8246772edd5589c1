"""Split tables, alignment, reproduction flags, drop counts and result tables by hand."""

import pytest
from pyspark.sql import functions as F

from uqframe.operators import contracts, prep
from uqframe.sources import files, readers


def test_split_faults_by_hand(spark):
    rows = [("train", 1, 0, [1.0]), ("train", 1, 1, [1.0]), ("train", -2, 0, [float("nan")]), ("val", 1, 2, [1.0, 2.0]), ("val", 3, 5, None), ("odd", None, None, [None])]
    df = spark.createDataFrame(rows, "split string, row_id long, label int, v array<double>")
    got = {(r.split, r.rule): r.n for r in contracts.split_faults(df, 3, ("train", "val", "test"), "v", 1).collect()}
    assert got == {
        ("train", "negative_id"): 1, ("train", "not_finite"): 1, ("train", "repeated_id"): 1, ("train", "shared_id"): 1, ("train", "missing_class"): 1,
        ("val", "label_range"): 1, ("val", "shared_id"): 1, ("val", "not_finite"): 1, ("val", "width"): 2, ("val", "missing_class"): 2, ("test", "missing_class"): 3,
        ("odd", "negative_id"): 1, ("odd", "label_range"): 1, ("odd", "unknown_split"): 1, ("odd", "not_finite"): 1,
    }
    assert contracts.split_faults(df.where("false"), 2, ("train",)).collect() == [("train", "missing_class", 2)]


def test_alignment_is_strict(spark):
    df = lambda *rows: spark.createDataFrame(rows, "k int, label int, at int")
    base = df((1, 0, 0), (2, 1, 1), (3, 0, 2))
    got = contracts.aligned(df((3, 0, 9), (1, 0, 9), (2, 1, 9)).drop("at"), base, ["k"], "at").collect()
    assert sorted((r.k, r["at"]) for r in got) == [(1, 0), (2, 1), (3, 2)]
    for bad, said in (([(1, 0, 0), (2, 1, 0)], "missing: 1"), ([(1, 0, 0), (2, 1, 0), (3, 0, 0), (4, 0, 0)], "unexpected: 1"), ([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "label_differs: 1"), ([(1, 0, 0), (2, 1, 0), (3, 0, 0), (3, 0, 0)], "repeated: 1")):
        with pytest.raises(contracts.ContractViolation, match=said):
            contracts.aligned(df(*bad).drop("at"), base, ["k"], "at")


def test_reproduction_flags_are_null_without_expectations(spark):
    rows = [("a", 0.81234, [0.8123, 0.9], 0.8123), ("b", 0.81236, [0.8123], None), ("c", 0.5, [], 0.5), ("d", 0.5, None, 0.6), ("e", 0.7, [0.9, 0.6], 0.9)]
    df = spark.createDataFrame(rows, "k string, v double, e array<double>, r double")
    got = {r.k: (r.nearest, None if r.off_pp is None else round(r.off_pp, 6), r.by_computed, r.by_manifest, r.drifted) for r in contracts.reproduction(df, ["k"], "v", "e", "r").collect()}
    assert got == {"a": (0.8123, 0.004, True, True, False), "b": (0.8123, 0.006, False, None, None), "c": (None, None, None, None, False), "d": (None, None, None, None, True), "e": (0.6, 10.0, False, True, True)}


def test_drop_counts_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (4, "d")], "x int, t string")
    got = [tuple(r) for r in prep.drop_counts(df, {"x": F.col("x") > 1, "t": F.col("t").isNotNull()}).orderBy("place").collect()]
    assert got == [(0, "raw", 4, 0), (1, "x", 2, 2), (2, "t", 1, 1)]
    assert [tuple(r) for r in prep.drop_counts(df.where("false"), {"x": F.col("x") > 1}).orderBy("place").collect()] == [(0, "raw", 0, 0), (1, "x", 0, 0)]


def test_export_plans(spark):
    got = contracts.export_plan(spark.createDataFrame([("i__t",)], "tag string"), ("cb", "pgs"), ("argmax",), spark.createDataFrame([("preds__i__t__pgs__argmax.csv.gz",)] * 2, "file string")).collect()
    assert sorted((r.file, r.there) for r in got) == [("preds__i__t__cb__argmax.csv.gz", False), ("preds__i__t__pgs__argmax.csv.gz", True)]


def test_result_tables_and_their_bound(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 'x "y", z'), ("a", 1, None), ("c", None, "p|q")], "k string, n int, t string")
    files.write_tables(spark, str(tmp_path), {"one": df, "two": df.select("n")}, {"one": ["n"]})
    assert (tmp_path / "one.csv").read_text() == 'k,n,t\nc,,p|q\na,1,\nb,2,"x ""y"", z"\n'
    assert (tmp_path / "tables.md").read_text() == '## one\n\n| k | n | t |\n| --- | --- | --- |\n| c |  | p\\|q |\n| a | 1 |  |\n| b | 2 | x "y", z |\n\n## two\n\n| n |\n| --- |\n|  |\n| 1 |\n| 2 |\n'
    with pytest.raises(ValueError):
        files.write_tables(spark, str(tmp_path), {"one": df}, most_rows=2)


def test_metadata_with_another_header_raises(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,text\n1,"a ""b"",\nc"\n2,\n')
    got = readers.read_metadata(spark, str(tmp_path / "m.csv"), "id int, text string").collect()
    assert [tuple(r) for r in got] == [(1, 'a "b",\nc'), (2, None)]
    with pytest.raises(Exception):
        readers.read_metadata(spark, str(tmp_path / "m.csv"), "text string, id int").collect()


def test_transient_failures_stop_a_preparation(spark):
    df = spark.createDataFrame([(1, None), (2, "http_404"), (3, "http_500"), (4, "timeout"), (5, "timeout")], "id int, status string")
    with pytest.raises(ValueError, match="http_500: 1, timeout: 2"):
        prep.settled_failures(df, "status")
    assert sorted(r.id for r in prep.settled_failures(df, "status", allow_transient=True).collect()) == [2, 3, 4, 5]
    assert [r.id for r in prep.settled_failures(df.where("id < 3"), "status").collect()] == [2]
