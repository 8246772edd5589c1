"""Every registered query of the core against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from uqframe.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(frame, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return ""
        if isinstance(v, (list, np.ndarray)):
            return str([round(float(x), 5) for x in v])
        return f"{float(v):.6f}" if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want)
    if not any(got[c].map(lambda v: isinstance(v, float)).any() or want[c].map(lambda v: isinstance(v, float)).any() for c in columns):
        assert plain(got, columns) == plain(want, columns)
        return
    for a, b in zip(plain(got, columns), plain(want, columns)):
        for x, y in zip(a, b):
            try:
                assert abs(float(x) - float(y)) < 2e-6
            except ValueError:
                assert x == y


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_has_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_the_core_stands_alone():
    import subprocess
    import sys

    code = "import sys; sys.modules['uqframe.llm'] = None; import uqframe.plans.registry as r; assert r.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_monitor_streams_as_it_sums(spark, tmp_path):
    from pyspark.sql import functions as F

    from uqframe.streaming import monitor

    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 1000).alias("ts"), ((F.col("id") % 100) / 100.0).alias("confidence"), (F.col("id") % 3 > 0).alias("ok"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = monitor.binned(stream).writeStream.outputMode("complete").format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.start, r.n, round(r.ece, 9)) for r in monitor.calibration_error(df).collect())
    assert key(spark.table("bins")) == key(monitor.binned(rows))
