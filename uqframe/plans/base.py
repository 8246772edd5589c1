"""Queries over the surrogate predictions and the driver's tables, each beside its DuckDB counterpart.

All floating results are rounded to six decimals on both sides; every order is total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.functions import text as X
from uqframe.functions import vectors as V
from uqframe.operators import contracts, ensembles, metrics, paired, prep, ranking, resample, rules, selective, temperature, template
from uqframe.plans import sql
from uqframe.sources import surrogate as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SYS = S.SYSTEM
SERVED, POOLED = ("imgA", "pgs", "argmax"), ("imgA", "pgs", "pgs")


def query(text: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return register


def r6(c: Column | str) -> Column:
    """Six decimals; a negative zero becomes zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def test_rows(spark: SparkSession, sf_dir: str, systems=S.SYSTEMS) -> DataFrame:
    return S.predictions(spark, sf_dir, systems, "test")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *plain: str) -> DataFrame:
    """All double columns to six decimals."""
    return df.select(*[r6(c).alias(c) if t == "double" and c not in plain else F.col(c) for c, t in df.dtypes])


FRAME = "WITH " + sql.frame() + " "
TEST = "WITH " + sql.frame(split="test") + ", " + sql.ROWS + " "
PAIR = "WITH " + sql.frame((SERVED, POOLED), "test") + ", " + sql.ROWS + " "
