"""The folder that driver and executors share, and tables kept there for a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task that computes dear expressions.
ROWS_A_TASK = 250_000
_KEPT: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of this machine in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="uqframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(spark: SparkSession, name: str, origin: str, make, partitions: list[str] | None = None) -> DataFrame:
    """The table ``make()``, written once a session for each name and origin, partitioned by ``partitions``; its columns in their own order."""
    at = (spark.sparkContext.applicationId, name, origin)
    if at not in _KEPT:
        path = f"{shared_dir(spark)}/uqframe-{name}-{uuid.uuid4().hex}"
        made = make()
        made.write.partitionBy(*partitions or []).parquet(path)
        _KEPT[at] = path
    return spark.read.parquet(_KEPT[at])


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs in here leave no shuffle files behind: each is removed when its job has ended, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def spread(df: DataFrame, key: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """``df`` over at least a partition a core and a partition for each ``rows`` rows: narrow rows before dear expressions.

    So no task grows with the table. A scan that has as many partitions already stays as it is.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < parts else df
