"""Derived tables that are made again only where their input changed.

Input files are known by name and SHA-256. A list beside the derived table records, for each file, the digest that it
was made from, its rows and the width of its vectors. Files that are new or changed, and those whose recorded rows or
width no longer hold, are read and made again; the others' partitions stay as they are. The list is written last.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uqframe.sources import files, readers

#: The column that names a row's input file, and the small document that names the current list and parts.
SOURCE, CURRENT = "source_file", "current.json"
RECORD = "file string, sha256 string, rows long, width int, part string"


def state(sha256: Column, recorded: Column, rows: Column, width: Column, expected_width: int | None) -> Column:
    """fresh, or the first reason why a file has to be made again: new, changed, or another width."""
    return F.when(recorded.isNull(), "new").when(recorded != sha256, "changed").when(rows.isNull() | (F.lit(expected_width).isNotNull() & ~width.eqNullSafe(F.lit(expected_width))), "width").otherwise("fresh")


def plan(present: DataFrame, recorded: DataFrame, expected_width: int | None = None) -> DataFrame:
    """file, path, sha256 and state (new, changed, width, fresh, gone) of present (file, path, sha256) and recorded files."""
    own = recorded.select("file", F.col("sha256").alias("was"), "rows", "width", "part")
    both = present.join(own, "file", "full")
    return both.select("file", "path", "sha256", "rows", "width", "part", F.when(F.col("sha256").isNull(), "gone").otherwise(state(F.col("sha256"), F.col("was"), F.col("rows"), F.col("width"), expected_width)).alias("state"))


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """The list of a derived table; empty where there is none yet."""
    store, place = files.file_system(files.qualified(spark, folder))
    path = f"{place}/{CURRENT}"
    if store.get_file_info(path).is_file:
        with store.open_input_stream(path) as f:
            return spark.read.schema(RECORD).parquet(f"{folder}/{json.loads(f.read())['list']}")
    return spark.createDataFrame([], RECORD)


def refresh(spark: SparkSession, inputs: str, folder: str, make: Callable[[DataFrame], DataFrame], vector: str | None = None, width: int | None = None, pattern: str = "*.parquet") -> DataFrame:
    """Bring the derived table in ``folder`` up to date with the Parquet files of ``inputs``; returns the plan it followed.

    ``make`` maps rows of input files to derived rows and keeps the column ``SOURCE``. Only stale files are read for it,
    all of them in one job. Their rows go into a new part; no part is written over, so readers of the former list are not disturbed
    and a failed run changes nothing. ``vector`` names a column whose length is recorded as the width and has to be ``width``.
    """
    present = readers.listing(spark, inputs, pattern).select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "sha256")
    was = recorded(spark, folder)
    steps = plan(present, was, width).persist()
    stale = [r["path"] for r in steps.where(F.col("state").isin("new", "changed", "width")).select("path").collect()]  # paths, as any reader takes them
    part = f"part-{uuid.uuid4().hex}"
    made = spark.createDataFrame([], RECORD)
    if stale:
        rows = make(spark.read.parquet(*stale).withColumn(SOURCE, F.col("_metadata.file_name")))
        rows.write.parquet(f"{folder}/{part}")
        size = F.max(F.size(vector)) if vector else F.lit(None).cast("int")
        counted = spark.read.parquet(f"{folder}/{part}").groupBy(F.col(SOURCE).alias("file")).agg(F.count(F.lit(1)).alias("rows"), size.alias("width"))
        again = steps.where(F.col("state").isin("new", "changed", "width")).select("file", "sha256").join(counted, "file", "left")
        made = again.select("file", "sha256", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.coalesce("width", F.lit(width).cast("int")).alias("width"), F.lit(part).alias("part"))
    kept = steps.where("state = 'fresh'").select("file", "sha256", "rows", "width", "part")
    name = f"list-{uuid.uuid4().hex}"
    kept.unionByName(made).coalesce(1).write.parquet(f"{folder}/{name}")
    files.write_json(spark, f"{folder}/{CURRENT}", {"list": name})
    return steps.select("file", "state")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a derived table that its list names: those of each file from the part it was last made in."""
    own = recorded(spark, folder)
    parts = [r["part"] for r in own.select("part").distinct().collect()]
    if not parts:
        raise ValueError(f"{folder} has no derived rows yet")
    rows = spark.read.parquet(*[f"{folder}/{p}" for p in parts])
    listed = own.select(F.col("file").alias(SOURCE), F.col("part").alias("own_part"))
    at = F.regexp_extract(F.col("_metadata.file_path"), r"(part-[0-9a-f]{32})/", 1)
    return rows.withColumn("own_part", at).join(listed, [SOURCE, "own_part"], "left_semi").drop("own_part")
