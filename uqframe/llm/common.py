"""Shared pieces of the training-data operators: bindings inside expressions, words, durable cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uqframe.sources.shared import shared_dir

#: White space of all word rules: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """All maximal runs of characters outside the white space class; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def hashes(ws: Column) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(ws, lambda w: F.xxhash64(w))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def count_of(text: Column, char: str) -> Column:
    """How often one character stands in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_in(text: Column, chars: str) -> Column:
    """How many characters of a text are among ``chars``."""
    return F.length(F.regexp_replace(text, "[^" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]+", ""))


def full_lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/uqframe-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: later jobs survive lost executors, lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Remove the files of tables that ``cut`` has made and nothing reads any more."""
    for df in cuts:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that are columns of ``df`` already; Spark takes names for equal whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
