"""Preparation of raw rows: cleaning, first-wins deduplication, dictionaries, stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.functions import text as X
from uqframe.operators.ranking import running

#: States of a fetch that no retry mends.
PERMANENT = ("http_404", "http_410", "missing_id", "not_an_image")
#: Strata whose sizes may be broadcast; more are joined.
MOST_BROADCAST = 100_000
#: Values of one part of a multimap, and buckets of each group's histogram when an exact share is picked.
PART_VALUES, SHARE_BUCKETS = 1_000, 1 << 14


def non_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` are neither null nor blank."""
    keep = None
    for c in columns:
        one = F.length(X.strip(F.col(c).cast("string"))) > 0
        keep = one if keep is None else keep & one
    return df.where(keep)


def first_wins(df: DataFrame, by: str, order: str) -> DataFrame:
    """The row of least ``order`` of each value of ``by``, map-side combined; a null value is a value."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(by, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def last_wins(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The last value of each key, with the place where the key came first."""
    return df.groupBy(by).agg(F.max_by(value, order).alias(value), F.min(order).alias("first_at"))


def encode(df: DataFrame, dictionary: DataFrame, name: str, code: str = "label_id") -> DataFrame:
    """``df`` with the code of ``name``; rows whose name is not in the dictionary are dropped, as unmapped labels are."""
    return df.join(dictionary, name)


def quotas(n: Column, shares: tuple[float, ...]) -> list[Column]:
    """Cumulative row counts of each share, the last one all rows."""
    out, upto = [], 0.0
    for s in shares[:-1]:
        upto += s
        out.append(F.rint(n * F.lit(upto)).cast("bigint"))
    return [*out, n]


def stratified_split(df: DataFrame, stratum: str, key: str, names: tuple[str, ...] = ("train", "val", "test"), shares: tuple[float, ...] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``df`` with ``split``: within each stratum, rows in the order of md5(seed-key) fill the quotas."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    # a stratum may be null, which a join would lose; 13 hex digits of the hash order as it does and are exact as a double
    stratum_key = {"__null": F.col(stratum).isNull(), "__s": F.coalesce(F.col(stratum).cast("string"), F.lit(""))}
    keyed = df.withColumns({**stratum_key, "__h": h, "__p": F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint")})
    size = df.select(*[c.alias(k) for k, c in stratum_key.items()]).groupBy("__null", "__s").agg(F.count(F.lit(1)).alias("__n"))
    if size.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:  # few strata may be hot: their rows stay where they were ranked
        size = F.broadcast(size)
    placed = running(keyed, ["__null", "__s"], ["__p", "__h", key], {"__k": F.lit(1)}).join(size, ["__null", "__s"])
    out = F.lit(names[-1])
    for name, upto in reversed(list(zip(names[:-1], quotas(F.col("__n"), shares)))):
        out = F.when(F.col("__k") <= upto, name).otherwise(out)
    return placed.withColumn("split", out).select(*df.columns, "split")


def available(df: DataFrame, failed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows that did not fail and are present."""
    return df.join(failed.select(key), key, "left_anti").join(present.select(key), key, "left_semi")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def summary(df: DataFrame, distinct: list[str], extent: list[str]) -> DataFrame:
    """Rows, distinct non-null values, least and greatest value: one row."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct], *[f(c).alias(f"{n}_{c}") for c in extent for n, f in (("min", F.min), ("max", F.max))])


def multimap(df: DataFrame, key: str, value: str, order: str, part_values: int = PART_VALUES) -> DataFrame:
    """key, part and values: each key's distinct values in the order in which they came first, ``part_values`` a part.

    Parts of a key follow each other from 0, so a key with very many values is no one row and no one task. A null key
    is a key; null values are left out. ``order`` is a number.
    """
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.min(order).alias("first"))
    named = seen.withColumns({"none": F.col("key").isNull(), "name": F.coalesce(F.col("key").cast("string"), F.lit(""))})
    placed = running(named, ["none", "name"], ["first", "value"], {"k": F.lit(1)}).withColumn("part", F.floor((F.col("k") - 1) / part_values).cast("int"))
    parts = placed.groupBy("none", "name", "part").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("k", "value"))).alias("v"))
    return parts.select(F.col("key").alias(key), "part", F.transform("v", lambda x: x["value"]).alias("values"))


def exact_share(df: DataFrame, group: str, key: str, share: float, name: str = "picked", seed: int = 42, buckets: int = SHARE_BUCKETS) -> DataFrame:
    """``df`` with a boolean ``name``, true for exactly share * n of the n rows of each group, rounded half to even.

    Rows of least md5(seed-key) are picked, then of least key. A histogram of the hashes finds the bucket in which a
    group's share ends; only that bucket is put in order, so no task orders a group. A null group is a group; of rows
    of one key, as many as are needed.
    """
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    own = df.select(F.struct(*[F.col(c) for c in df.columns if c != name]).alias("row"), F.col(group).isNull().alias("none"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"), h.alias("h"), F.col(key).alias("key"))
    own = own.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(1 << 32)).cast("int"))
    upto = F.sum("n").over(Window.partitionBy("none", "name").orderBy("bucket"))
    sized = own.groupBy("none", "name", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumns({"upto": upto, "want": F.rint(F.sum("n").over(Window.partitionBy("none", "name")) * share).cast("bigint")})
    ends = sized.where("upto >= want and upto - n < want").select("none", "name", F.col("bucket").alias("last"), (F.col("want") - F.col("upto") + F.col("n")).alias("rest"))
    met = own.join(ends, ["none", "name"], "left")  # a group whose share is no row has no end
    clear = met.where("last is null or bucket <> last").withColumn("p", F.coalesce(F.col("bucket") < F.col("last"), F.lit(False)))
    ordered = met.where("bucket = last").withColumn("p", F.row_number().over(Window.partitionBy("none", "name").orderBy("h", "key")) <= F.col("rest"))
    return clear.unionByName(ordered).select(*[F.col("row")[c].alias(c) for c in df.columns if c != name], F.col("p").alias(name))


def drop_counts(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """step, rows and dropped: how many rows are left after each of ``steps`` (conditions to keep a row, in order), in one pass.

    The first row is ``raw``. A null condition drops.
    """
    kept, alive = [], F.lit(True)
    for name, condition in steps.items():
        alive = alive & F.coalesce(condition, F.lit(False))
        kept.append((name, alive))
    one = df.agg(F.count(F.lit(1)).alias("n0"), *[F.count_if(c).alias(f"n{i + 1}") for i, (_, c) in enumerate(kept)])
    names = ["raw", *steps]
    entries = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("step"), F.col(f"n{i}").alias("rows"), (F.col(f"n{max(i - 1, 0)}") - F.col(f"n{i}")).alias("dropped")) for i, n in enumerate(names)])
    return one.select(F.explode(entries).alias("e")).select("e.*")


def failure_kind(status: Column) -> Column:
    """none for null, permanent for what no retry mends, else transient."""
    return F.when(status.isNull(), "none").when(status.isin(*PERMANENT), "permanent").otherwise("transient")


def settled_failures(df: DataFrame, status: str, allow_transient: bool = False) -> DataFrame:
    """Rows that failed; ValueError names the transient states among them, since a retry could still change the result."""
    failed = df.where(F.col(status).isNotNull())
    if not allow_transient:
        left = failed.where(failure_kind(F.col(status)) == "transient").groupBy(status).agg(F.count(F.lit(1)).alias("n")).orderBy(status).limit(100).collect()
        if left:
            raise ValueError("possibly transient failures: " + ", ".join(f"{r[status]}: {r['n']}" for r in left))
    return failed
