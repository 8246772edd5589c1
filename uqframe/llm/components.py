"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v). Large: every larger neighbour of u goes to u's least neighbour; small: the lesser ones do."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """``edges`` has columns a and b (bigint). Returns ``node`` and ``component``, the least node it can reach.

    Only nodes with an edge to another node appear; null ends and loops count as nothing. Each round is written to the
    shared folder, so lost executors cost at most one round. Least neighbours are combined before the shuffle and joined
    back, so a node with very many neighbours is never gathered.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    now, before = cut(e, name), None
    for _ in range(most_rounds):
        last = now
        now = cut(_star(_star(last, True), False), name)
        discard(last)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
        before = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
