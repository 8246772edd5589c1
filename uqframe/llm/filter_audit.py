"""Filter interaction audit: what every filter removes in every order of applying them.

All orders of k filters form a trie of permutations. It is walked depth first: each node's survivors are a persisted
DataFrame, a child's survivors are its parent's without the rows that the next filter fails. The survivors of a prefix
don't depend on the order within it, so each unordered prefix is made and counted once (2^k - 1 states for k! orders)
and every order that comes by takes the remembered counts. Every edge's removals are counted on the survivors of its
own prefix. The rows that are walked are narrow: a part, one verdict for each filter and the measures.
"""

from __future__ import annotations

import itertools

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.llm.common import count_in, cut, discard, let, shared_path, words

#: Filters at most: k filters have k! orders of k steps.
MOST_FILTERS = 7
#: Groups of equal texts with at least so many rows, and at least 1 / MOST_HOT of all rows, are broadcast: no more than MOST_HOT of them exist.
HOT_ROWS, MOST_HOT = 10_000, 10_000


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a whole text; a null text is empty. Words differ by case."""
    text = F.coalesce(text, F.lit(""))
    ws = words(text)
    return {
        "A": F.size(ws) < 100,
        "B": let(ws, lambda w: 100 * F.size(F.array_distinct(w)) < 80 * F.size(w)),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": count_in(text, "#$%&*|") > 0,
    }


def later_copies(rows: DataFrame, key: str, identity: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: another row of the same ``identity`` (binary) has a smaller ``key``.

    A null key is neither smaller nor larger than another. Groups that may hold a large share of all rows meet their
    least key by a broadcast of at most ``MOST_HOT`` rows, all others by a join in which no key has many rows. ``rows`` is
    read several times; its own columns keep their names, whatever they are.
    """
    own = rows.select(F.col(identity).alias("same"), F.col(key).alias("own"), F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
    groups = cut(own.groupBy("same").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    bound = max(HOT_ROWS, rows.count() // MOST_HOT)
    hot = F.broadcast(groups.where(F.col("n") >= bound))
    found = own.join(hot, "same").unionByName(own.join(hot, "same", "left_anti").join(groups.where(F.col("n") < bound), "same", "left"))
    return found.select("row.*", F.coalesce(F.col("own") > F.col("least"), F.lit(False)).alias(name))


def document_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One narrow row a document: part, A to E (true: fails), good, toxic.

    Null lang is the part ''. A document is good or toxic if any of its label rows says so; without one, or with a null doc_id, it is neither.
    Repeated rows count each; of equal texts those with the smallest doc_id pass E, all of them if their doc_id is null.
    """
    own = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    judged = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), *[c.alias(n) for n, c in text_failures(F.col("text")).items()])
    judged = cut(judged, "verdicts")
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = later_copies(judged, "doc_id", "same", "E").join(marks, "doc_id", "left")
    return found.select("part", "A", "B", "C", "D", "E", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def walk(rows: DataFrame, filters: list[str], measures: list[str], part: str = "part") -> DataFrame:
    """One row per part, state and filter: what the filter removes from the survivors of the state.

    ``rows`` has a boolean column (true: fails) for each filter and each measure. Returns part, state (the filters
    applied before, sorted and joined), filter, alive (rows before the step), removed, and a count of removed rows for
    each measure. A part without survivors in a state has no row there. Counts are written to the shared folder state by
    state; at most as many survivor tables as there are filters are persisted at a time, and a lost executor's share is
    made again from the written verdicts.
    """
    spark = rows.sparkSession
    root = cut(rows.select(part, *filters, *measures), "audit")
    path, seen = shared_path(spark, "audit-edges"), set()

    def count(state: frozenset, alive: DataFrame) -> None:
        left = [f for f in filters if f not in state]
        sums = [F.count(F.lit(1)).alias("alive")]
        for f in left:
            sums += [F.count_if(F.col(f)).alias(f"r {f}"), *[F.count_if(F.col(f) & F.col(m)).alias(f"{m} {f}") for m in measures]]
        edges = [F.struct(F.lit(f).alias("filter"), F.col(f"r {f}").alias("removed"), *[F.col(f"{m} {f}").alias(m) for m in measures]) for f in left]
        counted = alive.groupBy(part).agg(*sums).select(F.col(part), F.lit(_state(state)).alias("state"), "alive", F.explode(F.array(*edges)).alias("e"))
        counted.select(part, "state", "e.filter", "alive", "e.removed", *[f"e.{m}" for m in measures]).write.mode("append").parquet(path)

    def visit(state: frozenset, alive: DataFrame) -> None:
        seen.add(state)
        count(state, alive)
        for f in filters:
            child = state | {f}
            if f in state or child in seen or len(child) == len(filters):
                continue  # the state is known from another order, or nothing is left to apply
            survivors = alive.where(~F.col(f))
            if len(child) == len(filters) - 1:  # one filter left: counted once, read by no child
                visit(child, survivors)
            else:
                survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
                visit(child, survivors)
                survivors.unpersist()

    if filters:
        kept = root.persist(StorageLevel.MEMORY_AND_DISK)
        visit(frozenset(), kept)
        kept.unpersist()
    discard(root)
    schema = f"`{part}` {rows.schema[part].dataType.simpleString()}, state string, filter string, alive long, removed long"
    return spark.read.schema(schema + "".join(f", `{m}` long" for m in measures)).parquet(path)


def _state(filters) -> str:
    return ",".join(sorted(filters))


def audit(rows: DataFrame, filters: list[str], measures: list[str], part: str = "part") -> DataFrame:
    """One row per part, order of all filters and step, zeros included.

    Columns: part, filter_order (names joined), step (from 1), filter, kept, removed, redundant (fails the filter but
    was removed earlier), unique_fails (fails this filter only), ``<measure>_lost``, shapley (the filter's removals summed
    over all orders). Empty ``rows`` have no parts and give no rows. More than ``MOST_FILTERS`` filters raise. Columns of
    ``rows`` other than those named are not read.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters: {len(filters)}")
    rows = rows.select(F.col(part).alias("part"), *[F.coalesce(F.col(f), F.lit(False)).alias(f"f{i}") for i, f in enumerate(filters)], *[F.coalesce(F.col(m), F.lit(False)).alias(f"m{i}") for i, m in enumerate(measures)])
    fs, ms = [f"f{i}" for i in range(len(filters))], [f"m{i}" for i in range(len(measures))]
    edges = walk(rows, fs, ms)
    name = dict(zip(fs, filters))
    orders = [("".join(name[f] for f in order), k + 1, f, name[f], _state(order[:k])) for order in itertools.permutations(fs) for k, f in enumerate(order)]
    orders = F.broadcast(rows.sparkSession.createDataFrame(orders, "filter_order string, step int, filter string, filter_name string, state string"))
    fails = edges.where("state = ''").select("part", "filter", F.col("removed").alias("fails"))
    alone = edges.where(F.size(F.array_remove(F.split("state", ","), "")) == len(fs) - 1).select("part", "filter", F.col("removed").alias("unique_fails"))
    table = fails.join(alone, ["part", "filter"], "left").join(orders, "filter").join(edges, ["part", "filter", "state"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return table.select(
        F.col("part"),
        "filter_order",
        "step",
        F.col("filter_name").alias("filter"),
        (zero("alive") - zero("removed")).alias("kept"),
        zero("removed").alias("removed"),
        (F.col("fails") - zero("removed")).alias("redundant"),
        zero("unique_fails").alias("unique_fails"),
        *[zero(m).alias(f"{n}_lost") for m, n in zip(ms, measures)],
        F.sum(zero("removed")).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
