"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Shares of the sources' tokens are raised to an exponent and normalised. The exponent is bisected: as near to 1 as it
may be while the weights reach the target entropy, and never so small that a source is repeated more often than the
limit. A budget of tokens times a weight is what a source gives: whole passes over it, then a part of one more pass.
Each pass is a permutation of its own: blocks of rows in the order of a hash of block and pass, rows within a block in
the order of a hash of row and pass. The last pass takes blocks in its order until the budget is met and ends inside one
block. Where it ends is two numbers a source, so every row decides for itself how often it is drawn, and where, when it
is read. Shares and budgets count words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.llm.common import cut, spare, words

#: Entropy of the weights, as a share of the largest possible one, that the exponent must reach.
ENTROPY = 0.95
#: Passes over one source at most.
MOST_PASSES = 4.0
#: Rows of a block on average; beyond MOST_BLOCKS blocks of one source they grow.
BLOCK_ROWS, MOST_BLOCKS = 256, 1 << 16
#: Sources at most: one row a source reaches the driver and every task.
MOST_SOURCES = 100_000
SEED = 17


@dataclass(frozen=True)
class Plan:
    exponent: float
    weights: tuple[float, ...]
    entropy: float


def _weights(tokens: list[int], exponent: float) -> list[float]:
    top = max(tokens)
    raised = [(t / top) ** exponent for t in tokens]
    total = math.fsum(raised)
    return [r / total for r in raised]


def _entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def temperature(tokens: list[int], budget: float, entropy: float = ENTROPY, most_passes: float = MOST_PASSES) -> Plan:
    """Exponent in [0, 1] for positive token counts, bisected 60 times.

    Entropy falls and the largest number of passes falls as the exponent grows. The largest exponent that reaches the
    entropy is taken, then raised as far as the pass limit asks; at exponent 1 all sources have the same passes, so a
    budget of more than ``most_passes`` times all tokens can't be met and raises.
    """
    if not tokens:
        return Plan(1.0, (), 0.0)
    if budget > most_passes * sum(tokens) * (1 + 1e-12):
        raise ValueError(f"a budget of {budget} needs more than {most_passes} passes over {sum(tokens)} tokens")
    goal = entropy * math.log(len(tokens))
    passes = lambda a: max(budget * w / t for w, t in zip(_weights(tokens, a), tokens))

    def largest(fits) -> float:
        lo, hi = 0.0, 1.0
        if fits(1.0):
            return 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if fits(mid) else (lo, mid)
        return lo

    a = largest(lambda x: _entropy(_weights(tokens, x)) >= goal - 1e-12)
    if passes(a) > most_passes:
        lo, hi = a, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if passes(mid) <= most_passes else (mid, hi)
        a = hi
    w = _weights(tokens, a)
    return Plan(a, tuple(w), _entropy(w))


def token_count(text: Column) -> Column:
    """Words of a text: the unit of shares and budgets."""
    return F.size(words(text)).cast("long")


def _order(name: str, *columns: Column) -> Column:
    return F.xxhash64(F.lit(f"{SEED} {name}"), *columns)


def _name(source: Column) -> Column:
    """A source's name, never null: a null source differs from an empty one."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _row_hash(key: str, text: str) -> Column:
    """A row's own hash: it deals rows into blocks, and orders them within a block once a pass is mixed in."""
    return _order("row", F.col(key), F.xxhash64(text))


def draw_plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget: int | None = None, entropy: float = ENTROPY, most_passes: float = MOST_PASSES) -> tuple[DataFrame, Plan]:
    """One row a source: weight, budget, whole passes, and where the last pass ends (block hash, row hash).

    The budget is that of all tokens unless given. Sources without tokens get weight 0 and all their rows once.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(_name(F.col(source)).alias("s"), token_count(F.col(text)).alias("n"), _row_hash(key, text).alias("row_hash")), "mixing")
    totals = rows.groupBy("s").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")).orderBy("s").limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    full = [t for t in totals if t.tokens > 0]
    whole = sum(t.tokens for t in full)
    budget = whole if budget is None else budget
    plan = temperature([t.tokens for t in full], budget, entropy, most_passes)
    made = []
    for t, w in zip(full, plan.weights):
        own = round(budget * w)
        made.append((t.s, t.tokens, min(max(1, t.rows // BLOCK_ROWS), MOST_BLOCKS), float(w), own, own // t.tokens, own % t.tokens))
    made += [(t.s, 0, 1, 0.0, 0, 1, 0) for t in totals if t.tokens == 0]
    sources = spark.createDataFrame(made, "s string, tokens long, blocks long, weight double, budget long, passes long, rest long")
    # the last pass: blocks in permuted order until the rest of the budget is met, then rows of that block
    last_pass = rows.join(F.broadcast(sources), "s").where("rest > 0")
    placed = last_pass.select("s", "n", "rest", _block(F.col("s"), F.col("row_hash"), F.col("blocks"), F.col("passes")).alias("block_hash"), _place(F.col("row_hash"), F.col("passes")).alias("row_hash"))
    per_block = cut(placed.groupBy("s", "block_hash").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")), "mixing-blocks")
    upto = per_block.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("block_hash")))
    last = upto.where("upto >= rest and upto - n < rest").select("s", "block_hash", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    # equal rows count together: their peers must not push each other over the end
    rows_inside = placed.join(F.broadcast(last), ["s", "block_hash"]).groupBy("s", "block_hash", "row_hash").agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    inside = rows_inside.withColumn("upto", F.sum("n").over(Window.partitionBy("s", "block_hash").orderBy("row_hash")))
    ends = inside.where("upto - n < left").groupBy("s", "block_hash").agg(F.max("row_hash").alias("row_hash")).select("s", F.col("block_hash").alias("end_block"), F.col("row_hash").alias("end_row"))
    return sources.join(ends, "s", "left"), plan


def _block(s: Column, row_hash: Column, blocks: Column, pass_: Column) -> Column:
    """The hash that orders the row's block among the blocks of its source in a pass."""
    return _order("block", s, F.pmod(F.xxhash64(row_hash), blocks), pass_)


def _place(row_hash: Column, pass_: Column) -> Column:
    """The hash that orders the row within its block in a pass."""
    return _order("place", row_hash, pass_)


def drawn_names(docs: DataFrame) -> list[str]:
    """The columns that ``mix`` adds for pass, block and row; underscores go behind a name that ``docs`` has itself."""
    return spare(docs, "__pass", "__block", "__row")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget: int | None = None, entropy: float = ENTROPY, most_passes: float = MOST_PASSES) -> DataFrame:
    """Each row of ``docs`` as often as it is drawn: all its columns, ``__pass`` (from 0), ``__block`` and ``__row``.

    Sorted by pass, block and row, a source's rows stand in the order in which they are drawn; no job need sort them to
    know it. A null source is a source of its own. Equal rows have equal hashes and are drawn alike. The row at which a budget
    is met is drawn whole, so a source exceeds its budget by less than one row and its equals. Columns of ``docs`` keep
    their names and values; where they have one of the three names, ``drawn_names`` tells the new one.
    """
    plan, _ = draw_plan(docs, key, source, text, budget, entropy, most_passes)
    pass_, block, row = drawn_names(docs)
    s, blocks, passes, end_block, end_row, n = spare(docs.withColumns({c: F.lit(0) for c in (pass_, block, row)}), "__s", "__blocks", "__passes", "__end_block", "__end_row", "__n")
    small = plan.select(F.col("s").alias(s), F.col("blocks").alias(blocks), F.col("passes").alias(passes), F.col("end_block").alias(end_block), F.col("end_row").alias(end_row))
    own = docs.withColumns({s: _name(F.col(source)), row: _row_hash(key, text)})
    at = lambda p: _block(F.col(s), F.col(row), F.col(blocks), p)
    last_block, last_row = at(F.col(passes)), _place(F.col(row), F.col(passes))
    taken = (last_block < F.col(end_block)) | ((last_block == F.col(end_block)) & (last_row <= F.col(end_row)))
    drawn = own.join(F.broadcast(small), s).withColumn(n, F.col(passes) + F.coalesce(taken, F.lit(False)).cast("long"))
    every = drawn.where(F.col(n) > 0).withColumn(pass_, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    return every.select(*docs.columns, pass_, at(F.col(pass_)).alias(block), _place(F.col(row), F.col(pass_)).alias(row))
