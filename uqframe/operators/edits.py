"""Edit instructions over texts: many needles found in one pass, edits applied in order, and what became of each.

An edit names the texts that it is for by a ``needle`` they hold, and either replaces ``old`` by ``new`` or puts ``insert``
behind ``after``, or at the end where ``after`` is null. All needles are one automaton (Aho-Corasick), so a text is read
once however many there are; the few edits travel to the texts, texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits at most, since they and their automaton are in every task; more raise.
MOST_EDITS = 10_000
FIELDS = ("needle", "old", "new", "after", "insert")


@dataclass
class _Edits:
    """Edits in their order; ``allowed`` are the places of those that may be applied, all if None."""

    rows: list[tuple]
    allowed: frozenset[int] | None = None

    def __getstate__(self):
        return self.rows, self.allowed

    def __setstate__(self, state):
        self.rows, self.allowed = state

    def automaton(self):
        if "built" not in self.__dict__:
            import ahocorasick

            self.built, by = ahocorasick.Automaton(), {}
            for i, r in enumerate(self.rows):
                if r[1]:
                    by.setdefault(r[1], []).append(i)
            for needle, places in by.items():
                self.built.add_word(needle, places)
            if by:
                self.built.make_automaton()
        return self.built

    def hits(self, text: str | None) -> list[int]:
        """Places of the edits whose needle the text holds, in order."""
        built = self.automaton()
        return sorted({i for _, places in built.iter(text) for i in places}) if text and len(built) else []

    def outcome(self, text: str, i: int) -> tuple[str, str]:
        """The text after edit i, and what became of it."""
        _, _, old, new, after, insert = self.rows[i]
        if self.allowed is not None and i not in self.allowed:
            return text, "repeated"
        if old is None and after is None:
            return text + (insert or ""), "applied"
        target, put = (old, new or "") if old is not None else (after, after + (insert or ""))
        at = text.find(target)
        return (text, "target missing") if at < 0 or not target else (text[:at] + put + text[at + len(target) :], "applied")


def _listed(edits: DataFrame, order: str) -> _Edits:
    columns = [F.col(c) if c in edits.columns else F.lit(None).cast("string").alias(c) for c in FIELDS]
    rows = edits.select(F.col(order).alias("edit"), *columns).orderBy("edit").limit(MOST_EDITS + 1).collect()
    if len(rows) > MOST_EDITS:
        raise ValueError(f"more than {MOST_EDITS} edits")
    return _Edits([tuple(r) for r in rows])


def _found(texts: DataFrame, listed: _Edits, text: str) -> DataFrame:
    """place, texts: how many rows hold the needle of each edit that is found at all."""
    shared = texts.sparkSession.sparkContext.broadcast(listed)

    def hits(column: pd.Series) -> pd.Series:
        return column.map(shared.value.hits)

    each = texts.select(F.explode(F.pandas_udf(hits, "array<int>")(F.col(text))).alias("place"))
    return each.groupBy("place").agg(F.count(F.lit(1)).alias("texts"))


def apply(texts: DataFrame, edits: DataFrame, order: str = "edit", text: str = "text", everywhere: bool = False) -> DataFrame:
    """``texts`` with ``edited`` and ``outcomes`` (array of edit and outcome, in the order of ``order``).

    Needles are looked for in the text as it was, targets (their first place) in the text as the edits before left it.
    Outcomes are applied, target missing, or repeated: the needle stands in several texts, and ``everywhere`` is not
    set, so it doesn't say which one is meant. A null or empty needle finds nothing; a null text stays null. Columns of
    the two names are replaced.
    """
    listed = _listed(edits, order)
    if not everywhere:
        listed.allowed = frozenset(r["place"] for r in _found(texts, listed, text).where("texts = 1").collect())  # no more than edits
    shared, kind = texts.sparkSession.sparkContext.broadcast(listed), edits.schema[order].dataType.simpleString()

    def run(column: pd.Series) -> pd.DataFrame:
        known, edited, outcomes = shared.value, [], []
        for t in column:
            own = []
            for i in known.hits(t):
                t, what = known.outcome(t, i)
                own.append({"edit": known.rows[i][0], "outcome": what})
            edited.append(t)
            outcomes.append(own)
        return pd.DataFrame({"edited": pd.Series(edited, dtype=object), "outcomes": pd.Series(outcomes, dtype=object)})

    made = F.pandas_udf(run, f"edited string, outcomes array<struct<edit {kind}, outcome string>>")
    own = texts.select(F.struct(*[F.col(c) for c in texts.columns]).alias("row"), made(F.col(text)).alias("made"))
    return own.select(*[F.col("row")[c].alias(c) for c in texts.columns if c not in ("edited", "outcomes")], "made.edited", "made.outcomes")


def report(texts: DataFrame, edits: DataFrame, order: str = "edit", text: str = "text", everywhere: bool = False) -> DataFrame:
    """edit, texts (how many hold its needle), applied, and state: unmatched, repeated, target missing (somewhere) or applied."""
    done = apply(texts.select(text), edits, order, text, everywhere).select(F.explode("outcomes").alias("o")).select("o.*")
    counts = done.groupBy("edit").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") == "repeated").alias("repeated"))
    every = edits.select(F.col(order).alias("edit")).join(counts, "edit", "left").na.fill(0, ["texts", "applied", "repeated"])
    state = F.when(F.col("texts") == 0, "unmatched").when(F.col("repeated") > 0, "repeated").when(F.col("applied") < F.col("texts"), "target missing").otherwise("applied")
    return every.select("edit", "texts", "applied", state.alias("state"))
