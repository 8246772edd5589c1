"""Token counts of fields and sections by offsets: a text is encoded once, as a whole.

The encoder's tokens are byte spans; they become character spans and meet the text's sections in a merge of two sorted
lists. A token that crosses a boundary goes where an explicit rule says. So counts of sections add up to the count of
the text, which separate encoding of sections would not give. Rows are attributed where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.llm import bpe

#: majority: the section with most of the token's characters, the earlier of equals. first: the section of its first
#: character. split: each section in proportion to the token's characters in it.
RULES = ("majority", "first", "split")


def head_and_body(text: Column) -> Column:
    """Two sections of a text: its first line with the line end, and the rest. Null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    at = F.instr(t, "\n").cast("long")
    n = F.length(t).cast("long")
    cut = F.when(at > 0, at).otherwise(n)
    section = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("start"), b.alias("end"))
    return F.array(section("head", F.lit(0).cast("long"), cut), section("body", cut, n))


def spans(coder: bpe.Coder, text: str, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, in code points; a token inside one character has that character."""
    ids = np.array(coder.encode(text), np.int64)
    ends = np.cumsum(widths[ids]) if len(ids) else np.zeros(0, np.int64)
    starts = ends - widths[ids] if len(ids) else ends
    raw = text.encode()
    if len(raw) == len(text) or not len(ids):
        return starts, ends
    leads = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return leads[starts] - 1, leads[ends - 1]


def attribute_spans(starts: np.ndarray, ends: np.ndarray, bounds: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (float) and crossing tokens (int) of each section, and at the last place those outside all.

    ``bounds`` are the sections as (start, end), ascending and without overlap; gaps between them are outside. Others raise.
    """
    k = len(bounds)
    flat = [x for b in bounds for x in b]
    if None in flat or flat != sorted(flat) or flat and flat[0] < 0:
        raise ValueError(f"sections must be ascending and must not overlap: {bounds[:20]}")
    edges, owner = [], []  # pieces of the line: where each starts and which section it is
    at = 0
    for i, (a, b) in enumerate(bounds):
        if b > a:
            if a > at or not edges and a > 0:
                edges.append(at)
                owner.append(k)
            edges.append(a)
            owner.append(i)
            at = b
    edges.append(at)
    owner.append(k)
    edge, own = np.array(edges, np.int64), np.array(owner, np.int64)
    first, last = np.searchsorted(edge, starts, "right") - 1, np.searchsorted(edge, ends - 1, "right") - 1
    inside = first == last
    n = np.bincount(own[first[inside]], minlength=k + 1).astype(np.float64)
    crossing = np.zeros(k + 1, np.int64)
    stop = np.append(edge[1:], np.iinfo(np.int64).max)
    for t in np.flatnonzero(~inside):
        pieces = np.arange(first[t], last[t] + 1)
        chars = np.minimum(stop[pieces], ends[t]) - np.maximum(edge[pieces], starts[t])
        if rule == "split":
            np.add.at(n, own[pieces], chars / chars.sum())
            crossing[np.unique(own[pieces])] += 1
        else:
            to = own[pieces[0] if rule == "first" else pieces[chars.argmax()]]
            n[to] += 1
            crossing[to] += 1
    return n, crossing


def attribute(df: DataFrame, sections: Column, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", rule: str = "majority") -> DataFrame:
    """Rows (key, section_no, section, n_tokens, n_crossing) for each section of each row of ``df``.

    ``sections`` is array<struct<name, start, end>> in code points, ascending, without overlap (others raise); an empty
    section has no tokens. Tokens outside all sections are counted under section_no -1, section null, where there are any. Null texts
    are empty, null sections are none; rows with null or repeated keys are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = bpe.share(df.sparkSession, ranks_path, pattern)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder_of(shared)
        widths = np.array([len(b) if b else 0 for b in coder.bytes_of], np.int64)
        for batch in batches:
            row, number, names, tokens, crossing = [], [], [], [], []
            for i in range(batch.num_rows):
                own = batch.column(2)[i].as_py() or []
                starts, ends = spans(coder, batch.column(1)[i].as_py() or "", widths)
                n, c = attribute_spans(starts, ends, [(s["start"], s["end"]) for s in own], rule)
                for j, s in enumerate(own):
                    row.append(i), number.append(j), names.append(s["name"]), tokens.append(n[j]), crossing.append(int(c[j]))
                if n[-1]:
                    row.append(i), number.append(-1), names.append(None), tokens.append(n[-1]), crossing.append(int(c[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(names, pa.string()), pa.array(tokens, pa.float64()), pa.array(crossing, pa.int64())], names=[key, "section_no", "section", "n_tokens", "n_crossing"])

    return df.select(F.col(key), F.col(text).alias("__text"), sections.alias("__sections")).mapInArrow(run, f"`{key}` {kind}, section_no int, section string, n_tokens double, n_crossing bigint")
