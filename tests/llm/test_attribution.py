"""Offset-mapped token counts against a character-by-character count."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from uqframe.llm import attribution as at
from uqframe.llm import bpe, queries

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_ranks(RANKS), PATTERN)


def slow(coder, text, bounds, rule):
    """Section of each character, then each token's characters one by one."""
    owner = [next((i for i, (a, b) in enumerate(bounds) if a <= c < b), len(bounds)) for c in range(len(text))]
    byte_owner = [c for c, ch in enumerate(text) for _ in ch.encode()]
    out, pos = [0.0] * (len(bounds) + 1), 0
    for i in coder.encode(text):
        width = len(coder.bytes_of[i])
        chars = sorted(set(byte_owner[pos : pos + width]))
        pos += width
        own = [owner[c] for c in chars]
        if rule == "first":
            out[own[0]] += 1
        elif rule == "split":
            for o in own:
                out[o] += 1 / len(own)
        else:
            runs = []
            for o in own:
                if runs and runs[-1][0] == o:
                    runs[-1][1] += 1
                else:
                    runs.append([o, 1])
            best = max(n for _, n in runs)
            out[next(o for o, n in runs if n == best)] += 1
    return out


@pytest.mark.parametrize("rule", at.RULES)
def test_random_sections(coder, rule):
    rng = random.Random(3)
    widths = np.array([len(b) if b else 0 for b in coder.bytes_of], np.int64)
    for _ in range(300):
        text = "".join(rng.choice(["the ", "onts", "é", "🙂", "\n", "  ", "word"]) for _ in range(rng.randint(0, 12)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(4))
        bounds = [(cuts[0], cuts[1]), (cuts[2], cuts[3])] if rng.random() < 0.5 else [(cuts[0], cuts[1]), (cuts[1], cuts[2]), (cuts[2], cuts[3])]
        got, _ = at.attribute_spans(*at.spans(coder, text, widths), bounds, rule)
        assert np.allclose(got, slow(coder, text, bounds, rule)), (text, bounds)


def test_rows(spark, coder):
    rows = [(1, "Title here\nbody text of it", "x"), (2, None, None), (2, "", "y"), (None, "one line", "z"), (5, "\n\n", "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, section string")
    got = at.attribute(df, at.head_and_body(F.col("text")), RANKS, PATTERN).collect()
    assert len(got) == 2 * len(rows)
    total = lambda k: sum(r.n_tokens for r in got if r.doc_id == k)
    assert total(1) == len(coder.encode(rows[0][1])) and total(None) == len(coder.encode("one line")) and total(2) == 0
    assert at.attribute(df.limit(0), at.head_and_body(F.col("text")), RANKS, PATTERN).count() == 0
    none = at.attribute(df, F.lit(None).cast("array<struct<name:string,start:bigint,end:bigint>>"), RANKS, PATTERN).collect()
    assert {r.section_no for r in none} == {-1}
    with pytest.raises(ValueError):
        at.attribute(df, at.head_and_body(F.col("text")), RANKS, PATTERN, rule="other")


@pytest.mark.parametrize("bounds", [[(0, 5), (3, 8)], [(4, 8), (0, 4)], [(0, None)], [(-1, 2)], [(3, 2)]])
def test_sections_that_overlap_or_stand_in_disorder_raise(bounds):
    with pytest.raises(ValueError):
        at.attribute_spans(np.array([0]), np.array([3]), bounds, "majority")


def test_whole_query_equals_a_count_by_characters(spark, sf_dir, coder):
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        text = r.text or ""
        head = text.find("\n") + 1 or len(text)  # the first line with its end
        n = slow(coder, text, [(0, head), (head, len(text))], "majority")
        want += [(r.doc_id, 0, int(n[0])), (r.doc_id, 1, int(n[1]))]
        assert n[2] == 0
    got = queries.op9_token_attribution(spark, sf_dir)
    assert sorted((r.doc_id, r.section_no, r.n_tokens) for r in got.collect()) == sorted(want)
