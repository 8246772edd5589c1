"""Best-two-fit packing: ids against the tokenizer, places against the rule applied piece by piece."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from uqframe.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """The rule on a list of pieces, one sequence at a time."""
    left, out = sorted(lengths), []
    while left:
        own = []
        while fits := [x for x in left if x <= capacity - sum(own)]:
            own.append(fits[-1])
            left.remove(fits[-1])
        room = capacity - sum(own)
        if room and len(own) > 1:
            gap, n = room + min(own), Counter(left)
            pairs = [(x + y, x, y) for x in n for y in n if y <= x and x + y <= gap and (x != y or n[x] > 1)]
            if pairs and max(pairs)[0] > min(own):
                _, x, y = max(pairs)
                least = min(own)
                own.remove(least)
                left.remove(x)
                left.remove(y)
                own += [x, y]
                left = sorted([*left, least])
        out.append(tuple(sorted(own, reverse=True)))
    return out


def spelled(fills):
    return [tuple(x for x, n in f.lengths for _ in range(n)) for f in fills for _ in range(f.times)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_repeated_fills_equal_the_rule_piece_by_piece(lengths):
    assert spelled(packing.best_two_fit(Counter(lengths), 30)) == one_by_one(lengths, 30)


def test_a_pair_replaces_the_smallest():
    # greedy: 6 + 3 leaves 1; 2 + 2 fills the gap of 4
    assert spelled(packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10))[0] == (6, 2, 2)
    assert packing.best_two_fit({}, 10) == [] and packing.best_two_fit({10: 5}, 10) == [packing.Fill(((10, 1),), 5)]


def test_few_sequences_and_a_small_table():
    rng = random.Random(3)
    lengths = Counter(min(4096, 1 + int(rng.lognormvariate(6, 1.2))) for _ in range(300_000))
    fills = packing.best_two_fit(lengths, 4096)
    assert sum(f.times for f in fills) <= math.ceil(sum(x * n for x, n in lengths.items()) / 4096) + 2
    assert len(fills) < 3 * 4096


def check(rows, documents, capacity, end):
    tokenizer = Tokenizer.from_file(PATH)
    expect, found, bins = Counter(), Counter(), defaultdict(list)
    for k, t in documents:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        for i, s in enumerate(range(0, len(ids), capacity)):
            expect[k, i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())] += 1
    for r in rows:
        found[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert found == expect
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    assert sorted(tuple(sorted((n for _, n in own), reverse=True)) for own in bins.values()) == sorted(one_by_one([r.length for r in rows], capacity))


TEXTS = ["", None, "It's l'été  Ünïcode x y\x85z \x1c q", "a\n\nb\tc\r\nd", "combining é ́x", "x" * 3000, "日本語 テキスト 12345", "word " * 200, "I'LL we'd '' 's 't", "<|endoftext|> a<|startoftext|>b", "ΑΣ Σ ΣΑ İ ǅ", "same text", "same text"]


def test_pieces_and_places(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (7, TEXTS[7]), (7, TEXTS[7])]
    rows += [(100 + i, "lorem ipsum dolor " * (i % 13)) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, row string, size int").repartition(5)
    placed = packing.place(packing.pieces(df, PATH, 50, 1).withColumn("ids_crc32", F.crc32("ids")), 50)
    check(placed.collect(), rows, 50, 1)
    back = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        s = back[r.sequence_id]
        assert r.offset in s.starts and bytes(s.ids[4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids)


def test_specials_as_text(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id int, text string")
    control = lambda flag: 49407 in np.frombuffer(packing.pieces(df, PATH, 50, 1, specials_as_text=flag).head().ids, "<u4")[:-1][1:2]
    assert control(False) and not control(True)


def test_clashing_names_empty_tables_and_bad_lengths(spark):
    df = spark.createDataFrame([(3, "s", 4, 5, 6), (2, "t", 7, 8, 9)], "length int, row string, size int, at int, sequence_id int")
    got = packing.place(df, 5)
    assert got.columns == ["length", "row", "size", "at", "sequence_id", "offset"] and {(r.row, r["size"], r.at) for r in got.collect()} == {("s", 4, 5), ("t", 7, 8)}
    assert packing.place(df.where("length > 5"), 5).count() == 0
    assert packing.pack(spark.createDataFrame([], "doc_id int, text string"), PATH, 8, 1).count() == 0
    for bad in (2, 0):
        with pytest.raises(ValueError if not bad else Exception):
            packing.place(df, bad).count()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abzAZéÉßİıŉµªſKÅ.,;:!?'$%&<|>sStT\u0301\u00d7\u00f7 \n\t"), st.characters(codec="utf-8")), max_size=40))
def test_words_apart_equal_whole_texts(text):
    if not hasattr(test_words_apart_equal_whole_texts, "m"):
        test_words_apart_equal_whole_texts.m = packing.WordMemory(PATH, False)
    m = test_words_apart_equal_whole_texts.m
    assert m.apart and np.frombuffer(m.encode(text), "<u4").tolist() == m.tokenizer.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY_BYTES", 20_000)
    m, plain = packing.WordMemory(PATH, False), Tokenizer.from_file(PATH)
    words = [f"w{i}" for i in range(300)] + ["y" * 500]
    text = " ".join(words * 2)
    assert np.frombuffer(m.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert m.held <= 20_000 and "y" * 500 not in m


def test_whole_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op12_best_fit_packing(spark, sf_dir).collect(), docs, 4096, 1)
