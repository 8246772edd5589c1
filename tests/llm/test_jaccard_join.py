"""The Jaccard join against all pairs, and its parts."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from uqframe.llm import jaccard_join as jj
from uqframe.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """n_shingles and component of each (key, text) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(1, len(w))))})
    to = list(range(len(rows)))

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
            to[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {r: min((k for k in g if k is not None), default=None) for r, g in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[root(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=str)


def corpus(seed, copies=40, length=120):
    """Chains of near copies around the threshold, a passage that all share, exact copies, short and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(length))
    rows = []
    for base in range(4):
        words = [rng.choice(vocabulary) for _ in range(length * (base + 1) // 2)]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, 5 * (base + 1) // 2)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = own
            rows.append(" ".join(own).upper() if rng.random() < 0.3 else " ".join(own))
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(copies)]
    rows += [rows[0]] * 5 + ["", None, "one", "ONE", "a b c d", "a b c d e", "a b c d e f", "a b c d e f g h i j", " \t\n", "é ü ö ä ß à", "a b  c d"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "key_bits", "crowded", "hot", "mapped"), [(1, 64, 1 << 16, 1 << 12, 64), (2, 3, 1 << 16, 4, 0), (4, 64, 0, 1, 8)])
def test_equals_all_pairs(spark, seed, key_bits, crowded, hot, mapped, monkeypatch):
    """Also with hashes that clash, with every entry crowded, with entries dealt into parts, and with maps in every entry."""
    monkeypatch.setattr(jj, "CROWDED", crowded)
    monkeypatch.setattr(jj, "MAPPED", mapped)
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "x", 0, 0, 0) for k, t in rows], "doc_id bigint, text string, key string, n int, c int, node int").repartition(3)
    monkeypatch.setattr(jj, "HOT", hot)
    monkeypatch.setattr(jj, "FREQUENT", 3)
    got = sorted(map(tuple, jj.join_components(df, key_bits=key_bits).collect()), key=str)
    assert got == brute(rows)


def pool(n, seed=7):
    """Texts of 45 of 60 paragraphs in their order: alike, but not similar; then some near copies."""
    rng = random.Random(seed)
    paragraphs = [" ".join(f"p{i}w{j}" for j in range(12)) for i in range(60)]
    texts = [" ".join(paragraphs[k] for k in sorted(rng.sample(range(60), 45))) for _ in range(n)]
    return list(enumerate(texts + [t + " and more" for t in texts[: n // 20]]))


def test_texts_of_one_pool_make_few_rows_and_lose_no_link(spark, monkeypatch):
    """Rows that meet grow with the texts, not with their pairs."""
    made, met = {}, jj._Join.met

    def counted(self, sized):
        out = met(self, sized)
        made[n] = made.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(jj._Join, "met", counted)
    for n in (120, 240):
        rows = pool(n)
        got = jj.join_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert made[240] < 4 * max(made[120], 1_000) and made[240] < 240 * 239 // 2


def test_empty_null_and_repeated_keys(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert jj.join_components(empty).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, None)]
    got = sorted(map(tuple, jj.join_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (9, 0, 9)], key=str)


def test_keep_one(spark):
    rows = corpus(3, copies=8)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in jj.keep_one(df).collect())
    assert kept == sorted({c for _, _, c in brute(rows)})


def test_keep_one_decides_by_row_where_keys_repeat(spark):
    one, two = ("a b c d e f g h i j", "k l m n o p q r s t")
    rows = [(5, one), (5, two), (5, two), (3, two), (None, two), (8, None), (8, ""), (9, None), (9, None)]
    got = Counter(map(tuple, jj.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == Counter([(5, one), (3, two), (None, two), (8, None), (8, ""), (9, None)])


@pytest.mark.parametrize("k", [2, 3, 5])
def test_similar_sets_share_an_entry(k):
    rng = np.random.default_rng(k)
    checked = 0
    for _ in range(1500):
        n = int(rng.integers(4, 400))
        base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        n = len(base)
        drop = int(rng.integers(0, max(1, n // 8)))
        other = np.unique(np.concatenate([base[rng.permutation(n)[: n - drop]], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, n // 6)))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both < 80 * (n + len(other) - both) or np.array_equal(base, other):
            continue
        checked += 1
        often = rng.random() * 1.1
        frequent = lambda own: (own % np.uint64(1000)) < np.uint64(int(1000 * min(often, 1)))  # noqa: B023, E731
        level = lambda own: (own[frequent(own)] % np.uint64(7)).astype(np.uint8)  # noqa: B023, E731
        larger, smaller = (base, other) if n >= len(other) else (other, base)
        single = np.intersect1d(jj.single_entries(larger, frequent(larger)), jj.single_entries(smaller, frequent(smaller)))
        entries, _, _ = jj.combined_entries(larger, frequent(larger), level(larger), k)
        own, as_small, _ = jj.combined_entries(smaller, frequent(smaller), level(smaller), k)
        assert len(single) or len(np.intersect1d(entries, own[as_small]))
        if n == len(other):
            own, as_small, _ = jj.combined_entries(larger, frequent(larger), level(larger), k)
            entries, _, _ = jj.combined_entries(smaller, frequent(smaller), level(smaller), k)
            assert len(single) or len(np.intersect1d(entries, own[as_small]))
        differ = sum(bin(x ^ y).count("1") for x, y in zip(jj.bit_map(base), jj.bit_map(other)))
        assert differ <= n + len(other) - 2 * both
    assert checked > 300


def test_texts_that_share_most_of_a_passage_do_not_meet():
    passage = np.arange(1, 81, dtype=np.uint64) * np.uint64(1000)
    texts = [np.unique(np.concatenate([passage, np.arange(12, dtype=np.uint64) + np.uint64(10**6 * (i + 1) + 1)])) for i in range(30)]
    entries = []
    for own in texts:
        frequent = own % np.uint64(1000) == 0
        found, as_small, _ = jj.combined_entries(own, frequent, np.zeros(int(frequent.sum()), np.uint8), 2)
        assert len(found) and not as_small.any()  # as larger sets only: the bare passage is similar to each of them
        entries.append(found)
    found, as_small, _ = jj.combined_entries(passage, np.ones(80, bool), np.zeros(80, np.uint8), 2)
    assert all(len(np.intersect1d(found[as_small], e)) for e in entries)


def test_frequency_bound(spark, monkeypatch):
    monkeypatch.setattr(jj, "MOST_FREQUENT", 10)
    rows = [(i, " ".join(f"common{j}" for j in range(60)) + f" own{i}") for i in range(12)]
    counter, scanned = jj.scan(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("text_hash", F.xxhash64("text")))
    assert len(jj.frequent_tokens(counter, scanned)[0]) <= 10


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
