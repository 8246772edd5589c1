"""Byte-level BPE against the public library, and its edge cases."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from uqframe.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_ranks(RANKS), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = [f"key{i}".encode() for i in range(2000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.find(k) for k in keys) == list(range(2000))
    assert h.find(b"stranger") is None
    assert bpe.PerfectHash([]).find(b"a") is None


def test_random_texts_equal_the_library(coder, library):
    rng = random.Random(5)
    alphabet = [" ", " ", "\n", "\t", "a", "b", "é", "1", "'", "s", "!", ".", "\xa0", "\x1c", " ", "中", "🙂", "\x85", "\r"]
    for _ in range(8000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert coder.encode(x) == library.encode_ordinary(x), repr(x)


@pytest.mark.parametrize("x", ["", " ", "  ", "a  b \n c", "<|endoftext|>", "x" * 3000, "the " * 4000, "wo.", " wo..", "it's we'll I'D", "word.\nNext\n\n line  "])
def test_named_texts_and_round_trip(coder, library, x):
    ids = coder.encode(x)
    assert ids == library.encode_ordinary(x)
    assert coder.decode(ids) == x.encode()


def test_letters_of_a_piece_are_the_pattern_s_letters(coder):
    letter = regex.compile(r"\p{L}")
    assert all(coder.letters(chr(c)) == bool(letter.fullmatch(chr(c))) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert not coder.letters("")


def test_memory_that_runs_full_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 1_000)
    small = bpe.Coder(bpe.read_ranks(RANKS), PATTERN)
    x = "one two, three.\nFour five six seven\n" * 3
    assert small.encode(x) == library.encode_ordinary(x)
    assert small.held <= 1_000


def test_memory_is_bounded_by_bytes_whatever_the_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 2 << 20)
    coder, rng = bpe.Coder(bpe.read_ranks(RANKS), PATTERN), random.Random(2)
    long = ["".join(rng.choices("ABCDEFabcdef0123456789+/", k=300)) for _ in range(3_000)]
    short = [f"{i:x}é{i}" for i in range(100_000)]
    before = len(coder.later)
    for text in (" ".join(long), " ".join(short)):
        assert coder.encode(text) == library.encode_ordinary(text)
        assert coder.held <= 2 << 20
    kept = [k for m in (coder.tokens, coder.first, coder.later) for k in m]
    assert before == 0 and max(map(len, kept)) <= bpe.LONGEST_KEPT and len(kept) * bpe.ENTRY_BYTES <= 2 << 20


def test_columns(spark, library):
    rows = [(1, "the word onts", "en"), (None, None, None), (3, "", "x"), (3, "", "x"), (4, "é " * 2000, "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.round_trip(df, RANKS, PATTERN).collect()
    want = []
    for k, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    both = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert both.columns == ["doc_id", "text", "ids", "raw"]
    assert sorted(bytes(r.raw) for r in both.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0


def test_vocabularies_that_differ_in_one_token_have_their_own_coders(spark, tmp_path):
    ranks = bpe.read_ranks(RANKS)
    swapped = dict(ranks)
    swapped[b" the"], swapped[b" of"] = ranks[b" of"], ranks[b" the"]
    path = tmp_path / "swapped.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % i for k, i in swapped.items()))
    df = spark.createDataFrame([(1, "all of the words")], "doc_id bigint, text string").coalesce(1)
    one, two = (bpe.encode(df, p, PATTERN).head().ids for p in (RANKS, str(path)))
    other = tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=swapped, special_tokens={})
    assert two == other.encode_ordinary("all of the words") != one


def test_other_patterns_cut_alone():
    ranks, pattern = bpe.read_ranks(RANKS), r"\S+\s*|\s+"
    own = bpe.Coder(ranks, pattern)
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for x in ("a b  c", " lead and  trail ", "one, two.\nthree", ""):
        assert own.encode(x) == other.encode_ordinary(x)
