"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is in the vocabulary as a whole takes
its id from one probe. Tier two merges the bytes of every other pre-token: a heap holds the ranked pairs of a
linked list of byte spans. Results of both tiers stay in a memory of each Python worker that is bounded by bytes.
No row is shuffled; each Arrow batch is encoded where it is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a worker remembers before it starts anew, all memories of a coder together; characters of the longest text it
#: remembers; bytes of an entry besides its text and ids.
MEMORY_BYTES, LONGEST_KEPT, ENTRY_BYTES = 160 << 20, 64, 220


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: hash and displace, n keys in n slots.

    ``slots[s]`` is the key in slot s; ``find`` compares the key, so strangers give None.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n = n
        self.shift = np.zeros(max(n, 1), np.int64)
        self.slots: list[bytes | None] = [None] * n
        buckets: dict[int, list[bytes]] = {}
        for k in keys:
            buckets.setdefault(xxhash.xxh3_64_intdigest(k) % n, []).append(k)
        free = set(range(n))
        for b, own in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                break
            d = 1
            while True:
                at = [xxhash.xxh3_64_intdigest(k, d) % n for k in own]
                if len(set(at)) == len(at) and all(self.slots[a] is None for a in at):
                    break
                d += 1
            self.shift[b] = d
            for a, k in zip(at, own):
                self.slots[a] = k
                free.discard(a)
        rest = iter(sorted(free))
        for b, own in buckets.items():
            if len(own) == 1:  # alone in its bucket: the shift names the slot itself
                slot = next(rest)
                self.shift[b] = -slot - 1
                self.slots[slot] = own[0]
        self.shift = self.shift.tolist()

    def find(self, key: bytes) -> int | None:
        """The slot of ``key``, or None if it is not one of the keys."""
        if not self.n:
            return None
        d = self.shift[xxhash.xxh3_64_intdigest(key) % self.n]
        slot = -d - 1 if d < 0 else xxhash.xxh3_64_intdigest(key, d) % self.n
        return slot if self.slots[slot] == key else None


class _Pieces(dict):
    """Piece between spaces -> ids. A piece of letters is one pre-token; others are split by the pattern."""

    def __init__(self, coder: Coder, lead: str):
        super().__init__()
        self.coder, self.lead = coder, lead

    def __missing__(self, piece: str) -> tuple[int, ...]:
        c = self.coder
        if c.letters(piece):
            ids = c.whole(self.lead + piece)
        elif piece[-1:] in c.stops and c.letters(piece[:-1]):  # not kept: the word and the mark are
            return self[piece[:-1]] + c.tokens[piece[-1]]
        else:
            later, tokens = c.later, c.tokens
            ids = tuple(chain.from_iterable([later[t[1:]] if t[0] == " " and c.letters(t[1:]) else tokens[t] for t in c.split(self.lead + piece)]))
        if c.may_keep(piece, ids):
            self[piece] = ids
        return ids


class _Tokens(dict):
    """Pre-token without a space before it -> ids."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.coder.whole(token)
        if self.coder.may_keep(token, ids):
            self[token] = ids
        return ids


class Coder:
    """Encodes and decodes single texts by ``ranks`` (bytes -> id) and the pre-token ``pattern``.

    Every single byte must have a rank. Merges take the pair of lowest rank, the leftmost of equals.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks))
        self.slot_ids = [ranks[k] for k in self.hash.slots]
        self.pairs = {(k[0], k[1]): i for k, i in ranks.items() if len(k) == 2}
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for k, i in ranks.items():
            self.bytes_of[i] = k
        self.decimal = list(map(str, range(len(self.bytes_of))))
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        #: Only under this pattern is a text cut at spaces first; under others the pattern alone cuts it.
        self.by_spaces = pattern == public_tokenizers.PATTERN
        self.word = regex.compile(r"\p{L}+").fullmatch
        #: Marks that end a word's piece as a pre-token of their own.
        self.stops = frozenset(".,;:!?")
        self.held, self.tokens = 0, _Tokens(self)
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")
        self.wide = re.compile(r" (?:\s|$)").search
        self.cut = re.compile(r" (?=\S)").split

    def may_keep(self, text: str, ids: tuple[int, ...]) -> bool:
        """True for a text short enough to be remembered; when all that is remembered passes ``MEMORY_BYTES``, it is forgotten first."""
        if len(text) > LONGEST_KEPT:
            return False
        size = ENTRY_BYTES + 4 * len(text) + 8 * len(ids)
        self.held += size
        if self.held > MEMORY_BYTES:
            for memory in (self.tokens, self.first, self.later):
                memory.clear()
            self.held = size
        return True

    def letters(self, piece: str) -> bool:
        """True if the pattern's letter class takes all of ``piece``; str.isalpha() may know another Unicode version."""
        return piece.isalpha() if piece.isascii() else self.word(piece) is not None

    def whole(self, token: str) -> tuple[int, ...]:
        """The ids of one pre-token: the perfect hash if it is in the vocabulary, else the heap."""
        raw = token.encode()
        slot = self.hash.find(raw)
        return (self.slot_ids[slot],) if slot is not None else self.merge(raw)

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Byte spans are linked by their starts; a heap entry packs (rank, start) and counts while that pair still has that rank."""
        n, rank_of = len(raw), self.ranks.get
        bits = n.bit_length()
        last = (1 << bits) - 1
        after, before = list(range(1, n + 2)), list(range(-1, n))
        rank = list(map(self.pairs.get, zip(raw, raw[1:])))
        rank.append(None)
        heap = [r << bits | i for i, r in enumerate(rank) if r is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & last
            if rank[i] != entry >> bits:
                continue
            j = after[i]
            after[i] = e = after[j]
            rank[j] = rank[i] = None
            if e < n:
                before[e] = i
                if (r := rank_of(raw[i : after[e]])) is not None:
                    rank[i] = r
                    heappush(heap, r << bits | i)
            if (p := before[i]) >= 0:
                rank[p] = r = rank_of(raw[p:e])
                if r is not None:
                    heappush(heap, r << bits | p)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[raw[i : (i := after[i])]])
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Under the public pattern, a space before a character that is not white starts a pre-token, so pieces between such spaces are independent."""
        if not text:
            return []
        if not self.by_spaces:
            return list(chain.from_iterable(map(self.tokens.__getitem__, (m.group() for m in self.pattern.finditer(text)))))
        parts = self.cut(text) if self.wide(text) else text.split(" ")
        if text[0] == " " and parts[0] == "":
            parts = parts[1:]
            return list(chain.from_iterable(map(self.later.__getitem__, parts)))
        return [*self.first[parts[0]], *chain.from_iterable(map(self.later.__getitem__, parts[1:]))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        """SHA-256 of the decimal ids joined by one space, in lower-case hex."""
        return hashlib.sha256(" ".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line per token, base64 of its bytes and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


_CODERS: dict[str, Coder] = {}


def coder_of(shared: Broadcast) -> Coder:
    """One coder per worker, vocabulary and pattern, so that what it remembers serves all its tasks."""
    key, ranks, pattern = shared.value
    if key not in _CODERS:
        _CODERS[key] = Coder(ranks, pattern)
    return _CODERS[key]


def share(spark: SparkSession, ranks_path: str, pattern: str) -> Broadcast:
    """A digest of vocabulary and pattern, and both, for the workers; the size is the vocabulary's, whatever the corpus."""
    ranks = read_ranks(ranks_path)
    digest = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    return spark.sparkContext.broadcast((digest, ranks, pattern))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids`` (array<int>); null and empty texts have no ids. A column of that name is replaced.

    Texts are whole strings of any length; repeated rows are encoded each.
    """
    shared = share(df.sparkSession, ranks_path, pattern)

    def run(texts):
        import pandas as pd

        coder = coder_of(shared)
        return pd.Series([coder.encode(t or "") for t in texts])

    return df.withColumn(ids, F.pandas_udf(run, "array<int>")(F.col(text)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """``df`` with a column ``raw`` (binary): the bytes of the ids; null gives no bytes. A column of that name is replaced."""
    shared = share(df.sparkSession, ranks_path, pattern)

    def run(rows):
        import pandas as pd

        coder = coder_of(shared)
        return pd.Series([coder.decode([] if x is None else x) for x in rows])

    return df.withColumn(raw, F.pandas_udf(run, "binary")(F.col(ids)))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, then decode its ids: key, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty; rows keep their key as it is, null and repeated keys included.
    """
    shared = share(df.sparkSession, ranks_path, pattern)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for batch in batches:
            n, ids_hash, raw_hash = [], [], []
            for t in batch.column(1):
                ids = coder.encode(t.as_py() or "")
                n.append(len(ids))
                ids_hash.append(coder.digest(ids))
                raw_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(raw_hash, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
