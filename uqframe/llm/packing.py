"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

The rule for one sequence: fill greedily with the longest piece that still fits; if room is left and more than one piece
is in, replace the smallest by the two unpacked pieces that fill its expanded gap most tightly, if they fill it better.

Pieces of equal length are alike to the rule, so it needs only how many pieces of each length there are: at most
``capacity`` numbers, whatever the corpus. A sequence's fill repeats as long as the lengths it uses last, so the rule is
run once for each distinct fill and repeated by division; the result is the one that the rule gives piece by piece over
the whole corpus. Each fill then owns a range of the pieces of each of its lengths. A piece knows its rank among those of
its length from counts per scan partition, and finds its sequence and place by bisection in the table of ranges. No
piece passes through the driver, no sequence is confined to a task's pieces.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.llm.common import cut

#: Longest capacity: the lengths' counts and the table of fills are held by the driver and every task.
MOST_CAPACITY = 1 << 16
#: Bytes that a worker's word memory may hold before it starts anew, the longest piece it keeps, and the cost of an entry besides its bytes.
MEMORY_BYTES, LONGEST_KEPT, ENTRY_BYTES = 160 << 20, 64, 220
#: Bytes of ids in one Arrow batch that a task returns, documents aside.
BATCH_BYTES = 4 << 20


#: The normal form and the pre-token pattern of the public word-end vocabulary, for which words are encoded apart.
NORMAL_FORM = ("NFC", "Replace", "Lowercase")
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordMemory(dict):
    """Piece between plain spaces and line breaks -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer's normal form and pre-tokens never reach across a space, so pieces are independent. Under the known
    pattern a run of Latin letters and the run of marks behind it are pre-tokens of their own: they are looked up apart,
    letters in lower case, and letters go straight to the tokenizer's merges; NFC leaves them as they are. All other
    pieces go through the whole tokenizer. Long pieces are encoded but not kept; when the kept ones pass
    ``MEMORY_BYTES`` all are forgotten.
    """

    #: Letters up to U+017F, but for the one whose lower case is not a letter alone; marks of ASCII, but for the apostrophe.
    letters_and_marks = staticmethod(re.compile("([A-Za-z\u00c0-\u012f\u0131-\u017f]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch)

    def __init__(self, path: str, specials_as_text: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.held = Tokenizer.from_file(path), 0
        self.tokenizer.encode_special_tokens = specials_as_text
        self.apart = words_apart(path)
        of_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: of_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(97, 0x180) if chr(c).isalpha()}

    def __missing__(self, piece: str) -> bytes:
        parts = self.apart and self.letters_and_marks(piece)
        if parts and (letters := parts[1]).isalpha():
            low = letters.lower()
            if low != piece:  # not kept: its letters and its marks are
                return self[low] + (self[parts[2]] if parts[2] else b"")
            ids = [t.id for t in self.tokenizer.model.tokenize(low.translate(self.spelled))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        raw = np.asarray(ids, "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            self.held += 4 * len(piece) + len(raw) + ENTRY_BYTES
            if self.held > MEMORY_BYTES:
                self.clear()
                self.held = 0
            self[piece] = raw
        return raw

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_MEMORIES: dict[tuple[str, bool], WordMemory] = {}


def words_apart(path: str) -> bool:
    """True for a byte-level vocabulary of the known normal form and pattern, whose control strings all have a mark before a letter."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    normal = tuple(n.get("type") for n in (conf.get("normalizer") or {}).get("normalizers") or ())
    pre = (conf.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    known = normal == NORMAL_FORM and len(pre) == 2 and pre[0].get("pattern", {}).get("Regex") == WORD_PATTERN
    plain = known and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
    return bool(plain and splits_at_spaces(path) and not any(t["content"][:1].isalpha() for t in conf.get("added_tokens") or []))


def splits_at_spaces(path: str) -> bool:
    """True if a tokenizer file drops white space between pre-tokens, so that spaces part a text into independent pieces."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    first = conf.get("pre_tokenizer") or {}
    first = (first.get("pretokenizers") or [first])[0]
    added = [t["content"] for t in conf.get("added_tokens") or []]
    lone = conf.get("post_processor") is None and not any(" " in t or "\n" in t for t in added)
    return lone and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "\\s" in first["pattern"].get("Regex", "") and "[^\\s" in first["pattern"]["Regex"]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text", specials_as_text: bool = False) -> DataFrame:
    """One row a piece: key, piece (from 0), start (ids of the document before it), length, ids (binary, little-endian
    unsigned 32-bit: the layout of token files).

    A document is the ids of its whole text, then ``end_id``; null and empty texts are ``end_id`` alone. Only documents
    longer than ``capacity`` are cut. ``specials_as_text`` says whether control strings inside a text count as text.
    The vocabulary file must be at ``tokenizer_path`` on every machine. Repeated and null keys are kept as they are.
    """
    kind = docs.schema[key].dataType.simpleString()
    by_spaces, end = splits_at_spaces(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
    fields = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        at = (tokenizer_path, specials_as_text)
        memory = _MEMORIES.get(at) or _MEMORIES.setdefault(at, WordMemory(*at))
        encode = memory.encode if by_spaces else lambda t: np.asarray(memory.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()

        def packed(rows: list, keys: pa.Array, kept: list[int]) -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), fields)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(kept, pa.int64())), *columns], names=["key", *fields.names])

        for batch in batches:
            rows, kept, held = [], [], 0
            for i, t in enumerate(batch.column(1)):
                raw = (encode(t.as_py() or "") if t.is_valid else b"") + end
                for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[start : start + 4 * capacity]
                    rows.append((k, start // 4, len(own) // 4, own))
                    kept.append(i)
                    held += len(own)
                    if held >= BATCH_BYTES:
                        yield packed(rows, batch.column(0), kept)
                        rows, kept, held = [], [], 0
            if rows:
                yield packed(rows, batch.column(0), kept)

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("key", key)


@dataclass(frozen=True)
class Fill:
    """``times`` equal sequences, each with the pieces of ``lengths`` (length, how many), longest first."""

    lengths: tuple[tuple[int, int], ...]
    times: int


def best_two_fit(counts: dict[int, int], capacity: int) -> list[Fill]:
    """The fills for ``counts`` (length -> pieces, lengths from 1 to ``capacity``), in the order in which they are made.

    Of pairs that fill the gap equally, the one with the longer first piece is taken. Zero counts are left out.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    have = np.array(sorted(left), np.int64)
    fills = []
    while left:
        fill = _greedy(left, have, capacity)
        room = capacity - sum(x * n for x, n in fill.items())
        if room and sum(fill.values()) > 1:
            least = min(fill)
            pair = _best_pair({x: n - fill.get(x, 0) for x, n in left.items()}, have, least, room + least)
            if pair:
                for x, n in ((least, -1), (pair[0], 1), (pair[1], 1)):
                    fill[x] = fill.get(x, 0) + n
                fill = {x: n for x, n in fill.items() if n}
        times = min(left[x] // n for x, n in fill.items())
        fills.append(Fill(tuple(sorted(fill.items(), reverse=True)), times))
        for x, n in fill.items():
            left[x] -= n * times
        if any(not left[x] for x in fill):
            left = {x: n for x, n in left.items() if n}
            have = np.array(sorted(left), np.int64)
    return fills


def _greedy(left: dict[int, int], have: np.ndarray, capacity: int) -> dict[int, int]:
    lengths, fill, room, i = have.tolist(), {}, capacity, len(have)
    while (i := bisect_right(lengths, room, 0, i) - 1) >= 0:
        x = lengths[i]
        fill[x] = min(left[x], room // x)
        room -= x * fill[x]
    return fill


def _best_pair(unpacked: dict[int, int], have: np.ndarray, least: int, gap: int) -> tuple[int, int] | None:
    """The two unpacked pieces with the largest sum up to ``gap`` that beats ``least``; none if there are none."""
    n = np.array([unpacked[x] for x in have.tolist()], np.int64)
    xs, n = have[n > 0], n[n > 0]
    first = np.flatnonzero(xs < gap)
    if not len(first):
        return None
    second = np.minimum(np.searchsorted(xs, gap - xs[first], "right") - 1, first)
    second = np.where((second == first) & (n[first] < 2), second - 1, second)
    total = np.where(second >= 0, xs[first] + xs[np.maximum(second, 0)], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(xs[first[best]]), int(xs[second[best]])) if total[best] > least else None


class Places:
    """The ranges of ranks that each fill owns, and where the pieces in them go."""

    def __init__(self, fills: list[Fill]):
        rows, used, sequence = [], {}, 0
        for f in fills:
            offset = 0
            for x, n in f.lengths:
                rows.append((x, used.get(x, 0), sequence, n, offset))
                used[x] = used.get(x, 0) + n * f.times
                offset += x * n
            sequence += f.times
        self.sequences = sequence
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.key = self._key(self.table[:, 0], self.table[:, 1])

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Length, then rank: up to 2^44 pieces of one length."""
        return length << 44 | rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and ranks."""
        _, first, sequence, n, offset = self.table[np.searchsorted(self.key, self._key(length, rank), "right") - 1].T
        at = rank - first
        return sequence + at // n, offset + at % n * length


def place(rows: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``rows`` (one a piece, lengths from 1 to ``capacity``) with sequence_id (dense, from 0) and offset (gapless, from 0).

    All columns of ``rows`` are written to the shared folder once, so take no more than are needed. Equal rows get places
    of their own. Lengths outside the range, null among them, raise; empty ``rows`` give none.
    """
    if not 0 < capacity <= MOST_CAPACITY:
        raise ValueError(f"capacity {capacity} is not in 1 to {MOST_CAPACITY}")
    spark = rows.sparkSession
    fine = F.col(length).between(1, capacity) & F.col(length).isNotNull()
    size = F.when(fine, F.col(length)).otherwise(F.raise_error(F.concat(F.lit("piece length out of range: "), F.coalesce(F.col(length).cast("string"), F.lit("null"))))).cast("long")
    written = cut(rows.select(F.struct(*[F.col(c) for c in rows.columns]).alias("row"), size.alias("size"), F.monotonically_increasing_id().alias("at")), "pieces")
    task = F.shiftright("at", 33)  # the partition that wrote the piece
    per_task = written.groupBy("size", task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    per_task = cut(per_task.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("task")) - F.col("n")), "piece-counts")
    counts = {r["size"]: r["n"] for r in per_task.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(Places(best_two_fit(counts, capacity)))
    own = Window.partitionBy("size", "task").orderBy("at")
    ranked = written.withColumn("task", task).withColumn("rank", F.row_number().over(own) - 1).join(per_task.hint("merge"), ["size", "task"])  # as many counts as tasks and lengths: never broadcast

    def find(size, rank):
        import pandas as pd

        sequence, offset = shared.value.find(size.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("to", F.pandas_udf(find, "sequence_id long, offset long")(F.col("size"), F.col("before") + F.col("rank")))
    return placed.select(*[F.col("row")[c].alias(c) for c in rows.columns if c not in ("sequence_id", "offset")], "to.sequence_id", "to.offset")


def sequences(placed: DataFrame, ids: str = "ids") -> DataFrame:
    """One row a sequence: sequence_id, ids (binary: its pieces in order) and starts (array: where each piece begins).

    A sequence has at most ``capacity`` ids, so a group is bounded.
    """
    own = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids")))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return own.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their ids and places: ``sequences`` makes the training rows of them."""
    return place(pieces(docs, tokenizer_path, capacity, end_id, key, text), capacity)
