"""Exact n-gram Jaccard self-join by token-combination prefixes, and the components of its links.

A document's tokens are its distinct word shingles. All tokens have one global order: rare ones first, then frequent
ones by rising level of their document frequency, by hash within a level. Two sets of sizes n >= m and Jaccard
similarity >= 0.8 share at least o = ceil(4 (n + m) / 9) tokens, so the q least tokens that they share stand among the
first n - o + q of one and the first m - o + q of the other.

* If they share a rare token, both index it alone: every document indexes its first rare tokens.
* Else all that they share is frequent. Frequent tokens fall into g classes by hash. Prefixes of the frequent tokens are
  extended to q = g (k - 1) + 1, so k of the shared ones fall into one class, and all combinations of k tokens of a
  class are indexed. The size band of the smaller set is part of the entry: a document stands in its own band as the
  smaller set and in all bands from 0.8 n to n as the larger one, each with the prefix that these sizes need. A set whose
  own rare tokens rule out any similar set of a band's sizes has no entry there, so texts that share a passage and differ
  otherwise don't meet.

Rows of one entry are candidates. First each row meets only the entry's most central row, the one with the most frequent
tokens; verified links become components. Then rows of different components in one entry meet as larger and smaller set.
Entries that would make very many pairs are replaced by combinations of k + 1 tokens of their documents, until there are
none left or k is ``MOST_K``. Pairs inside a component need no check. No entry is cut short, no link between components
is lost. Equal sets are one node from the start.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from uqframe.llm.common import cut, discard, spare
from uqframe.llm.components import connected_components

#: Words in a shingle, and the least similarity in percent.
WIDTH, PERCENT = 5, 80
#: A token in at least this many documents may be called frequent.
FREQUENT = 8
#: Frequent tokens at most: their fingerprints and levels, 9 bytes each, are broadcast. The frequency bound rises until they fit.
MOST_FREQUENT = 1 << 21
#: Tokens a task counts before it hands them on, and tokens of a counting group.
FLUSH, GROUP = 2_000_000, 2_000_000
#: Tokens of a combination, at first and at most; pairs beyond which an entry's documents go on to longer combinations.
LEAST_K, MOST_K, CROWDED = 2, 5, 1 << 16
#: Pairs of an entry beyond which the sets' maps are compared where rows meet.
MAPPED = 64
#: Documents of an entry that one task orders: entries whose tokens are in more documents are dealt into parts.
HOT = 1 << 12
#: Tokens of a size band's least set for each class of frequent tokens, and the ratio of its largest to its least set.
TOKENS_OF_CLASS, BAND = 20, 1.04
#: Bits of the map that tells unlike sets apart before they are compared in full.
MAP_BITS = 1024
#: Bits of the filter of wanted documents: for each of them, at least, at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def tokens(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64). bytes.lower and bytes.split know exactly A-Z and the ASCII white space."""
    ws = text.encode().lower().split() if text else []
    n = len(ws)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, n)
    short = min(n, width)
    with np.errstate(over="ignore"):
        total = np.full(n - short + 1, short, np.uint64)
        for k in range(short):
            total += h[k : n - short + 1 + k] * _MULTIPLIERS[k % len(_MULTIPLIERS)] + _mix(np.array([k // len(_MULTIPLIERS)], np.uint64))[0]
        return np.unique(_mix(total))


def set_keys(own: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of the whole set; together they stand for the set."""
    h = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def bit_map(own: np.ndarray) -> bytes:
    """MAP_BITS parities of the tokens by hash: two sets differ in at least as many tokens as their maps in bits."""
    return np.packbits(np.bincount((own >> np.uint64(7)).astype(np.int64) & (MAP_BITS - 1), minlength=MAP_BITS).astype(np.uint8) & 1).tobytes()


_SCAN = (("doc_id", pa.int64(), "bigint"), ("text_hash", pa.int64(), "bigint"), ("key", pa.int64(), "bigint"), ("second", pa.int64(), "bigint"), ("n", pa.int64(), "bigint"), ("map", pa.binary(), "binary"), ("part", pa.int32(), "int"), ("size", pa.int64(), "bigint"), ("packed", pa.binary(), "binary"))


def _scanned(**columns: pa.Array) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(rows, k)) for n, k, _ in _SCAN], names=[n for n, _, _ in _SCAN])


@dataclass(frozen=True)
class _Counter:
    """Fingerprints are a hash's top ``bits``; their counts are kept in ``parts`` ranges, as packed differences.

    ``key_bits`` of a set's first hash are used; fewer than 64 make sets clash, for tests.
    """

    bits: int
    parts: int
    key_bits: int = 64
    frequent: int = FREQUENT

    def fingerprints(self, own: np.ndarray) -> np.ndarray:
        return own >> np.uint64(64 - self.bits)

    def keys(self, own: np.ndarray) -> tuple[int, int]:
        key, second = set_keys(own)
        return key >> (64 - self.key_bits), second

    def pack(self, gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        seen = np.sort(np.concatenate(gathered))
        at = np.searchsorted(seen, (np.arange(1, self.parts, dtype=np.float64) * (2.0**self.bits / self.parts)).astype(np.uint64))
        part, packed = [], []
        for p, own in enumerate(np.split(seen, at)):
            if len(own):
                steps = np.diff(own, prepend=np.uint64(0))
                planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes()
                part.append(p)
                packed.append(pa.compress(planes, codec="zstd", asbytes=True))
        sizes = [len(x) for x in np.split(seen, at) if len(x)]
        yield _scanned(part=pa.array(part, pa.int32()), size=pa.array(sizes, pa.int64()), packed=pa.array(packed, pa.binary()))

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass: a row for each document (doc_id to map), and packed fingerprints whenever FLUSH are gathered."""
        gathered, total = [], 0
        for batch in batches:
            keys, sizes, maps = [], [], []
            for t in batch.column(1):
                own = tokens(t.as_py())
                keys.append(self.keys(own))
                sizes.append(len(own))
                maps.append(bit_map(own))
                gathered.append(self.fingerprints(own))
                total += len(own)
                if total >= FLUSH:
                    yield from self.pack(gathered)
                    gathered, total = [], 0
            first, second = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
            yield _scanned(doc_id=batch.column(0), text_hash=batch.column(2), key=first, second=second, n=pa.array(sizes, pa.int64()), map=pa.array(maps, pa.binary()))
        if total:
            yield from self.pack(gathered)

    def count(self, table: pa.Table) -> pa.Table:
        """Fingerprints of one range that stand in at least ``frequent`` documents."""
        own = []
        for size, packed in zip(table.column("size").to_pylist(), table.column("packed").to_pylist()):
            planes = pa.decompress(packed, decompressed_size=8 * size, codec="zstd", asbytes=True)
            own.append(np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel().cumsum(dtype=np.uint64))
        found, n = np.unique(np.concatenate(own), return_counts=True)
        often = n >= self.frequent
        return pa.table({"fingerprint": pa.array(found[often].astype(np.int64)), "df": pa.array(n[often], pa.int64())})


def scan(docs: DataFrame, key_bits: int = 64) -> tuple[_Counter, DataFrame]:
    """doc_id, text and text_hash of all documents, read once: what ``_Counter.scan`` yields, in the shared folder."""
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    likely = max(size // 6, 1)
    counter = _Counter(bits=min(62, max(32, likely.bit_length() + 4)), parts=max(64, -(-likely // GROUP)), key_bits=key_bits, frequent=FREQUENT)
    return counter, cut(docs.select("doc_id", "text", "text_hash").mapInArrow(counter.scan, ", ".join(f"{n} {t}" for n, _, t in _SCAN)), "scan")


def frequent_tokens(counter: _Counter, scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of the frequent tokens, counted over all documents, and their levels: twice the logarithm of
    the count. Never more than MOST_FREQUENT: beyond it the bound of frequency rises, and what falls below it is rare.
    """
    packed = scanned.where("part is not null").select("part", "size", "packed")
    counts = cut(packed.groupBy("part").applyInArrow(lambda t: counter.count(t), "fingerprint bigint, df bigint"), "frequent")
    steps = counts.groupBy(F.floor(F.log2("df") * 4).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("least")).orderBy(F.desc("step")).collect()
    bound, total = None, 0
    for s in steps:
        total += s.n
        if total > MOST_FREQUENT:
            break
        bound = s.least
    if bound is None:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    own = counts.where(F.col("df") >= bound).select("fingerprint", F.floor(F.log2("df") * 2).cast("tinyint").alias("level")).toPandas().sort_values("fingerprint")
    return own["fingerprint"].to_numpy().astype(np.uint64), own["level"].to_numpy().astype(np.uint8)


def needed(n: int, m: int | None = None) -> int:
    """Least overlap of similar sets of n and m tokens; without m, with any set that is similar to one of n."""
    return -(-PERCENT * n // 100) if m is None else -(-PERCENT * (n + m) // (100 + PERCENT))


@cache
def band(m: int) -> int:
    """The size band of m: bands are geometric, of ratio BAND."""
    return int(np.log(m) / np.log(BAND))


@cache
def least_of(b: int) -> int:
    """The least size of band b."""
    m = max(1, int(BAND**b) - 1)
    while band(m) < b:
        m += 1
    return m


@cache
def classes_of(b: int, k: int) -> int:
    """Classes of frequent tokens in band b: no more than leave k shared tokens in one class."""
    least = least_of(b)
    return max(1, min(least // TOKENS_OF_CLASS, (needed(least, least) - 1) // (k - 1)))


@cache
def _chosen(c: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(c), k)), np.int64).reshape(-1, k)


def combinations(own: np.ndarray, g: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-combinations of tokens of one class, and the places of their first and last token in ``own``."""
    group = (own % np.uint64(g)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    sizes = np.diff(starts, append=len(order))
    places = [order[starts[sizes == c][:, None] + np.arange(c)][:, _chosen(c, k)].reshape(-1, k) for c in np.unique(sizes) if c >= k]
    if not places:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.concatenate(places)
    with np.errstate(over="ignore"):
        return (own[at] * _MULTIPLIERS[:k]).sum(axis=1, dtype=np.uint64), at[:, 0], at[:, -1]


def single_entries(own: np.ndarray, is_frequent: np.ndarray) -> np.ndarray:
    """The rare tokens of the longest prefix, each an entry; none below four tokens, as such sets are similar only to equal ones."""
    n = len(own)
    return own[~is_frequent][: n - needed(n) + 1] if n >= 4 else np.empty(0, np.uint64)


def combined_entries(own: np.ndarray, is_frequent: np.ndarray, level: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (uint64) of k-combinations of frequent tokens in all bands; whether they hold for the set as the smaller one;
    the level of the combination's rarest token. ``level`` goes with the frequent tokens.
    """
    n, often = len(own), own[is_frequent]
    out = [(np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.uint8))]
    if n >= 4 and len(often) >= needed(n):
        order = np.lexsort((_mix(often), level))
        often, level = often[order], level[order]
        for b in range(band(needed(n)), band(n) + 1):
            if band(least_of(b)) != b:  # no size falls into it
                continue
            g = classes_of(b, k)
            beyond = g * (k - 1) + 1 + len(often)
            length = beyond - needed(n, max(least_of(b), needed(n)))
            if length < beyond - len(often):  # too few frequent tokens for any set of these sizes
                continue
            taken = often[:length]
            found, first, last = combinations(taken, g, k)
            as_small = last < beyond - needed(n, n) if b == band(n) and len(often) >= needed(n, n) else np.zeros(len(found), bool)
            with np.errstate(over="ignore"):
                out.append((_mix(found + np.uint64(b * 8 + k)), as_small, level[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass(frozen=True)
class _Indexer:
    """Makes index rows in tasks. ``shared``: broadcast (frequent fingerprints, their levels, first hashes that unlike sets share)."""

    counter: _Counter
    shared: object
    hot: int

    def node(self, own: np.ndarray) -> int:
        clashing = self.shared.value[2]
        key, second = self.counter.keys(own)
        return second if len(clashing) and clashing[min(np.searchsorted(clashing, key), len(clashing) - 1)] == key else key

    def rows(self, own: np.ndarray, node: int, k: int, singles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, salt, about) of one set. about is 0 for a rare token, else mean level of all tokens, frequent tokens and
        whether the entry holds for the smaller set, packed: the more central a set, the larger."""
        frequent, levels, _ = self.shared.value
        fp = self.counter.fingerprints(own)
        at = np.minimum(np.searchsorted(frequent, fp), max(len(frequent) - 1, 0))
        is_frequent = frequent[at] == fp if len(frequent) else np.zeros(len(own), bool)
        level = levels[at[is_frequent]] if len(frequent) else np.empty(0, np.uint8)
        alone = single_entries(own, is_frequent) if singles else np.empty(0, np.uint64)
        entries, as_small, least = combined_entries(own, is_frequent, level, k)
        if not len(entries):
            return alone.view(np.int64), np.full(len(alone), -1, np.int32), np.zeros(len(alone), np.int64)
        central = int(level.sum(dtype=np.int64) * 64 // len(own))
        about = (np.int64(central) << np.int64(33)) + np.int64(2 * len(level)) + as_small
        parts = np.ceil(2 ** ((least.astype(np.float64) + 1) / 2) / self.hot).astype(np.int64)
        salt = np.where(parts > 1, (node & 0x7FFFFFFF) % parts, -1).astype(np.int32)
        return np.concatenate([alone, entries]).view(np.int64), np.concatenate([np.full(len(alone), -1, np.int32), salt]), np.concatenate([np.zeros(len(alone), np.int64), about])

    def index(self, batches: Iterator[pa.RecordBatch], k: int, singles: bool, wanted=None) -> Iterator[pa.RecordBatch]:
        """(entry, salt, node, about) of each set, once a task for equal sets; only of wanted documents if a filter is given."""
        seen = set()
        for batch in batches:
            gathered, nodes = [], []
            for i in _hits(batch, wanted):
                own = tokens(batch.column(0)[i].as_py())
                node = self.node(own)
                if len(own) < 4 or node in seen:
                    continue
                seen.add(node)
                gathered.append(self.rows(own, node, k, singles))
                nodes.append(node)
            if gathered:
                entry, salt, about = (np.concatenate(x) for x in zip(*gathered))
                node = np.repeat(np.array(nodes, np.int64), [len(x[0]) for x in gathered])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (entry, salt, node, about)], names=["entry", "salt", "node", "about"])

    def sets(self, batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
        """(node, tokens) of the wanted documents, in batches of bounded size."""
        seen = set()
        for batch in batches:
            nodes, sets, total = [], [], 0
            for i in _hits(batch, wanted):
                own = tokens(batch.column(0)[i].as_py())
                node = self.node(own)
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(own.view(np.int64))
                    total += len(own)
                if total >= FLUSH:
                    yield _listed(nodes, sets)
                    nodes, sets, total = [], [], 0
            if nodes:
                yield _listed(nodes, sets)


def _listed(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["node", "tokens"])


def _hits(batch: pa.RecordBatch, wanted) -> list[int]:
    """Rows of the batch (text, place in the filter) whose bit is set."""
    if wanted is None:
        return range(batch.num_rows)
    at = batch.column(1).to_numpy()
    return np.flatnonzero(wanted.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist()


def _wanted(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> tuple[DataFrame, object]:
    """docs as (text, place) and a broadcast filter over places: bits of the least document of each of the nodes.

    The filter has bits in proportion to the nodes, up to a bound. What it lets through by chance costs time only.
    """
    ids = nodes.join(classes, "node").select("least")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * ids.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marked = ids.select((at("least") + 1).alias("at"))  # the bitmap functions count from 1
    rows = marked.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        start = (r.b - 1) * 4096
        out[start : start + 4096] = np.frombuffer(bytes(r.m), np.uint8)[: len(out) - start]
    return docs.select("text", at("doc_id").alias("at")), docs.sparkSession.sparkContext.broadcast(out)


def _map_words(c: str) -> list[Column]:
    """A map as signed 64-bit words."""
    return [F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("bigint") for i in range(MAP_BITS // 64)]


def _fits_maps(n: Column, m: Column, differ: Column) -> Column:
    """False only for sets of n and m tokens that can't be similar, as their maps differ in so many bits."""
    most = F.floor((n + m - differ) / 2)
    return 100 * most >= PERCENT * (n + m - most)


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and bit maps do not rule out; no similar pair is lost.

    The sets differ in at least as many tokens as their maps in bits, so (n + m - bits) / 2 bounds their overlap.
    """
    split = classes.select("node", "n", F.array(*_map_words("map")).alias("m"))
    both = pairs.join(split.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("m").alias("am")), "a").join(split.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("m").alias("bm")), "b")
    differ = F.aggregate(F.zip_with("am", "bm", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = 100 * F.least(F.col("an"), F.col("bn")) >= PERCENT * F.greatest(F.col("an"), F.col("bn"))
    return both.where(fits).where(_fits_maps(F.col("an"), F.col("bn"), differ)).select("a", "b")


@dataclass(frozen=True)
class _Join:
    """What all steps of one join share. docs: doc_id, text, text_hash; classes: node, n, map, least (its least doc_id)."""

    docs: DataFrame
    classes: DataFrame
    indexer: _Indexer

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar, by their whole sets. Only sets that stand in a pair are made again."""
        likely = cut(plausible(pairs, self.classes), "likely")
        texts, wanted = _wanted(self.docs, likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), self.classes)
        indexer = self.indexer
        sets = cut(texts.mapInArrow(lambda it: indexer.sets(it, wanted), "node bigint, tokens array<bigint>"), "sets")
        left, right = (sets.select(F.col("node").alias(s), F.col("tokens").alias(t)) for s, t in (("a", "x"), ("b", "y")))
        shared = F.size(F.array_intersect("x", "y"))
        links = cut(likely.join(left, "a").join(right, "b").where(100 * shared >= PERCENT * (F.size("x") + F.size("y") - shared)).select("a", "b"), "links")
        discard(likely, sets)
        return links

    def listed(self, k: int, nodes: DataFrame | None = None) -> DataFrame:
        """Rows (entry, node, about, leader) of entries with several nodes; combinations of k tokens of ``nodes`` alone, if given.

        The leader is the most central row of the entry, or of its part: an entry that may be large is dealt into parts
        (salt), which are kept even if they have one row.
        """
        indexer, texts, wanted, singles = self.indexer, self.docs.select("text"), None, nodes is None
        if nodes is not None:
            texts, wanted = _wanted(self.docs, nodes, self.classes)
        rows = texts.mapInArrow(lambda it: indexer.index(it, k, singles, wanted), "entry bigint, salt int, node bigint, about bigint")
        central = Window.partitionBy("entry", "salt").orderBy(F.desc("about"), "node")
        seen = rows.withColumns({"leader": F.first("node").over(central), "before": F.lag("node").over(central), "after": F.lead("node").over(central)})
        return cut(seen.where("before <> node or before is null and (after is not null or salt >= 0)").drop("before", "after"), "several")

    def stars(self, several: DataFrame) -> DataFrame:
        """Pairs of each row with its leader, and of the leaders of an entry's parts with the most central of them."""
        parts = several.where("salt >= 0 and leader = node")
        tops = parts.groupBy("entry").agg(F.max_by("node", F.struct("about", "node")).alias("top"))
        own = several.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b"))
        heads = parts.join(tops, "entry").where("top <> node").select(F.col("top").alias("a"), F.col("node").alias("b"))
        return own.union(heads).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def open_rows(self, several: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows (entry, node, about, c, pairs) of entries in which larger and smaller sets of different components (c) meet; pairs counts them."""
        known = several.join(labels, "node", "left").select("entry", "node", "about", F.coalesce("component", "node").alias("c"))
        small = F.when((F.col("about") == 0) | (F.col("about") % 2 == 1), 1).otherwise(0)
        by_c = known.groupBy("entry", "c").agg(F.count(F.lit(1)).alias("l"), F.sum(small).alias("s"))
        met = by_c.groupBy("entry").agg((F.sum("l") * F.sum("s") - F.sum(F.col("l") * F.col("s"))).alias("pairs")).where("pairs > 0")
        return cut(known.join(met, "entry"), "open")

    def pairs(self, rest: DataFrame) -> DataFrame:
        """Pairs of nodes in different components that meet in an entry as the larger and the smaller set, and whose sizes allow it.

        In entries that would make more than ``MAPPED`` pairs, the sets' maps meet with them: pairs that these rule out,
        nearly all of a group of texts made of the same passages, never become rows.
        """
        sized = rest.join(self.classes.select("node", "n"), "node")
        few, many = sized.where(F.col("pairs") <= MAPPED), sized.where(F.col("pairs") > MAPPED)
        maps = self.classes.select("node", *[w.alias(f"m{i}") for i, w in enumerate(_map_words("map"))])
        return self.met(few).union(self.met(many.join(maps, "node"))).distinct()

    def met(self, sized: DataFrame) -> DataFrame:
        """(a, b) for each entry in which they meet; by their maps too, if ``sized`` has them."""
        words_ = [c for c in sized.columns if c.startswith("m") and c[1:].isdigit()]
        most = F.when(F.col("about") == 0, F.col("n")).otherwise(F.shiftright(F.col("about").bitwiseAND((1 << 33) - 1), 1))
        side = lambda s: sized.select(F.col("entry").alias(f"{s}e"), F.col("node").alias(s), F.col("c").alias(f"{s}c"), F.col("n").alias(f"{s}n"), most.alias(f"{s}most"), "about", *[F.col(m).alias(s + m) for m in words_])
        larger, smaller = side("a").drop("about"), side("b").where("about = 0 or about % 2 = 1").drop("about")
        ordered = (F.col("an") > F.col("bn")) | (F.col("an") == F.col("bn")) & (F.col("a") > F.col("b"))
        allowed = (100 + PERCENT) * F.least(F.col("amost"), F.col("bmost")) >= PERCENT * (F.col("an") + F.col("bn"))
        if words_:
            differ = sum((F.bit_count(F.col(f"a{m}").bitwiseXOR(F.col(f"b{m}"))) for m in words_), F.lit(0))
            allowed &= _fits_maps(F.col("an"), F.col("bn"), differ)
        return larger.join(smaller, (F.col("ae") == F.col("be")) & (F.col("ac") != F.col("bc")) & ordered & allowed).select("a", "b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    return connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def joined(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, text_hash, n and c of each row of docs (doc_id, text, text_hash); c is the node of its component, null without words."""
    counter, scanned = scan(docs, key_bits)
    rows = scanned.where("part is null").select("doc_id", "text_hash", "key", "second", "n", "map")
    clashes = rows.where("n > 0").groupBy("key").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo <> hi").select("key")
    clashing = np.sort(clashes.toPandas()["key"].to_numpy().astype(np.int64))  # about 3 of 10^10 sets
    node = F.when(F.col("n") > 0, F.when(F.col("key").isin(clashing.tolist()), F.col("second")).otherwise(F.col("key")))
    members = rows.select("doc_id", "text_hash", "n", "map", node.alias("node"))
    classes = cut(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("map").alias("map")), "classes")

    join = _Join(docs, classes, _Indexer(counter, docs.sparkSession.sparkContext.broadcast((*frequent_tokens(counter, scanned), clashing)), HOT))
    k, several = LEAST_K, join.listed(LEAST_K)
    labels = connected_components(join.verified(join.stars(several)))
    rest, pairs = join.open_rows(several, labels), []
    discard(several)
    heavy = (F.col("pairs") > CROWDED) & (F.col("about") != 0)  # only what combinations find is found by longer ones
    while k < MOST_K and not (crowded := rest.where(heavy)).isEmpty():
        k += 1
        pairs.append(join.pairs(rest.where(~heavy)))
        several = join.listed(k, crowded.select("node").distinct())
        rest = join.open_rows(several, labels)
        discard(several)
    pairs.append(join.pairs(rest))
    every = pairs[0]
    for more in pairs[1:]:
        every = every.union(more)
    links = join.verified(every.distinct() if len(pairs) > 1 else every)
    if not links.isEmpty():
        labels = _merged(labels, links)
    found = cut(members.select("doc_id", "text_hash", "n", "node").join(labels, "node", "left").select("doc_id", "text_hash", "n", F.coalesce("component", "node").alias("c")), "joined")
    discard(scanned, classes)
    return found


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return own.withColumn("text_hash", F.xxhash64("text"))


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", key_bits: int = 64) -> DataFrame:
    """Per row: key, n_shingles, component_id (the least key that links reach, its own for a text without words).

    Null and empty texts have no shingles and link with nothing. Rows with equal shingle sets are one node, whatever
    their number; a null key is never the least one. Repeated keys are rows of their own.
    """
    found = joined(_named(docs, key, text), key_bits)
    least = found.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    placed = found.where("c is not null").join(least, "c").select("doc_id", "n", "component_id")
    alone = found.where("c is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return placed.union(alone).select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the least key, all its columns as they were; rows without a key stay, and
    rows without words. Unlike texts under one key are told apart by their texts; of rows with equal key and text one stays.
    """
    found = joined(_named(docs, key, text)).where("doc_id is not null")
    chosen = found.where("c is not null").groupBy("c").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("r.doc_id", "r.text_hash")
    kept = chosen.union(found.where("c is null").select("doc_id", "text_hash"))
    times = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    own, h, n = spare(docs, "__id", "__hash", "__times")
    wanted = kept.distinct().join(times, ["doc_id", "text_hash"]).select(F.col("doc_id").alias(own), F.col("text_hash").alias(h), F.col("times").alias(n))
    matched = docs.join(cut(wanted, "kept"), (docs[key].cast("bigint") == F.col(own)) & (F.xxhash64(docs[text]) == F.col(h)))
    once = matched.where(F.col(n) == 1).select(*docs.columns)
    repeated = matched.where(F.col(n) > 1).dropDuplicates([own, h]).select(*docs.columns)
    return once.union(repeated).union(docs.where(F.col(key).isNull()))
