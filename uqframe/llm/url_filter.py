"""URL filter: rules by host and path, and for all other URLs a ratio of two character language models.

One variable-order Markov model is counted over the URLs that rules allow, one over those that rules block. A byte's
probability mixes contexts of 0 to ``ORDER`` bytes by Witten-Bell smoothing, from the uniform distribution up. A URL's
score is its log-likelihood difference per byte. The threshold is calibrated on labelled URLs that were held out of the
counts: the one of best balanced accuracy.

Counts are exact and grow with the URLs: a byte with its context is one number, not a hash, and the counts, the shorter
contexts that follow from them and the log ratio of every such number are tables in Spark. The commonest ``HEAD``
numbers are broadcast and summed where a URL is read; only the rare rest of a URL is joined, so no key of that join,
number or URL, is on more than a 1 / ``HEAD`` part of all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import ascii_lower, cut, discard, spare

#: Longest context in bytes.
ORDER = 4
#: A symbol is a byte plus 1, or 0 before the start; a byte and its context are ORDER + 1 symbols in one number.
SYMBOL_BITS = 9
#: At most so many (number, log ratio) are broadcast: 16 bytes each.
HEAD = 1 << 18
#: URLs are cut into numbers in portions of about so many bytes.
PORTION = 1 << 20
#: One labelled URL in this many calibrates, the others are counted.
CALIBRATION_SHARE = 5
#: Score bins for the calibration, from -LIMIT to LIMIT.
BINS, LIMIT = 2000, 4.0

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: A rule list is part of the query's expression, so it is bounded.
MOST_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path; both empty for null and without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest) + 1), r"(?s)^([^?#]*)", 1)
    return ascii_lower(host), path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits; null if none does.

    A rule is ``host/path``: it fits that host and its subdomains where the path starts with the rule's. Of equally
    long rules the one with the longer host counts, then a block.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"), r[1] == "block")):
        h, p = rule[: rule.index("/")].lower(), rule[rule.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the URLs with its context as a number, and the lengths of the URLs."""
    lengths = np.array([len(u) for u in urls], dtype=np.int64)
    b = np.array(bytearray(b"".join(urls)), dtype=np.int64) + 1
    place = np.arange(len(b)) - np.repeat(lengths.cumsum() - lengths, lengths)
    out = b.copy()
    for o in range(1, ORDER + 1):
        back = np.zeros_like(b)
        back[o:] = b[:-o]
        out |= np.where(place >= o, back, 0) << (SYMBOL_BITS * o)
    return out, lengths


def _portions(urls: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """First row and URLs of each portion, null as empty."""
    first, own, size = 0, [], 0
    for i, u in enumerate(urls):
        own.append((u or "").encode())
        size += len(own[-1])
        if size >= PORTION:
            yield first, own
            first, own, size = i + 1, [], 0
    if own:
        yield first, own


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n, c0, c1) of each portion: occurrences in all URLs, in counted rejected ones and in counted accepted ones."""
    for batch in batches:
        good = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
        for first, urls in _portions(batch.column(0).to_pylist()):
            found, lengths = grams(urls)
            own, at = np.unique(found, return_inverse=True)
            of = np.repeat(good[first : first + len(urls)], lengths)
            counts = [np.bincount(at[m], minlength=len(own)).astype(np.int64) for m in (slice(None), of == 0, of == 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, *counts)], names=["gram", "n", "c0", "c1"])


def gather(urls: DataFrame) -> DataFrame:
    """gram, n, c0, c1 of all ``urls`` (url, good): good is 0 or 1 where a URL teaches, null where it is only to be scored."""
    return urls.select("url", F.col("good").cast("int")).mapInArrow(_count, "gram bigint, n bigint, c0 bigint, c1 bigint").groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "c0", "c1")])


def _symbols(k: int) -> Column:
    """The last k symbols of ``gram``."""
    return F.col("gram").bitwiseAND(F.lit((1 << SYMBOL_BITS * k) - 1))


def log_ratios(counts: DataFrame) -> DataFrame:
    """gram, n, w of each gram of ``gather``: log-likelihood of accepted minus rejected of its byte after its context.

    Counts of shorter contexts are sums over longer ones. A context that one class has never seen passes on the
    probability of the next shorter one; a class without URLs has the uniform distribution. A context of any length
    has at most 256 bytes after it, and a shorter one at most 257 longer ones by one symbol: no join has a hot key.
    """
    known = None
    for o in range(ORDER + 1):
        pairs = counts.groupBy(_symbols(o + 1).alias("gram")).agg(*[F.sum(c).alias(c) for c in ("n", "c0", "c1")])
        seen = [a for c in ("0", "1") for a in (F.sum(f"c{c}").alias(f"t{c}"), F.count_if(F.col(f"c{c}") > 0).alias(f"k{c}"))]
        contexts = pairs.groupBy(F.shiftright("gram", SYMBOL_BITS).alias("context")).agg(*seen)
        at = pairs.join(contexts, F.shiftright("gram", SYMBOL_BITS) == F.col("context"))
        if known is None:
            at = at.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            at = at.join(known.select(F.col("gram").alias("shorter"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), _symbols(o) == F.col("shorter"))
        mixed = [F.coalesce((F.col(f"c{c}") + F.col(f"k{c}") * F.col(f"q{c}")) / F.nullif(F.col(f"t{c}") + F.col(f"k{c}"), F.lit(0)), F.col(f"q{c}")).alias(f"p{c}") for c in (0, 1)]
        known = at.select("gram", "n", *mixed)
    return known.select("gram", "n", (F.ln("p1") - F.ln("p0")).alias("w"))


def best_threshold(per: np.ndarray) -> float:
    """The bin edge of best balanced accuracy when scores from it on are accepted; of equals the one nearest to 0."""
    if not per.sum(axis=1).all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), per.cumsum(axis=1)], axis=1)[:, : BINS + 1]
    right = below[0] / per[0].sum() + 1 - below[1] / per[1].sum()
    edges = np.arange(BINS + 1) * (2 * LIMIT / BINS) - LIMIT
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(edges[best[np.abs(edges[best]).argmin()]])


def threshold_of(scores: DataFrame) -> float:
    """The calibrated threshold of ``scores`` (good, score), which the counts have not seen."""
    bin_ = F.least(F.greatest(F.floor((F.col("score") + LIMIT) / (2 * LIMIT) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    found = scores.groupBy(bin_.alias("bin"), "good").count().toPandas()
    per = np.zeros((2, BINS + 1))
    per[found["good"].to_numpy(), found["bin"].to_numpy()] = found["count"].to_numpy()
    return best_threshold(per)


def scored(df: DataFrame, ratios: DataFrame, url: str = "url", head: int = HEAD) -> DataFrame:
    """``df`` with ``score``, the mean log ratio of a URL's bytes to 12 decimals; 0 for null and empty URLs.

    A column of that name is replaced. A gram that is not among ``ratios`` (gram, n, w) weighs 0.
    """
    total = ratios.agg(F.sum("n")).head()[0] or 0
    common = ratios.where(F.col("n") >= total // head + 1).select("gram", "w").toPandas().sort_values("gram")  # at most ``head`` rows
    shared = df.sparkSession.sparkContext.broadcast((np.append(common["gram"].to_numpy(np.int64), -1), np.append(common["w"].to_numpy(np.float64), 0.0)))

    def run(urls: pd.Series) -> pd.DataFrame:
        known, weight = shared.value
        rows = []
        for _, own in _portions(list(urls)):
            found, lengths = grams(own)
            at = np.searchsorted(known[:-1], found)
            rare, w, ends = known[at] != found, weight[at], lengths.cumsum()
            w[rare] = 0.0
            rows += [(n, w[e - n : e].sum(), found[e - n : e][rare[e - n : e]]) for n, e in zip(lengths.tolist(), ends.tolist())]
        return pd.DataFrame(rows, columns=["bytes", "sum", "rare"])

    text, (h, i, p, w) = F.col(url), spare(df, "__h", "__i", "__p", "__w")
    named = [F.xxhash64(text).alias(h), F.xxhash64(text, F.lit(1)).alias(i)]
    columns = [F.col(c) for c in df.columns if c != "score"]
    parts = cut(df.select(*columns, *named, F.pandas_udf(run, "bytes bigint, sum double, rare array<bigint>")(text).alias(p)), "url-parts")
    score = lambda more: F.round(F.coalesce((F.col(p)["sum"] + more) / F.nullif(F.col(p)["bytes"], F.lit(0)), F.lit(0.0)), 12).alias("score")
    few = parts.where(F.size(F.col(p)["rare"]) > 0)
    asked = few.dropDuplicates([h, i]).select(h, i, F.explode(F.col(p)["rare"]).alias("gram"))
    sums = asked.join(ratios.select("gram", F.col("w").alias(w)), "gram").groupBy(h, i).agg(F.sum(w).alias(w))
    joined = few.join(sums, [h, i], "left").select(*columns, score(F.coalesce(w, F.lit(0.0))))
    return parts.where(F.size(F.col(p)["rare"]) == 0).select(*columns, score(F.lit(0.0))).union(joined)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url", head: int = HEAD) -> DataFrame:
    """Per row: key, host, path, rule, verdict, score. The models learn from the URLs that rules decide.

    Repeated rows and null keys are judged each; a tie with the threshold is allowed; null URLs are empty texts. Where
    rules decide no URL, every score is 0 and every other URL is allowed; where they decide one way only, the scores
    say how much likelier that class finds a URL than the uniform distribution does, and the threshold is 0.
    """
    host, path = host_and_path(F.col("u"))
    own = pages.select(F.col(key).alias("k"), F.col(url).alias("u")).withColumns({"host": host, "path": path})
    own = own.withColumn("m", matching_rule(F.col("host"), F.col("path"), rules))
    held = F.pmod(F.xxhash64("u"), F.lit(CALIBRATION_SHARE)) == 0
    good = F.when(F.col("m").isNotNull() & F.col("u").isNotNull(), (F.col("m.verdict") == "allow").cast("int"))
    counts = cut(gather(own.select(F.col("u").alias("url"), F.when(~held, good).alias("good"))), "url-grams")
    ratios = cut(log_ratios(counts), "url-ratios")
    done = cut(scored(own, ratios, "u", head), "url-scores")
    discard(counts, ratios)
    threshold = threshold_of(done.where(held).select(good.alias("good"), "score").where("good is not null"))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return done.select(F.col("k").alias(key), "host", "path", F.col("m.rule").alias("rule"), F.coalesce(F.col("m.verdict"), by_model).alias("verdict"), "score")
