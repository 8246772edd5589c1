"""Streaming calibration monitor: an extension, not part of the reference's batch analysis.

Events with a confidence and an outcome are summed by tumbling window and confidence bin; a late row counts until the
watermark passes it. Each window's expected calibration error is derived from its bins downstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uqframe.functions import vectors as V


def binned(events: DataFrame, window: str = "1 day", delay: str = "1 hour", time: str = "ts", confidence: str = "confidence", ok: str = "ok") -> DataFrame:
    """start, bin, n, hits, confidence: works on batch and streaming frames alike."""
    marked = events.withWatermark(time, delay) if events.isStreaming else events
    bins = marked.groupBy(F.window(time, window).alias("w"), V.bin_index(F.col(confidence)).alias("bin"))
    sums = bins.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(ok).cast("bigint")).alias("hits"), F.sum(confidence).alias("confidence"))
    return sums.select(F.col("w.start").alias("start"), "bin", "n", "hits", "confidence")


def calibration_error(bins: DataFrame) -> DataFrame:
    """start, n, ece of each window."""
    return bins.groupBy("start").agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("hits") - F.col("confidence"))) / F.sum("n")).alias("ece"))
