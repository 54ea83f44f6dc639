"""Merged regions of a stream: intervals that arrive late or out of order, within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_regions(regions: DataFrame, gap: str = "900 seconds", late: str = "1 hour") -> DataFrame:
    """(doc_id, start, end, pieces) of a stream of (doc_id, start TIMESTAMP, end TIMESTAMP): like `islands`, but final once
    the watermark has passed the end. A piece opens a session of its own length plus the gap, and sessions that touch
    are one, so that the state holds open regions only."""
    length = F.unix_micros("end") - F.unix_micros("start")
    until = F.concat((length / 1_000_000).cast("decimal(20,6)").cast("string"), F.lit(" seconds"))
    session = F.session_window("start", F.concat(until, F.lit(f" {gap}")))
    merged = regions.withWatermark("start", late).groupBy("doc_id", session.alias("s")).agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("pieces"))
    return merged.select("doc_id", F.col("s.start").alias("start"), "end", "pieces")


def stream_counts(words: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Words per document and window of event time (doc_id, ts): each window once, after the watermark has passed it."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = words.withWatermark("ts", late).groupBy("doc_id", at.alias("w")).agg(F.count(F.lit(1)).alias("words"))
    return counted.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "words")
