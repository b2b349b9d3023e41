"""Change streams: trailing entropy, sessions and late repeats with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.process import entropy_of


def deduplicated(changes: DataFrame, late: str = "7 days") -> DataFrame:
    """Changes (analysis_id, hash, file_path, at) without repeats that arrive within ``late``; state is dropped beyond it."""
    return changes.withWatermark("at", late).dropDuplicatesWithinWatermark(["analysis_id", "hash", "file_path"])


def windowed_entropy(changes: DataFrame, length: str = "30 days", slide: str = "1 day", late: str = "7 days") -> DataFrame:
    """Entropy of the lines (l) of each file's changes in sliding windows of event time.

    Entropy follows from sums (T, S), so the state of a window and file is three numbers, not its changes.
    """
    real = F.when(F.col("l") > 0, F.col("l"))
    out = changes.withWatermark("at", late).groupBy(F.window("at", length, slide), "analysis_id", "file_path").agg(F.sum(real).alias("T"), F.sum(real * F.log2(real)).alias("S"), F.count(real).alias("k"))
    return out.where("k > 0").select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "analysis_id", "file_path", entropy_of(F.col("T"), F.col("S"), F.col("k")).alias("entropy"))


def sessions(events: DataFrame, gap: str = "90 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each key of a stream (key, at); built-in session windows, closed when the watermark passes."""
    out = events.withWatermark("at", late).groupBy("key", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
