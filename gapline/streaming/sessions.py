"""Gap clustering over event time: the streaming form of ``cluster_by_gap``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, *, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): events of a key less than ``gap`` apart.  A stream closes sessions by its watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("last").alias("end"), "n")


def enrich(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A stream joined to a static table."""
    return events.join(dimension, key, "left")
