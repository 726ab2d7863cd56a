"""Zonal statistics over pixel files as they arrive: sums per group in complete mode, or per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_zonal(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count and sum by keys over a stream of pixels; state holds one row per key."""
    return pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"))


def windowed_alerts(alerts: DataFrame, time: str, late: str = "10 minutes", window: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """Alert counts by event-time window; rows later than the watermark are left out and their state is dropped."""
    w = F.window(time, window).alias("window")
    return alerts.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("count"))
