"""The 2-minute deduplication over a stream of pings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_2min_stream(pings: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Streaming pings(person, ts timestamp, ping_id, ...) -> the most accurate, earliest ping of each person and 2-minute window, given
    out once no later ping than `lateness` can change it."""
    rest = [c for c in pings.columns if c not in ("person", "ts", "accuracy", "ping_id")]
    window = F.window("ts", "2 minutes")
    best = F.min(F.struct("accuracy", "ts", "ping_id", *rest)).alias("best")
    return pings.withWatermark("ts", lateness).groupBy("person", window).agg(best).select("person", "best.*").select(*pings.columns)
