"""Deduplication and noise removal of pings.

After dedup_2min a person has at most 720 pings a day, and windows span a person's day (sequence.py), so no task grows with the length of
the observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copresence.functions.geo import fast_distance, geodesic_distance
from copresence.functions.rules import MICROS_HOUR, MICROS_MINUTE, accuracy_radius, movement, movement_radius, speed_kmh
from copresence.operators.sequence import with_neighbours


def in_order():
    """A person's pings in time."""
    return Window.partitionBy("person").orderBy("us", "ping_id")


def usable(pings: DataFrame, start_date: str) -> DataFrame:
    """Pings from the start date on with coordinates that are neither null nor exactly zero."""
    here = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("lat") != 0) & (F.col("lon") != 0)
    return pings.filter((F.col("ts") >= F.lit(start_date).cast("timestamp_ntz")) & here)


def dedup_2min(pings: DataFrame) -> DataFrame:
    """One ping a person and 2-minute bin: the most accurate, the earliest of those. Minima combine before the shuffle. Without accuracies only
    pings of equal time and place count as one."""
    if "accuracy" not in pings.columns:
        rest = [c for c in pings.columns if c not in ("person", "us", "lat", "lon", "ping_id")]
        first = pings.groupBy("person", "us", "lat", "lon").agg(F.min(F.struct("ping_id", *rest)).alias("best"))
        return first.select("person", "us", "lat", "lon", "best.*").select(*pings.columns)
    bin_ = F.floor(F.col("us") / F.lit(2 * MICROS_MINUTE)).alias("bin")
    rest = [c for c in pings.columns if c not in ("accuracy", "us", "ping_id", "person")]
    best = F.min(F.struct("accuracy", "us", "ping_id", *rest)).alias("best")
    return pings.groupBy("person", bin_).agg(best).select("person", "best.*").select(*pings.columns)


def drop_jitter(pings: DataFrame) -> DataFrame:
    """Without pings that leap from the ping before, dropped or not, at over 1000 km/h within half an hour. Persons with
    under 3 pings keep them all."""
    near = with_neighbours(pings, ["lat", "lon"], previous="_p", total="_all")
    leap = leaps(F.col("us") - F.col("_p.us"), F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon"))
    return near.filter(~(F.coalesce(leap, F.lit(False)) & (F.col("_all") >= 3))).select(*pings.columns)


def leaps(gap_us: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whether a move is over 1000 km/h within half an hour."""
    gap_h = gap_us / F.lit(float(MICROS_HOUR))
    return (gap_h > 0) & (gap_h < 0.5) & (fast_distance(lat1, lon1, lat2, lon2) / 1000.0 / gap_h > 1000)


def tag_radius(pings: DataFrame) -> DataFrame:
    """geofence_radius from the accuracy where there is none yet."""
    known = F.col("geofence_radius") if "geofence_radius" in pings.columns else F.lit(None).cast("double")
    return pings.withColumn("geofence_radius", F.coalesce(known, accuracy_radius(F.col("accuracy"))))


def with_speed(pings: DataFrame) -> DataFrame:
    """speed_kmh to the person's next ping where that is under 2 hours off, else 0."""
    near = with_neighbours(pings, ["lat", "lon"], following="_n")
    return near.select(*(c for c in pings.columns if c != "speed_kmh"), speed_to(F.col("_n.us") - F.col("us"), F.col("lat"), F.col("lon"), F.col("_n.lat"), F.col("_n.lon")).alias("speed_kmh"))


def speed_to(gap_us: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Speed of a move that takes under 2 hours, else 0."""
    gap_h = gap_us / F.lit(float(MICROS_HOUR))
    return F.when((gap_h > 0) & (gap_h < 2), geodesic_distance(lat1, lon1, lat2, lon2) / 1000.0 / gap_h).otherwise(0.0)


def segments(pings: DataFrame, max_gap_hours: float = 18.0) -> DataFrame:
    """Legs between consecutive pings of a person, classified by speed; longer gaps make no leg."""
    near = with_neighbours(pings.select("person", *("ping_id", "us", "lat", "lon")), ["lat", "lon"], following="n")
    return legs_between(near, max_gap_hours)


def legs_between(near: DataFrame, max_gap_hours: float = 18.0) -> DataFrame:
    """near(person, ping_id, us, lat, lon, n): pings and what follows each -> legs."""
    legs = near.select(
        "person", F.col("ping_id").alias("seg_id"), F.col("us").alias("start_us"), F.col("n.us").alias("end_us"),
        F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"), F.col("n.lat").alias("end_lat"), F.col("n.lon").alias("end_lon"),
    )
    gap_h = (F.col("end_us") - F.col("start_us")) / F.lit(float(MICROS_HOUR))
    legs = legs.filter("end_us IS NOT NULL").withColumn("gap_h", gap_h).filter(F.col("gap_h") <= max_gap_hours)
    legs = legs.withColumn("dist_m", fast_distance(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon")))
    legs = legs.withColumns({"speed_kmh": speed_kmh(F.col("dist_m"), F.col("gap_h")), "movement": movement(F.col("dist_m"), F.col("gap_h"))})
    return legs.withColumn("geofence_radius", movement_radius(F.col("movement")))
