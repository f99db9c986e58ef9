"""One row of features a day, for the day classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copresence.functions.geo import fast_distance
from copresence.functions.rules import is_evening, is_morning, is_night

FAR = 999_999.0
NEAR_BOX = (49.5, 53.5, 2.5, 7.2)


def _hours(h: Column) -> Column:
    """How many different hours of the day a group has, by their bits: a distinct count would send each hour's rows and medians through a shuffle
    of their own."""
    return F.coalesce(F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), h))), F.lit(0)).cast("long")


def _ping_features(pings: DataFrame, person: int) -> DataFrame:
    x, h = f"p{person}_", F.hour("ts")
    corner = fast_distance(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon"))
    return pings.filter(F.col("person") == person).groupBy(F.to_date("ts").alias("date")).agg(
        F.count("*").alias(x + "points"), _hours(h).alias(x + "hours_covered"), F.min(h).alias(x + "first_hour"), F.max(h).alias(x + "last_hour"),
        F.median("lat").alias(x + "lat"), F.median("lon").alias(x + "lon"), F.when(F.count("*") >= 2, corner).otherwise(0.0).alias(x + "spread_m"),
    )


def _overlap_features(overlaps: DataFrame) -> DataFrame:
    h, d, c = F.hour("ts"), F.col("distance_m"), F.col
    n = lambda when, name: F.count_if(when).alias(name)
    return overlaps.groupBy(F.to_date("ts").alias("date")).agg(
        F.count("*").alias("n_overlaps"), F.min(d).alias("min_distance_m"), F.avg(d).alias("mean_distance_m"), F.median(d).alias("median_distance_m"),
        F.max(d).alias("max_distance_m"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std_distance_m"),
        n(c("tier") == "confirmed", "n_confirmed"), n(c("tier") == "neighborhood", "n_neighborhood"), n(c("tier") == "city", "n_city"),
        _hours(h).alias("overlap_hours_span"), F.min(h).alias("overlap_first_hour"), F.max(h).alias("overlap_last_hour"),
        n(is_night(h), "n_night_overlaps"), n(is_morning(h), "n_morning_overlaps"), n(is_evening(h), "n_evening_overlaps"),
        n(c("p1_movement") == "stationary", "n_stationary_overlaps"), n(c("p1_movement") == "walking", "n_walking_overlaps"),
        n(c("p1_movement") == "driving", "n_driving_overlaps"),
    )


def _flag(when: Column) -> Column:
    return F.when(when, 1.0).otherwise(0.0)


def day_features(pings: DataFrame, overlaps: DataFrame, photos: DataFrame | None = None) -> DataFrame:
    """A row for each date with a ping, from one aggregation of each input joined on the date."""
    c = F.col
    one, two, met = _ping_features(pings, 1), _ping_features(pings, 2), _overlap_features(overlaps)
    rows = one.join(two, "date", "full_outer").join(met, "date", "left")
    both = c("p1_points").isNotNull() & c("p2_points").isNotNull()
    centre = fast_distance(c("p1_lat"), c("p1_lon"), c("p2_lat"), c("p2_lon"))
    inside = lambda p: c(f"p{p}_lat").between(*NEAR_BOX[:2]) & c(f"p{p}_lon").between(*NEAR_BOX[2:])
    near = both & inside(1) & inside(2)
    rows = rows.withColumns({
        "both_have_data": _flag(both), "centroid_distance_m": F.when(both, centre).otherwise(FAR),
        "both_in_nl_be": _flag(near), "both_abroad": _flag(both & ~near & (centre < 50_000)),
    })
    share = lambda name: F.when(c("n_overlaps") > 0, c(name) / c("n_overlaps")).otherwise(0.0)
    far = ["min_distance_m", "mean_distance_m", "median_distance_m", "max_distance_m"]
    hours = ["p1_first_hour", "p1_last_hour", "p2_first_hour", "p2_last_hour"]
    position = {n: F.when(both, c(n)).otherwise(0.0) for n in ("p1_lat", "p1_lon", "p2_lat", "p2_lon")}
    rows = rows.withColumns({"pct_confirmed": share("n_confirmed"), "pct_stationary": share("n_stationary_overlaps")} | position)
    rows = rows.fillna(FAR, far).fillna(-1, hours).fillna(0)
    rows = rows.withColumns({
        "overlap_duration_hours": c("overlap_last_hour") - c("overlap_first_hour"), "has_night_overlap": _flag(c("n_night_overlaps") > 0),
        "day_of_week": F.weekday("date"), "is_weekend": _flag(F.weekday("date") >= 5),
    })
    if photos is not None:
        taken = photos.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").cast("double").alias("n_couple_photos"))
        rows = rows.join(taken, "date", "left").fillna(0.0, ["n_couple_photos"]).withColumn("has_couple_photos", _flag(c("n_couple_photos") > 0))
    return rows


def feature_names(rows: DataFrame) -> list[str]:
    return sorted(n for n in rows.columns if n != "date")
