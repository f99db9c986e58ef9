"""Movement classes, radii, tiers, probabilities and parts of days as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copresence.config import Config

MICROS_HOUR, MICROS_MINUTE, MICROS_DAY = 3_600_000_000, 60_000_000, 86_400_000_000
#: Geofence radius in metres of each movement class; flying has none.
GEOFENCE = {"stationary": 50.0, "walking": 100.0, "driving": 500.0, "jitter": 50.0}
#: Geofence radius in metres of each reported accuracy.
ACCURACY_RADIUS = {10: 75.0, 15: 100.0, 20: 150.0, 30: 200.0}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-naive time."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def from_micros(us: Column) -> Column:
    """Zone-naive time of microseconds since 1970."""
    days = F.floor(us / F.lit(MICROS_DAY))
    rest = us - days * MICROS_DAY
    seconds = (rest.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), seconds)


def speed_kmh(distance_m: Column, gap_h: Column) -> Column:
    return F.when(gap_h > 0, distance_m / 1000.0 / gap_h).otherwise(0.0)


def movement(distance_m: Column, gap_h: Column) -> Column:
    """Class of a leg by its speed; a leg of no time is stationary, a leap in under half an hour is jitter."""
    v = speed_kmh(distance_m, gap_h)
    return (
        F.when(gap_h <= 0, "stationary").when((v > 1000) & (gap_h < 0.5), "jitter").when(v <= 0.5, "stationary")
        .when(v <= 7, "walking").when(v <= 150, "driving").otherwise("flying")
    )


def _lookup(key: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def movement_radius(kind: Column) -> Column:
    return _lookup(kind, GEOFENCE)


def accuracy_radius(accuracy: Column) -> Column:
    return F.coalesce(_lookup(accuracy, ACCURACY_RADIUS), F.lit(150.0))


def raw_tier(distance: Column, config: Config) -> Column:
    return F.when(distance <= config.distance_m, "confirmed").when(distance <= config.neighborhood_m, "neighborhood").otherwise("city")


def fine_tier(distance: Column, config: Config) -> Column:
    return (
        F.when(distance <= 150.0, "confirmed").when(distance <= config.neighborhood_m, "neighborhood")
        .when(distance <= config.city_m, "city").otherwise("geofence")
    )


def base_probability(distance: Column, reach: Column, config: Config, beyond: float | None) -> Column:
    """Ladder from distance to probability; `beyond` is the value past the city radius (None: null)."""
    return (
        F.when(distance <= reach, 1.0).when(distance <= 150.0, 0.95).when(distance <= config.neighborhood_m, 0.8)
        .when(distance <= config.city_m, 0.5).otherwise(F.lit(beyond).cast("double"))
    )


def decay(offset_h: Column, window_h: float) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - offset_h / window_h)


def state_of(probability: Column) -> Column:
    return F.when(probability.isNull(), "no_data").when(probability >= 0.4, "co_located").otherwise("apart")


def is_night(hour: Column) -> Column:
    return (hour >= 22) | (hour <= 6)


def is_morning(hour: Column) -> Column:
    return hour.between(6, 10)


def is_evening(hour: Column) -> Column:
    return (hour >= 18) & (hour < 22)


def label_to_binary(label: Column) -> Column:
    return F.when(label == "apart", 0).otherwise(1)


def month_of(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM")


def title_of(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def is_phone_camera(make: Column, brand: str = "apple") -> Column:
    return F.coalesce(F.lower(make).contains(brand.lower()), F.lit(False))
