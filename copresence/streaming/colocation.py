"""Co-location as a stream: pairs of pings in reach, pairs of legs, the closest of each bucket of time, and spells of reports.

Both sides of a join have watermarks and meet by buckets of time, and the join is bounded in event time, so the state of either side expires.
Pairs are given out at once, windows and sessions when the watermark has passed their end. Late rows are dropped by the watermark. In-order
input gives the rows of the batch operators: the conditions behind the joins are the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions.rules import MICROS_HOUR, MICROS_MINUTE
from copresence.operators.joins import bucketed_range_join, interval_overlap_join, judged_pairs, matches_of, raw_sides, sides_of_legs

CLOSEST = ("distance_m", "a_start_us", "a_seg_id", "b_start_us", "b_seg_id", "us")


def raw_overlaps_stream(pings: DataFrame, config: Config, lateness: str = "1 hour", first: int = 1, second: int = 2) -> DataFrame:
    """Streaming pings(person, ping_id, ts timestamp, lat, lon, speed_kmh and, if there are radii, geofence_radius) -> the rows of
    joins.raw_overlaps. A ping stays in state while a ping of the other person can come that is close in time."""
    read = pings.withColumns({"us": F.unix_micros("ts"), "at": F.col("ts")})
    one, two = raw_sides(read, first, second, "at")
    one, two = one.withWatermark("p1_at", lateness), two.withWatermark("p2_at", lateness)
    reach = F.expr(f"INTERVAL {int(config.time_minutes)} MINUTES")
    bound = F.col("p1_at").between(F.col("p2_at") - reach, F.col("p2_at") + reach)
    pairs = bucketed_range_join(one, two, "p1_us", "p2_us", config.time_minutes * MICROS_MINUTE, bound)
    return judged_pairs(pairs, config, "geofence_radius" in pings.columns)


def fine_matches_stream(legs: DataFrame, config: Config, lateness: str = "1 hour", first: int = 1, second: int = 2, step_us: int = MICROS_MINUTE) -> DataFrame:
    """Streaming legs (of legs_stream, through a table) -> the rows of joins.fine_matches. A leg counts at its end, when it is known; it stays in
    state for the longest leg, since legs that overlap end at most so far apart."""
    read = legs.withColumn("at", F.timestamp_micros("end_us"))
    one, two = (side.withWatermark(f"{p}_at", lateness) for side, p in zip(sides_of_legs(read, first, second), "ab", strict=True))
    longest = F.expr(f"INTERVAL {int(config.travel_max_gap_hours * 3600)} SECONDS")
    bound = F.col("a_at").between(F.col("b_at") - longest, F.col("b_at") + longest)
    pairs = interval_overlap_join(one, two, ("a_start_us", "a_end_us"), ("b_start_us", "b_end_us"), MICROS_HOUR, bound)
    return matches_of(pairs, config, step_us)


def closest_stream(matches: DataFrame, minutes: int = 15, lateness: str = "19 hours") -> DataFrame:
    """Streaming matches (of fine_matches_stream, through a table) -> the rows of joins.closest_per_bucket. A match may come as late as the longest leg
    that it lies on."""
    rest = [c for c in matches.columns if c not in CLOSEST]
    at = matches.withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness)
    best = at.groupBy(F.window("at", f"{minutes} minutes").alias("w")).agg(F.min(F.struct(*CLOSEST, *rest)).alias("best"))
    bucket = F.floor(F.unix_micros("w.start") / F.lit(minutes * MICROS_MINUTE)).alias("bucket")
    return best.select(bucket, "best.*").withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))


def best_per_hour_stream(overlaps: DataFrame, lateness: str = "19 hours") -> DataFrame:
    """Streaming overlaps(us, distance_m, p1_geofence, p2_geofence) -> (date, hour, distance_m, reach_m) of the closest of each hour, of which
    matrix.best_per_hour has the probability."""
    at = overlaps.withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness)
    best = at.groupBy(F.window("at", "1 hour").alias("w")).agg(F.min(F.struct("distance_m", "us", "p1_geofence", "p2_geofence")).alias("b"))
    reach = F.coalesce("b.p1_geofence", F.lit(50.0)) + F.coalesce("b.p2_geofence", F.lit(50.0))
    return best.select(F.to_date("w.start").alias("date"), F.hour("w.start").alias("hour"), "b.distance_m", reach.alias("reach_m"))


def spells_stream(pings: DataFrame, least_days: int = 4, lateness: str = "2 days") -> DataFrame:
    """Streaming pings(person, ts timestamp) -> (person, first_day, last_day) of spells of reports, which are least_days dates or more without any
    apart. A spell is given out once so many dates have passed behind it, so each row also tells that a gap has begun. Dates start at
    midnight, so the lateness is a day more than that of pings."""
    day = pings.select("person", F.date_trunc("DAY", "ts").alias("day")).withWatermark("day", lateness)
    # dates that so many empty ones lie between are a day more apart, where a session has ended
    spells = day.groupBy("person", F.session_window("day", f"{least_days} days 12 hours").alias("s")).agg(F.max("day").alias("b"))
    return spells.select("person", F.to_date("s.start").alias("first_day"), F.to_date("b").alias("last_day"))


def gaps_between(spells: DataFrame, least_days: int = 4) -> DataFrame:
    """Spells (a table) -> (person, first_day, last_day) of the runs of dates between them, of least_days dates or more: the rows of
    datasets.gap_islands between a person's first and last report. There is a row a spell, and spells are days apart."""
    after = F.lead("first_day").over(Window.partitionBy("person").orderBy("first_day"))
    gaps = spells.withColumn("next", after).filter("next IS NOT NULL").select("person", F.date_add("last_day", 1).alias("first_day"), F.date_sub("next", 1).alias("last_day"))
    return gaps.filter(F.datediff("last_day", "first_day") + 1 >= least_days)
