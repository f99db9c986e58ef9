"""Presence by hour: the matrix from overlaps, its overlays, and the probability at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions.geo import fast_distance
from copresence.functions.rules import MICROS_HOUR, MICROS_MINUTE, base_probability, decay, state_of
from copresence.operators.joins import interval_overlap_join, on_grid, sides_of_legs
from copresence.operators.metrics import day_spine

#: Minutes of the parts of a target's window by which legs meet.
PART_MINUTES = 15

def hour_grid(bounds: DataFrame) -> DataFrame:
    """A row for each date and hour."""
    return day_spine(bounds).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))


def hour_coverage(pings: DataFrame) -> DataFrame:
    """Distinct (date, hour) in which both persons have a ping."""
    slot = lambda p: pings.filter(F.col("person") == p).select(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"))
    return slot(1).intersect(slot(2))


def best_per_hour(overlaps: DataFrame, config: Config) -> DataFrame:
    """(date, hour, prob) of the closest overlap of each hour."""
    best = overlaps.groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.min(F.struct("distance_m", "us", "p1_geofence", "p2_geofence")).alias("b"))
    reach = F.coalesce("b.p1_geofence", F.lit(50.0)) + F.coalesce("b.p2_geofence", F.lit(50.0))
    return best.select("date", "hour", base_probability(F.col("b.distance_m"), reach, config, 0.3).alias("prob"))


def presence_matrix(pings: DataFrame, overlaps: DataFrame, bounds: DataFrame, config: Config) -> DataFrame:
    """(date, hour, prob, state) of every hour: from the overlaps, else apart where both have data, else no data."""
    best = best_per_hour(overlaps, config)
    covered = hour_coverage(pings).withColumn("covered", F.lit(True))
    cells = hour_grid(bounds).join(best, ["date", "hour"], "left").join(covered, ["date", "hour"], "left")
    prob = F.coalesce(F.col("prob"), F.when(F.col("covered"), 0.0))
    return cells.select("date", "hour", prob.alias("prob"), state_of(prob).alias("state"))


def overlay(matrix: DataFrame, ensemble: DataFrame) -> DataFrame:
    """On days that only the model calls together, apart and empty hours become rescued ones."""
    days = ensemble.filter("state = 'ml_together'").select("date", F.lit(True).alias("rescued"))
    s = F.col("state")
    new = F.when(F.col("rescued") & (s == "apart"), "ml_rescued").when(F.col("rescued") & (s == "no_data"), "ml_rescued_nodata").otherwise(s)
    return matrix.join(days, "date", "left").withColumn("state", new).drop("rescued")


def fill_dense_days(matrix: DataFrame) -> DataFrame:
    """On days with at least 6 tracked hours, 70 % of them together, apart hours become together."""
    day = Window.partitionBy("date")
    n = lambda s: F.count_if(F.col("state") == s).over(day)
    together, apart = n("co_located"), n("apart")
    dense = (together + apart >= 6) & (together > 0) & (together >= 0.7 * (together + apart))
    return matrix.withColumn("_dense", dense).withColumn("state", F.when(F.col("_dense") & (F.col("state") == "apart"), "co_located").otherwise(F.col("state"))).drop("_dense")


def with_codes(matrix: DataFrame) -> DataFrame:
    s = F.col("state")
    return matrix.withColumn("code", F.when(s == "co_located", 2).when(s == "ml_rescued", 1).when(s == "apart", -1).otherwise(0))


def probability_at(pings: DataFrame, targets: DataFrame, config: Config, window_hours: int = 2) -> DataFrame:
    """targets(target_us) -> (target_us, prob): from legs of the pings within the window and an hour more, each minute of the window;
    from the nearest pings where one side has no leg; null where a side has no ping. Pings meet targets by hour buckets."""
    c = F.col
    ext, window = (window_hours + 1) * MICROS_HOUR, window_hours * MICROS_HOUR
    bucket = lambda name: F.floor(c(name) / F.lit(ext))
    asked = targets.select("target_us").distinct()
    near = asked.withColumn("_b", F.explode(F.array(bucket("target_us") - 1, bucket("target_us"), bucket("target_us") + 1)))
    seen = pings.select("person", "ping_id", "us", "lat", "lon").withColumn("_p", bucket("us"))
    local = near.join(seen, c("_b") == c("_p")).filter(F.abs(c("us") - c("target_us")) <= ext).drop("_b", "_p")
    # legs within each target's window: consecutive pings of a person there
    order = Window.partitionBy("target_us", "person").orderBy("us", "ping_id")
    legs = _legs_in(local, order, config)
    # legs are cut to the window and dealt to parts of it, so that only those meet that overlap
    cut = {"from_us": F.greatest("start_us", c("target_us") - window), "to_us": F.least("end_us", c("target_us") + window)}
    inside = legs.withColumns(cut).filter((c("from_us") < c("to_us")) & c("geofence_radius").isNotNull())
    one, two = sides_of_legs(inside)
    pairs = interval_overlap_join(one, two, ("a_from_us", "a_to_us"), ("b_from_us", "b_to_us"), PART_MINUTES * MICROS_MINUTE, c("a_target_us") == c("b_target_us"))
    timed = on_grid(pairs.withColumn("target_us", c("a_target_us")), "overlap_start", "overlap_end", MICROS_MINUTE)
    base = base_probability(c("distance_m"), c("a_geofence_radius") + c("b_geofence_radius"), config, None)
    value = F.least(F.lit(1.0), base * decay(F.abs(c("t") - c("target_us")) / float(MICROS_HOUR), float(window_hours)))
    by_legs = timed.groupBy("target_us").agg(F.max(value).alias("by_legs"))
    # which way a target goes
    has = lambda p: F.count_if(c("person") == p)
    counts = local.groupBy("target_us").agg(has(1).alias("n1"), has(2).alias("n2"))
    leg_counts = legs.groupBy("target_us").agg(has(1).alias("l1"), has(2).alias("l2"))
    by_points = _nearest_points(local.filter(F.abs(c("us") - c("target_us")) <= window), config, window_hours)
    joined = asked.join(counts, "target_us", "left").join(leg_counts, "target_us", "left").join(by_legs, "target_us", "left").join(by_points, "target_us", "left")
    no_pings = (F.coalesce("n1", F.lit(0)) == 0) | (F.coalesce("n2", F.lit(0)) == 0)
    no_legs = (F.coalesce("l1", F.lit(0)) == 0) | (F.coalesce("l2", F.lit(0)) == 0)
    return joined.select("target_us", F.when(no_pings, None).when(no_legs, c("by_points")).otherwise(F.coalesce("by_legs", F.lit(0.0))).alias("prob"))


def _legs_in(local: DataFrame, order, config: Config) -> DataFrame:
    from copresence.functions.rules import movement, movement_radius

    c = F.col
    nxt = lambda n: F.lead(n).over(order)
    legs = local.select(
        "target_us", "person", c("us").alias("start_us"), nxt("us").alias("end_us"), c("lat").alias("start_lat"), c("lon").alias("start_lon"),
        nxt("lat").alias("end_lat"), nxt("lon").alias("end_lon"),
    ).filter("end_us IS NOT NULL")
    gap = (c("end_us") - c("start_us")) / F.lit(float(MICROS_HOUR))
    legs = legs.withColumn("gap_h", gap).filter(c("gap_h") <= config.travel_max_gap_hours)
    away = fast_distance(c("start_lat"), c("start_lon"), c("end_lat"), c("end_lon"))
    return legs.withColumn("geofence_radius", movement_radius(movement(away, c("gap_h"))))


def _nearest_points(local: DataFrame, config: Config, window_hours: int) -> DataFrame:
    """Best ladder value of the first ten pings of each side in the window; null where a side has none there."""
    c = F.col
    tenth = F.row_number().over(Window.partitionBy("target_us", "person").orderBy("us", "ping_id"))
    first = local.withColumn("_k", tenth).filter("_k <= 10")
    side = lambda p, x: first.filter(c("person") == p).select("target_us", c("us").alias(f"{x}_us"), c("lat").alias(f"{x}_lat"), c("lon").alias(f"{x}_lon"))
    pairs = side(1, "a").join(side(2, "b"), "target_us")
    d = fast_distance(c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon"))
    base = F.when(d <= 150, 1.0).when(d <= config.neighborhood_m, 0.8).when(d <= config.city_m, 0.5)
    off = F.greatest(F.abs(c("a_us") - c("target_us")), F.abs(c("b_us") - c("target_us"))) / float(MICROS_HOUR)
    value = F.coalesce(F.least(F.lit(1.0), base * decay(off, float(window_hours))), F.lit(0.0))
    return pairs.groupBy("target_us").agg(F.max(value).alias("by_points"))


