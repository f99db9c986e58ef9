"""Range and interval joins as equi-joins on time buckets, and the two co-location joins on top of them.

Spark plans inequality joins as nested loops; dealing rows to buckets of time and joining on the bucket keeps them sort-merge or hash
joins, whose work follows the number of rows in reach of each other. Each pair meets in exactly one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions.geo import between_positions, country, fast_distance, geodesic_distance, in_home_region, planar_distance, short_distance
from copresence.functions.rules import MICROS_HOUR, MICROS_MINUTE, fine_tier, from_micros, raw_tier


def bucketed_range_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, reach: int, bound: Column | None = None) -> DataFrame:
    """Pairs whose integers are at most `reach` apart. The left side is copied to its bucket and both neighbours. bound: what else the join looks
    at, such as the bound of event times by which streams expire their state."""
    b = F.floor(F.col(left_at) / F.lit(reach))
    near = left.withColumn("_bucket", F.explode(F.array(b - 1, b, b + 1)))
    there = right.withColumn("_there", F.floor(F.col(right_at) / F.lit(reach)))
    joined = near.join(there, _and(F.col("_bucket") == F.col("_there"), bound))
    return joined.filter(F.abs(F.col(left_at) - F.col(right_at)) <= reach).drop("_bucket", "_there")


def interval_overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int, bound: Column | None = None) -> DataFrame:
    """Pairs of intervals that overlap by more than a point, with `overlap_start` and `overlap_end`. Intervals are copied to each
    bucket they touch; a pair counts in the bucket where its overlap starts."""
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.lit(width)), F.floor(F.col(b) / F.lit(width))))
    one, two = left.withColumn("_bucket", touched(*left_span)), right.withColumn("_there", touched(*right_span))
    joined = one.join(two, _and(F.col("_bucket") == F.col("_there"), bound))
    joined = joined.withColumns({
        "overlap_start": F.greatest(left_span[0], right_span[0]), "overlap_end": F.least(left_span[1], right_span[1]),
    })
    here = F.col("_bucket") == F.floor(F.col("overlap_start") / F.lit(width))
    return joined.filter(here & (F.col("overlap_start") < F.col("overlap_end"))).drop("_bucket", "_there")


def _and(one: Column, two: Column | None) -> Column:
    return one if two is None else one & two


def _side(df: DataFrame, person: int, prefix: str) -> DataFrame:
    mine = df.filter(F.col("person") == person).drop("person")
    return mine.select(*(F.col(c).alias(f"{prefix}{c}") for c in mine.columns))


def raw_overlaps(pings: DataFrame, config: Config, first: int = 1, second: int = 2) -> DataFrame:
    """All pairs of pings of two persons close in time and space. pings need speed_kmh; where they have no geofence_radius, all within the
    city radius count. Where they have them, the source files of both and whether one is made up go along."""
    one, two = raw_sides(pings, first, second)
    return judged_pairs(bucketed_range_join(one, two, "p1_us", "p2_us", config.time_minutes * MICROS_MINUTE), config, "geofence_radius" in pings.columns)


def raw_sides(pings: DataFrame, first: int = 1, second: int = 2, *more: str) -> tuple[DataFrame, DataFrame]:
    """What raw_overlaps reads of the pings of either person, with prefixes p1_ and p2_."""
    with_radius = "geofence_radius" in pings.columns
    radius = F.col("geofence_radius") if with_radius else F.lit(None).cast("double")
    given = lambda name, kind, default: (F.coalesce(name, F.lit(default)) if name in pings.columns else F.lit(default)).cast(kind).alias(name)
    read = pings.select("person", "ping_id", "us", "lat", "lon", radius.alias("geofence_radius"), "speed_kmh", given("source_file", "string", "unknown"), given("interpolated", "boolean", False), *more)
    return tuple(_side(read, p, f"p{i}_") for i, p in ((1, first), (2, second)))


def judged_pairs(pairs: DataFrame, config: Config, with_radius: bool, *more: str) -> DataFrame:
    """Pairs of pings that are close enough in space, with their tier."""
    c = F.col
    places = (c("p1_lat"), c("p1_lon"), c("p2_lat"), c("p2_lon"))
    tier1 = F.lit(config.distance_m)
    reach = F.coalesce("p1_geofence_radius", tier1) + F.coalesce("p2_geofence_radius", tier1) if with_radius else F.lit(config.city_m)
    # pairs that are far apart by the short formula need no series
    pairs = pairs.filter(short_distance(*places) <= reach * 1.05 + 100.0)
    # a generator keeps the series from being copied into each condition that reads its result
    pairs = pairs.withColumn("distance_m", F.explode(F.array(geodesic_distance(*places)))).filter(c("distance_m") <= reach)
    label = country(c("p1_lat"), c("p1_lon"), config)
    at_home = F.lit(False)
    for name in config.home_countries:
        at_home = at_home | label.contains(name)
    s1, s2 = c("p1_speed_kmh"), c("p2_speed_kmh")
    drive_by = ((s1 > 20) | (s2 > 20)) & ((s1 < 2) | (s2 < 2))
    dropped = (c("distance_m") > tier1) & at_home & (drive_by | (c("distance_m") > config.neighborhood_m) | ~((s1 < 7) & (s2 < 7)))
    return pairs.filter(~dropped).select(
        c("p1_us").alias("us"), from_micros(c("p1_us")).alias("ts"), ((c("p1_lat") + c("p2_lat")) / 2).alias("lat"),
        ((c("p1_lon") + c("p2_lon")) / 2).alias("lon"), "distance_m", raw_tier(c("distance_m"), config).alias("tier"),
        "p1_ping_id", "p2_ping_id", "p1_lat", "p1_lon", "p2_lat", "p2_lon", "p1_source_file", "p2_source_file",
        (c("p1_interpolated") | c("p2_interpolated")).alias("interpolated"), *more,
    )


def sides_of_legs(legs: DataFrame, first: int = 1, second: int = 2) -> tuple[DataFrame, DataFrame]:
    return _side(legs, first, "a_"), _side(legs, second, "b_")


def segment_pairs(legs: DataFrame, first: int = 1, second: int = 2) -> DataFrame:
    """Pairs of legs of two persons that overlap in time."""
    one, two = sides_of_legs(legs, first, second)
    return interval_overlap_join(one, two, ("a_start_us", "a_end_us"), ("b_start_us", "b_end_us"), MICROS_HOUR)


def position_at(prefix: str, t: Column) -> tuple[Column, Column]:
    """Position on a leg at time t; a leg of no time stays at its start."""
    c = lambda name: F.col(prefix + name)
    span = c("end_us") - c("start_us")
    share = F.when(span > 0, (t - c("start_us")) / span).otherwise(0.0)
    return between_positions(c("start_lat"), c("end_lat"), share), between_positions(c("start_lon"), c("end_lon"), share)


def on_grid(pairs: DataFrame, start: str, end: str, step_us: int) -> DataFrame:
    """A row for each step of time from start to end, both included, with the positions and the distance of both sides."""
    c = F.col
    timed = pairs.withColumn("cos_lat", F.cos(F.radians((c("a_start_lat") + c("b_start_lat")) * 0.5)))
    timed = timed.withColumn("t", F.explode(F.sequence(c(start), c(end), F.lit(step_us))))
    (lat1, lon1), (lat2, lon2) = position_at("a_", c("t")), position_at("b_", c("t"))
    # generators keep positions and the distance from being made again in each condition and column that reads them
    there = F.struct(lat1.alias("lat1"), lon1.alias("lon1"), lat2.alias("lat2"), lon2.alias("lon2"))
    timed = timed.select(*timed.columns, F.inline(F.array(there)))
    return timed.withColumn("distance_m", F.explode(F.array(planar_distance(c("lat1"), c("lon1"), c("lat2"), c("lon2"), c("cos_lat")))))


def fine_matches(legs: DataFrame, config: Config, step_us: int = MICROS_MINUTE) -> DataFrame:
    """Minutes at which two persons are together, before the choice of the closest in each bucket."""
    return matches_of(segment_pairs(legs), config, step_us)


def matches_of(pairs: DataFrame, config: Config, step_us: int = MICROS_MINUTE) -> DataFrame:
    """Minutes of pairs of legs at which two persons are together."""
    c = F.col
    pairs = pairs.filter(c("a_geofence_radius").isNotNull() & c("b_geofence_radius").isNotNull())
    middle = ((c("a_start_lat") + c("b_start_lat")) * 0.5, (c("a_start_lon") + c("b_start_lon")) * 0.5)
    driving = (c("a_movement") == "driving") | (c("b_movement") == "driving")
    context = F.when(driving & ~in_home_region(*middle, config), 2000.0).otherwise(F.lit(config.neighborhood_m))
    pairs = pairs.withColumns({"context_m": context, "reach_m": c("a_geofence_radius") + c("b_geofence_radius")})
    starts = fast_distance(c("a_start_lat"), c("a_start_lon"), c("b_start_lat"), c("b_start_lon"))
    ends = fast_distance(c("a_end_lat"), c("a_end_lon"), c("b_end_lat"), c("b_end_lon"))
    pairs = pairs.filter(F.least(starts, ends) <= F.greatest("context_m", "reach_m") + c("a_dist_m") + c("b_dist_m"))
    timed = on_grid(pairs, "overlap_start", "overlap_end", step_us)
    timed = timed.filter((c("distance_m") <= c("reach_m")) | (c("distance_m") <= c("context_m")))
    at = ((c("lat1") + c("lat2")) * 0.5, (c("lon1") + c("lon2")) * 0.5)
    still = (c("a_movement") == "stationary") | (c("b_movement") == "stationary")
    slow = c("a_movement").isin("stationary", "walking") & c("b_movement").isin("stationary", "walking")
    dropped = (c("distance_m") > 150.0) & in_home_region(*at, config) & ((driving & still) | (c("distance_m") > config.neighborhood_m) | ~slow)
    return timed.filter(~dropped).select(
        c("t").alias("us"), at[0].alias("lat"), at[1].alias("lon"), "distance_m", fine_tier(c("distance_m"), config).alias("tier"),
        "lat1", "lon1", "lat2", "lon2", c("a_geofence_radius").alias("p1_geofence"), c("b_geofence_radius").alias("p2_geofence"),
        c("a_movement").alias("p1_movement"), c("b_movement").alias("p2_movement"), (c("distance_m") <= c("reach_m")).alias("geofence_match"),
        "a_start_us", "a_seg_id", "b_start_us", "b_seg_id",
    )


def closest_per_bucket(matches: DataFrame, minutes: int = 15) -> DataFrame:
    """The closest match of each bucket of time, the first leg pair and step of equals. Minima combine before the shuffle."""
    bucket = F.floor(F.col("us") / F.lit(minutes * MICROS_MINUTE))
    order = ["distance_m", "a_start_us", "a_seg_id", "b_start_us", "b_seg_id", "us"]
    rest = [c for c in matches.columns if c not in order]
    best = matches.groupBy(bucket.alias("bucket")).agg(F.min(F.struct(*order, *rest)).alias("best")).select("bucket", "best.*")
    return best.withColumn("ts", from_micros(F.col("us")))


def fine_overlaps(legs: DataFrame, config: Config) -> DataFrame:
    return closest_per_bucket(fine_matches(legs, config))


def trusted(overlaps: DataFrame, config: Config) -> DataFrame:
    """Overlaps that count as together: confirmed ones, and any outside the home region."""
    return overlaps.filter((F.col("tier") == "confirmed") | ~in_home_region(F.col("lat"), F.col("lon"), config))
