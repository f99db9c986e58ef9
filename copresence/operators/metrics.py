"""Day sets, statistics, tracked-day metrics, residence and monthly summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions.geo import rounded
from copresence.functions.rules import is_night, month_of


def days(rows: DataFrame, night_only: bool = False) -> DataFrame:
    """Distinct dates of rows."""
    kept = rows.filter(is_night(F.hour("ts"))) if night_only else rows
    return kept.select(F.to_date("ts").alias("date")).distinct()


def of_person(pings: DataFrame, person: int) -> DataFrame:
    return pings.filter(F.col("person") == person)


def both_tracked(pings: DataFrame, night_only: bool = False) -> DataFrame:
    return days(of_person(pings, 1), night_only).intersect(days(of_person(pings, 2), night_only))


def only_first(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.subtract(two)


def either_not_both(one: DataFrame, two: DataFrame) -> DataFrame:
    """Symmetric difference: dates of which one side is missing in a full outer join."""
    a, b = one.select(F.col("date").alias("a")), two.select(F.col("date").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").filter("a IS NULL OR b IS NULL").select(F.coalesce("a", "b").alias("date"))


def overlap_stats(overlaps: DataFrame) -> DataFrame:
    """One row of counts; zeros and nulls for no overlaps."""
    day, night = F.to_date("ts"), is_night(F.hour("ts"))
    return overlaps.agg(
        F.count("*").alias("total_colocations"), F.count_distinct(day).alias("unique_days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.round(F.avg("distance_m"), 6).alias("avg_distance_m"), F.count_distinct(F.when(night, day)).alias("nights_together"),
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.rint(part * 100.0 / whole * 10) / 10).otherwise(0.0)


def tracked_metrics(pings: DataFrame, trusted_overlaps: DataFrame, config: Config) -> DataFrame:
    """One row: days and nights on which both were tracked, and together. The first meeting cuts these, not the gap counts.

    Flags a date for what is known of it, in one aggregation over dates."""
    c = F.col
    night = is_night(F.hour("ts"))
    seen = pings.filter(c("person").isin(1, 2)).groupBy(F.to_date("ts").alias("date")).agg(
        F.max(c("person") == 1).alias("d1"), F.max(c("person") == 2).alias("d2"),
        F.max((c("person") == 1) & night).alias("n1"), F.max((c("person") == 2) & night).alias("n2"),
    )
    met = trusted_overlaps.groupBy(F.to_date("ts").alias("met")).agg(F.max(night).alias("met_night"))
    known = seen.join(met, c("date") == c("met"), "left")
    counted = (c("date") >= F.lit(config.first_meeting).cast("date")) if config.first_meeting else F.lit(True)
    day, nights = counted & c("d1") & c("d2"), counted & c("n1") & c("n2")
    n = lambda when: F.count_if(when)
    out = known.agg(
        n(day).alias("total_tracked_days"), n(day & c("met").isNotNull()).alias("days_together"),
        n(nights).alias("total_tracked_nights"), n(nights & c("met_night")).alias("nights_at_shared_address"),
        F.min(F.when(day, c("date"))).alias("date_range_start"), F.max(F.when(day, c("date"))).alias("date_range_end"),
        n(c("d1") & ~c("d2")).alias("p1_only_days"), n(c("d2") & ~c("d1")).alias("p2_only_days"), n(c("d1") != c("d2")).alias("total_gap_days"),
    )
    return out.withColumns({
        "pct_days_together": _percent(c("days_together"), c("total_tracked_days")),
        "pct_nights_together": _percent(c("nights_at_shared_address"), c("total_tracked_nights")),
    })


def residence(overlaps: DataFrame) -> DataFrame:
    """The 0.01 degree cell with most night overlaps: nights and dates; no row if there are none."""
    night = overlaps.filter(is_night(F.hour("ts")))
    cells = night.groupBy(rounded(F.col("lat"), 2).alias("lat"), rounded(F.col("lon"), 2).alias("lon")).agg(
        F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("nights"), F.min(F.to_date("ts")).alias("first_date"), F.max(F.to_date("ts")).alias("last_date"),
    )
    return cells.orderBy(F.desc("n"), "lat", "lon").limit(1).drop("n")


def monthly_summary(overlaps: DataFrame) -> DataFrame:
    day = F.to_date("ts")
    return overlaps.groupBy(month_of(F.col("ts")).alias("month")).agg(
        F.count("*").alias("total_colocations"), F.count_distinct(day).alias("unique_days"),
        F.count_distinct(F.when(is_night(F.hour("ts")), day)).alias("nights"),
    )


def day_spine(bounds: DataFrame) -> DataFrame:
    """bounds(start, end): a row -> a row a date."""
    return bounds.filter("start <= end").select(F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("date"))


def bounds_of(config: Config, *frames: DataFrame) -> DataFrame:
    """(start, end): from the start date to the last day of any frame; no end without rows."""
    last = None
    for f in frames:
        one = f.agg(F.max(F.to_date("ts")).alias("end"))
        last = one if last is None else last.unionAll(one)
    return last.agg(F.max("end").alias("end")).select(F.lit(config.start_date).cast("date").alias("start"), "end")


def month_coverage(pings: DataFrame, overlaps: DataFrame, config: Config) -> DataFrame:
    """Months from the start date on: overlaps, days in the month, days both were tracked; zeros where nothing is known."""
    spine = bounds_of(config, pings, overlaps).select(
        F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("INTERVAL 1 MONTH"))).alias("first")
    )
    spine = spine.select(month_of(F.col("first")).alias("month"), F.dayofmonth(F.last_day("first")).alias("days_in_month"))
    tracked = both_tracked(pings).groupBy(month_of(F.col("date")).alias("m")).agg(F.count("*").alias("days_both_tracked"))
    found = monthly_summary(overlaps).withColumnRenamed("month", "k")
    joined = spine.join(found, F.col("month") == F.col("k"), "left").join(tracked, F.col("month") == F.col("m"), "left")
    return joined.select("month", "days_in_month", "total_colocations", "unique_days", "nights", "days_both_tracked").fillna(0)


def daily_counts(overlaps: DataFrame) -> DataFrame:
    return overlaps.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))


def ensemble_counts(ensemble: DataFrame, config: Config) -> DataFrame:
    """Counts of day states from the first meeting on."""
    from_then = (F.col("date") >= F.lit(config.first_meeting).cast("date")) if config.first_meeting else F.lit(True)
    n = lambda when: F.count_if(from_then & when)
    s = F.col("state")
    return ensemble.agg(
        n(s == "together").alias("together"), n(s == "ml_together").alias("ml_together"), n(s == "apart").alias("apart"),
        n(s != "no_data").alias("tracked"), n(s == "no_data").alias("no_data"),
    )
