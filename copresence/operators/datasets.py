"""What the charts show, as data: calendars, monthly panels, map cells, density and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions.geo import rounded
from copresence.functions.rules import is_night
from copresence.operators.metrics import bounds_of, daily_counts, day_spine, days
from copresence.operators.sequence import runs_of_days


def week_of(date: Column, start: Column) -> Column:
    """Index of a Monday-first calendar week, counted from the week of `start`."""
    return F.floor((F.datediff(date, start) + F.weekday(start)) / F.lit(7)).cast("int")


def _tracked(pings: DataFrame) -> DataFrame:
    """(date, d1, d2): which persons have pings."""
    p = F.col("person")
    return pings.groupBy(F.to_date("ts").alias("date")).agg(F.max(p == 1).alias("d1"), F.max(p == 2).alias("d2"))


def calendar(pings: DataFrame, overlaps: DataFrame, config: Config) -> DataFrame:
    """(date, week, dow, n, missing): overlaps a day, and whether a person has no ping then."""
    spine = day_spine(bounds_of(config, pings, overlaps))
    start = F.lit(config.start_date).cast("date")
    joined = spine.join(daily_counts(overlaps), "date", "left").join(_tracked(pings), "date", "left")
    both = F.coalesce(F.col("d1") & F.col("d2"), F.lit(False))
    return joined.select("date", week_of(F.col("date"), start).alias("week"), F.weekday("date").alias("dow"), F.coalesce("n", F.lit(0)).alias("n"), (~both).alias("missing"))


def map_cells(overlaps: DataFrame, digits: int = 3) -> DataFrame:
    """Overlaps by rounded cell with the marker each gets; `nights` counts rows."""
    night = is_night(F.hour("ts"))
    cells = overlaps.groupBy(rounded(F.col("lat"), digits).alias("lat"), rounded(F.col("lon"), digits).alias("lon")).agg(
        F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("unique_days"), F.min(F.to_date("ts")).alias("first_day"),
        F.max(F.to_date("ts")).alias("last_day"), F.count_if(night).alias("nights"),
    )
    bed, often, some = F.col("nights") > 10, F.col("unique_days") > 30, F.col("unique_days") > 10
    return cells.withColumns({
        "color": F.when(bed, "darkgreen").when(often, "green").when(some, "orange").otherwise("blue"),
        "icon": F.when(bed, "bed").when(often, "home").otherwise("map-marker"),
    })


def map_pyramid(overlaps: DataFrame, zooms: tuple[int, ...] = tuple(range(0, 18))) -> DataFrame:
    """(zoom, x, y, n, unique_days, nights, lat, lon): all overlaps in the cells of each zoom level, with their mean position. A level has 2 ** zoom cells
    from north to south and twice as many around. Dates are counted from one aggregation of the finest cells by date, which combines
    before its shuffle; coarser cells add up what finer ones hold."""
    deep = max(zooms)
    at = lambda column, cells, span: F.floor(column * F.lit(float(cells)) / F.lit(span))
    x, y = at(F.col("lon") + 180.0, 1 << (deep + 1), 360.0), at(F.lit(90.0) - F.col("lat"), 1 << deep, 180.0)
    finest = overlaps.groupBy(x.alias("_x"), y.alias("_y"), F.to_date("ts").alias("date")).agg(
        F.count("*").alias("n"), F.count_if(is_night(F.hour("ts"))).alias("nights"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon")
    )
    up = lambda c: F.expr(f"shiftright({c}, {deep} - zoom)")
    dealt = finest.withColumn("zoom", F.explode(F.array(*map(F.lit, sorted(zooms))))).withColumns({"x": up("_x"), "y": up("_y")})
    daily = dealt.groupBy("zoom", "x", "y", "date").agg(*(F.sum(c).alias(c) for c in ("n", "nights", "lat", "lon")))
    cells = daily.groupBy("zoom", "x", "y").agg(F.sum("n").alias("n"), F.count("*").alias("unique_days"), F.sum("nights").alias("nights"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"))
    return cells.withColumns({"lat": F.col("lat") / F.col("n"), "lon": F.col("lon") / F.col("n")})


def density(pings: DataFrame, overlaps: DataFrame, config: Config) -> DataFrame:
    """Pings, made-up pings and overlaps of every day."""
    p, made_up = F.col("person"), F.coalesce("interpolated", F.lit(False))
    daily = pings.groupBy(F.to_date("ts").alias("date")).agg(
        F.count_if(p == 1).alias("p1_reports"), F.count_if(p == 2).alias("p2_reports"),
        F.count_if((p == 1) & made_up).alias("p1_interpolated"), F.count_if((p == 2) & made_up).alias("p2_interpolated"),
    )
    spine = day_spine(bounds_of(config, pings))
    joined = spine.join(daily, "date", "left").join(daily_counts(overlaps).withColumnRenamed("n", "overlaps"), "date", "left")
    return joined.fillna(0)


def gap_islands(daily: DataFrame, column: str, least_days: int = 4) -> DataFrame:
    """(first_day, last_day) of runs of dates on which `column` is zero, of `least_days` dates or more."""
    runs = runs_of_days(daily.filter(F.col(column) == 0).select("date"))
    return runs.filter(F.datediff("last_day", "first_day") + 1 >= least_days)


def report_gaps(reports: DataFrame, bounds: DataFrame, key: str = "person", least_days: int = 4) -> DataFrame:
    """reports(key, ts) -> (key, first_day, last_day) of the runs of `least_days` dates or more without a report of the key, from the first to the last
    date of bounds(start, end)."""
    seen = reports.select(key, F.to_date("ts").alias("date")).distinct()
    all_days = bounds.filter("start <= end").select(F.sequence("start", "end", F.expr("INTERVAL 1 DAY")).alias("all"))
    # each key's empty dates: those of the calendar, an array of one row, less its own
    own = seen.groupBy(key).agg(F.collect_set("date").alias("own"))
    empty = own.join(F.broadcast(all_days)).select(key, F.explode(F.array_except("all", "own")).alias("date"))
    return runs_of_days(empty, key).filter(F.datediff("last_day", "first_day") + 1 >= least_days)


def day_states(pings: DataFrame, trusted_overlaps: DataFrame, ensemble: DataFrame | None, config: Config) -> DataFrame:
    """(date, week, dow, code): 2 together, 1 by the model, -1 apart, 0 no data; the ensemble's state where it has one."""
    spine = day_spine(bounds_of(config, pings, trusted_overlaps))
    met = days(trusted_overlaps).withColumn("met", F.lit(True))
    joined = spine.join(_tracked(pings), "date", "left").join(met, "date", "left")
    both = F.coalesce(F.col("d1") & F.col("d2"), F.lit(False))
    rule = F.when(both & F.coalesce("met", F.lit(False)), "together").when(both, "apart").otherwise("no_data")
    if ensemble is None:
        state = rule
    else:
        joined = joined.join(ensemble.select("date", F.col("state").alias("model")), "date", "left")
        state = F.coalesce(F.col("model"), rule)
    start = F.lit(config.start_date).cast("date")
    code = F.when(F.col("state") == "together", 2).when(F.col("state") == "ml_together", 1).when(F.col("state") == "apart", -1).otherwise(0)
    return joined.withColumn("state", state).select("date", week_of(F.col("date"), start).alias("week"), F.weekday("date").alias("dow"), code.alias("code"))


