"""Home cells, presence in gaps and overnight stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions.geo import between_positions, fast_distance, rounded
from copresence.functions.rules import MICROS_DAY, MICROS_HOUR, MICROS_MINUTE, from_micros
from copresence.operators.clean import segments
from copresence.operators.sequence import with_neighbours

#: Ids of made-up pings start here, so that they come behind real ones of the same time.
SYNTHETIC_ID = 1 << 60


def home_cells(pings: DataFrame, config: Config, digits: int = 2, least: int = 1) -> DataFrame:
    """(person, home_lat, home_lon): the cell with most night pings, the smallest of equals; persons with fewer night pings than
    `least` have none."""
    h = F.hour("ts")
    night = pings.filter((h >= config.night_from) | (h <= config.night_to))
    cells = night.groupBy("person", rounded(F.col("lat"), digits).alias("la"), rounded(F.col("lon"), digits).alias("lo")).agg(F.count("*").alias("n"))
    best = cells.groupBy("person").agg(F.min(F.struct((-F.col("n")).alias("k"), "la", "lo")).alias("b"), F.sum("n").alias("total"))
    return best.filter(F.col("total") >= least).select("person", F.col("b.la").alias("home_lat"), F.col("b.lo").alias("home_lon"))


def overnight_fill(pings: DataFrame, homes: DataFrame, config: Config) -> DataFrame:
    """Hourly pings at home between an evening and a morning ping near it. homes has a row a person."""
    return stays_between(with_neighbours(pings.select("person", "ping_id", "us", "lat", "lon"), ["lat", "lon"], following="n"), homes, config)


def stays_between(near_: DataFrame, homes: DataFrame, config: Config) -> DataFrame:
    """near_(person, us, lat, lon, n): pings and what follows each -> stays."""
    c = F.col
    day, hour = (lambda us: F.floor(c(us) / F.lit(MICROS_DAY))), (lambda us: F.floor(F.pmod(c(us), F.lit(MICROS_DAY)) / F.lit(MICROS_HOUR)))
    night = (hour("us") >= 19) & (hour("n.us") <= 10) & (day("n.us") > day("us")) & (c("n.us") - c("us") <= 16 * MICROS_HOUR)
    near = lambda lat, lon: fast_distance(c(lat), c(lon), c("home_lat"), c("home_lon")) <= config.home_tolerance_m
    stays = near_.filter(night).join(homes, "person").filter(near("lat", "lon") & near("n.lat", "n.lon"))
    first = (F.floor(c("us") / F.lit(MICROS_HOUR)) + 1) * MICROS_HOUR
    last = F.floor(c("n.us") / F.lit(MICROS_HOUR)) * MICROS_HOUR - MICROS_HOUR
    hours = stays.withColumns({"_a": first, "_b": last}).filter("_b >= _a").withColumn("t", F.explode(F.sequence("_a", "_b", F.lit(MICROS_HOUR))))
    return _made_up(hours, "t", c("home_lat"), c("home_lon"), F.lit("overnight"), F.lit(50.0), F.lit(None).cast("double"), F.lit(50))


def interpolated(pings: DataFrame, config: Config) -> DataFrame:
    """Pings on legs of half an hour or more: every 30, 15 or 60 minutes for stationary, walking and driving ones. The last whole step
    of a leg is left out."""
    return made_up_between(segments(pings, config.travel_max_gap_hours))


def made_up_between(legs: DataFrame) -> DataFrame:
    """Pings on legs."""
    c = F.col
    legs = legs.filter((c("gap_h") >= 0.5) & c("movement").isin("stationary", "walking", "driving"))
    step = F.when(c("movement") == "stationary", 30).when(c("movement") == "walking", 15).otherwise(60)
    legs = legs.withColumn("step_us", step.cast("long") * F.lit(MICROS_MINUTE))
    legs = legs.withColumn("n", F.floor((c("end_us") - c("start_us")) / c("step_us")))
    grid = legs.filter("n > 1").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), c("n") - 1)))
    grid = grid.withColumn("t", c("start_us") + c("k") * c("step_us")).filter("t < end_us")
    share = (c("t") - c("start_us")) / (c("end_us") - c("start_us"))
    lat, lon = between_positions(c("start_lat"), c("end_lat"), share), between_positions(c("start_lon"), c("end_lon"), share)
    accuracy = F.when(c("movement") == "stationary", 50).otherwise(100)
    return _made_up(grid, "t", lat, lon, c("movement"), c("geofence_radius"), c("speed_kmh"), accuracy)


def _made_up(rows, t, lat, lon, kind, radius, speed, accuracy) -> DataFrame:
    c = F.col
    return rows.select(
        (F.lit(SYNTHETIC_ID) + F.floor(c(t) / F.lit(1_000_000))).alias("ping_id"), "person", from_micros(c(t)).alias("ts"), c(t).alias("us"),
        accuracy.cast("int").alias("accuracy"), lat.alias("lat"), lon.alias("lon"), radius.cast("double").alias("geofence_radius"),
        F.lit(True).alias("interpolated"), kind.alias("interp_type"), speed.alias("interp_speed_kmh"),
    )


def marked_raw(pings: DataFrame) -> DataFrame:
    """Real pings with the columns of made-up ones."""
    return pings.withColumns({"interpolated": F.lit(False), "interp_type": F.lit(None).cast("string"), "interp_speed_kmh": F.lit(None).cast("double")})


def with_overnight(pings: DataFrame, homes: DataFrame, config: Config) -> DataFrame:
    """pings and overnight stays; of rows of a person with equal time and place the real one stays."""
    both = marked_raw(pings).unionByName(overnight_fill(pings, homes, config), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("person", "us", "lat", "lon", "ping_id")]
    first = both.groupBy("person", "us", "lat", "lon").agg(F.min(F.struct("ping_id", *rest)).alias("b"))
    return first.select("person", "us", "lat", "lon", "b.*").select(*both.columns)
