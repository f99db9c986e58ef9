"""Pings of the driver's event table, which has no coordinates of its own: a deterministic derivation in SQL. Every event is a ping; most of
those between 23:00 and 06:00 are moved to the hour before or after, so that nights have gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copresence.functions.rules import micros

#: Runs unchanged in Spark and DuckDB on a table `events`.
PINGS_SQL = """
SELECT event_id AS ping_id, person, ts, accuracy, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM (
SELECT event_id, person, ts, accuracy,
  alat + ((event_id % 11) - 5) * 0.0001 + CASE WHEN event_id % 97 = 0 THEN 3.0 ELSE 0.0 END AS lat,
  alon + ((event_id % 7) - 3) * 0.0001 AS lon
FROM (
 SELECT event_id, CAST(user_id % 2 AS INT) + 1 AS person,
  CASE WHEN event_id % 40 = 0 THEN ts WHEN h >= 23 THEN ts - INTERVAL '1' HOUR WHEN h < 6 THEN ts + INTERVAL '1' HOUR * (6 - h) ELSE ts END AS ts,
  CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 15 WHEN 'error' THEN 30 ELSE 20 END AS accuracy,
  CASE WHEN d BETWEEN 21 AND 26 THEN 40.42 + h * 0.02
       WHEN h >= 20 OR h <= 8 THEN CASE WHEN p = 1 AND d % 3 = 0 THEN 50.93 WHEN p = 1 AND d % 3 = 1 THEN 50.854 ELSE 50.85 END
       WHEN p = 0 THEN 50.88 ELSE 50.852 END AS alat,
  CASE WHEN d BETWEEN 21 AND 26 THEN -3.70 + CASE WHEN p = 1 THEN 0.01 ELSE 0.0 END
       WHEN h >= 20 OR h <= 8 THEN CASE WHEN p = 1 AND d % 3 = 0 THEN 5.34 ELSE 5.70 END
       WHEN p = 0 THEN 5.98 ELSE 5.69 END AS alon
 FROM (SELECT event_id, user_id, event_type, ts, user_id % 2 AS p, hour(ts) AS h, day(ts) AS d FROM {events}) a
) b
) z
"""


def event_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ping_id, person, ts, us, accuracy, lat, lon) from the event table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pings = spark.sql(PINGS_SQL.format(events="{events}"), events=events)
    # a generator keeps times and places from being made again in each condition on them, which took most of the time of deduplication
    made = F.inline(F.array(F.struct("ts", "accuracy", "lat", "lon")))
    return pings.select("ping_id", "person", made).withColumn("us", micros(F.col("ts")))
