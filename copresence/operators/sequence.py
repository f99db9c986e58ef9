"""Neighbours in a sequence by two levels of windows, and runs of dates by levels of the calendar.

A window over all rows of a person is one task, however long the observation. Here windows span a person's day; what crosses midnight comes
from a table of the first and last row of each day, which has a row a person and day. Tasks grow with days, and the second window
sees some hundred rows a year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copresence.functions.rules import MICROS_DAY

ORDER = ("us", "ping_id")


def _parts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_day", F.floor(F.col("us") / F.lit(MICROS_DAY)))


def with_neighbours(rows: DataFrame, fields: list[str], following: str | None = None, previous: str | None = None, total: str | None = None, key: str = "person") -> DataFrame:
    """rows(key, us, ping_id, ...) with structs of `fields` of a key's next and previous row in the order of (us, ping_id), null where
    there is none, and the number of rows of the key; each under the name that is given for it."""
    held = F.struct(*ORDER, *(f for f in fields if f not in ORDER))
    dealt = _parts(rows)
    days = dealt.groupBy(F.col(key).alias("_key"), F.col("_day").alias("_at")).agg(F.min(held).alias("_first"), F.max(held).alias("_last"), F.count("*").alias("_n"))
    over = Window.partitionBy("_key").orderBy("_at")
    days = days.select("_key", "_at", F.lead("_first").over(over).alias("_ahead"), F.lag("_last").over(over).alias("_before"), F.sum("_n").over(Window.partitionBy("_key")).alias("_total"))
    within = Window.partitionBy(key, "_day").orderBy(*ORDER)
    near = dealt
    if following:
        near = near.withColumn("_next", F.lead(held).over(within))
    if previous:
        near = near.withColumn("_prev", F.lag(held).over(within))
    joined = near.join(days, (F.col(key) == F.col("_key")) & (F.col("_day") == F.col("_at")))
    new = ([F.coalesce("_next", "_ahead").alias(following)] if following else []) + ([F.coalesce("_prev", "_before").alias(previous)] if previous else [])
    return joined.select(*rows.columns, *new, *([F.col("_total").alias(total)] if total else []))


#: Calendar parts, each of which holds a bounded number of the parts before it: 31 days, 12 months, 100 years, and all of the eras.
LEVELS = ("month", "year", "century", "era")


def _part(date: Column, level: str) -> Column:
    year = F.year(date)
    return {"month": year * 12 + F.month(date), "year": year, "century": F.floor(year / 100), "era": F.floor(year / 100_000)}[level]


def runs_of_days(dates: DataFrame, *keys: str) -> DataFrame:
    """dates(*keys, date) -> (*keys, first_day, last_day) of each run of consecutive dates; repeated dates count once, nulls not at all. Runs are
    found within months and joined within years, centuries and eras, so no window sees more than a few hundred rows."""
    runs = dates.filter("date IS NOT NULL").select(*keys, F.col("date").alias("first_day"), F.col("date").alias("last_day")).distinct()
    for level in LEVELS:
        over = Window.partitionBy(*keys, "part").orderBy("first_day")
        parted = runs.withColumn("part", _part(F.col("first_day"), level))
        starts = F.coalesce(F.lag("last_day").over(over) != F.date_sub("first_day", 1), F.lit(True))
        numbered = parted.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(over))
        runs = numbered.groupBy(*keys, "part", "run").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")).select(*keys, "first_day", "last_day")
    return runs
