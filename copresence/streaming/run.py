"""Stages of a stream as tables: replaying a table in order of time, and draining a stream into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copresence.session import scratch, stored


def replayed(rows: DataFrame, at: str = "us", parts: int = 4, heartbeat: tuple[dict, int] | None = None) -> DataFrame:
    """rows as a stream of `parts` stretches of time, one micro-batch each. heartbeat: columns of a row that comes last, so many microseconds
    after the rest, and moves the watermark past all of it."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    rows = stored(rows)
    span = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    rows.limit(0).write.parquet(path)
    if span.a is not None:
        step = (span.b - span.a) // parts + 1
        for k in range(parts):
            rows.filter(F.floor((F.col(at) - F.lit(span.a)) / F.lit(step)) == k).coalesce(1).write.mode("append").parquet(path)
        if heartbeat:
            given, later = heartbeat
            values = {**given, at: span.b + later}
            last = spark.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
            last.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, timeout_s: int = 1800) -> DataFrame:
    """The table that a stream has made of all that was there when it started. A query that failed can be run again from its checkpoint."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout_s):
            raise TimeoutError(f"the stream has not ended in {timeout_s} s")
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
