"""Session settings that every query of the library relies on, and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session zone: all timestamps are zone-naive wall clock."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="streams-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/stream-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """rows as a table, so that what they are made of is run once, and is no part of the plans of what is made of them: a stream would run a static
    side again with each micro-batch, and each fit and result would plan all that comes before it."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
