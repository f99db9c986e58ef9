"""Writers of results: tables as CSV or Parquet, the text report, a map by zoom levels. Paths may lie in any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The deepest level of which the page itself shows the cells: there are at most 2,048 of them.
PAGE_ZOOM = 5


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_text(text: str, path: str, spark: SparkSession | None = None) -> None:
    """A small text as one file, through Hadoop's file systems."""
    context = (spark or SparkSession.active()).sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_map(pyramid: DataFrame, path: str) -> None:
    """Every cell of datasets.map_pyramid: JSON files by zoom level and block of 16 x 16 cells, which a page loads as it needs them, and a page
    with the cells of the deepest level up to PAGE_ZOOM. No level leaves an overlap out."""
    block = F.concat_ws("-", F.shiftright("x", 4).cast("string"), F.shiftright("y", 4).cast("string"))
    tiles = pyramid.withColumn("block", block)
    tiles.repartition("zoom", "block").write.mode("overwrite").partitionBy("zoom", "block").json(f"{path}/tiles")
    shown = pyramid.filter(F.col("zoom") <= PAGE_ZOOM).agg(F.max("zoom").alias("z")).first().z
    rows = pyramid.filter(F.col("zoom") == shown).orderBy(F.desc("n"), "x", "y").collect() if shown is not None else []
    lines = [f"<tr><td>{r.lat:.4f}</td><td>{r.lon:.4f}</td><td>{r.n}</td><td>{r.unique_days}</td><td>{r.nights}</td><td>tiles/zoom={r.zoom}/block={r.x >> 4}-{r.y >> 4}</td></tr>" for r in rows]
    head = "<tr><th>lat</th><th>lon</th><th>overlaps</th><th>days</th><th>nights</th><th>cells</th></tr>"
    write_text(f"<!DOCTYPE html><meta charset='utf-8'><title>Shared places</title><table>{head}{''.join(lines)}</table>", f"{path}/index.html", pyramid.sparkSession)
