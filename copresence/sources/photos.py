"""Photo evidence and labels from files. Photo services are not called: export what they hold as JSON or Parquet, or keep the pages that their
search gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copresence.functions.rules import is_phone_camera
from copresence.sources.exports import wall_clock

PHOTO_SCHEMA = "timestamp timestamp_ntz, lat double, lon double, asset_id string, camera_make string"
LABEL_SCHEMA = "date date, label string"
#: A page of a search as a service gives it; coordinates and makers are those of the assets' details.
PAGE_SCHEMA = (
    "assets struct<items: array<struct<id: string, fileCreatedAt: string, createdAt: string, "
    "exifInfo: struct<latitude: double, longitude: double, make: string>>>, nextPage: string>"
)


def _between(photos: DataFrame, first: str, last: str) -> DataFrame:
    day = F.to_date("timestamp")
    return photos.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def read_photos(spark: SparkSession, path: str, first: str, last: str, fmt: str = "json") -> DataFrame:
    """Photos with a position, taken from the first to the last date, both included."""
    return _between(spark.read.schema(PHOTO_SCHEMA).format(fmt).load(path), first, last)


def read_photo_pages(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Photos of a dump of pages that lie in folders `month=YYYY-MM`, a page a line or a file. Folders of other months are not listed, and
    pages are dealt to tasks by Spark's reader. A photo that two pages hold, since a search moves on while it is read, counts once; photos
    without a readable time, or with a coordinate that is null or zero, do not count."""
    pages = spark.read.schema(f"{PAGE_SCHEMA}, month string").json(path)
    pages = pages.filter(F.col("month").between(first[:7], last[:7]))
    item = pages.select(F.explode("assets.items").alias("i"))
    exif = F.col("i.exifInfo")
    nonzero = lambda c: F.when(c != 0, c)
    photos = item.select(
        wall_clock(F.coalesce(F.nullif("i.fileCreatedAt", F.lit("")), "i.createdAt")).alias("timestamp"), nonzero(exif["latitude"]).alias("lat"), nonzero(exif["longitude"]).alias("lon"),
        F.col("i.id").alias("asset_id"), exif["make"].alias("camera_make"),
    )
    kept = _between(photos, first, last)
    # the first by time, then place: the same one whatever order pages are read in
    once = kept.groupBy("asset_id").agg(F.min(F.struct("timestamp", "lat", "lon", "camera_make")).alias("p"))
    return once.select("p.timestamp", "p.lat", "p.lon", "asset_id", "p.camera_make")


def couple_photos(of_one: DataFrame, of_two: DataFrame, brand: str = "apple") -> DataFrame:
    """Evidence of both: photos of one person come from the other's library; those of the other count if a phone of the brand took them."""
    return of_one.unionByName(by_phone(of_two, brand))


def by_phone(photos: DataFrame, brand: str = "apple") -> DataFrame:
    return photos.filter(is_phone_camera(F.col("camera_make"), brand))


def photo_labels(photos: DataFrame) -> DataFrame:
    """(date, label): days with a photo of both count as together."""
    return photos.select(F.to_date("timestamp").alias("date"), F.lit("together").alias("label")).distinct()


def read_labels(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """(date, label) with labels together, apart or mixed."""
    reader = spark.read.schema(LABEL_SCHEMA).format(fmt)
    labels = (reader.option("header", True) if fmt == "csv" else reader).load(path)
    return labels.filter(F.col("label").isin("together", "apart", "mixed")).dropDuplicates(["date"])
