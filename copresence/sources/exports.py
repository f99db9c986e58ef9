"""Location exports of devices: two JSON layouts, parsed and united a person at a time.

Layout A is an object with `semanticSegments`; layout B is an array of items. Time offsets are dropped, not converted. Files are read
by Spark's JSON reader as streams of tokens, so paths may lie in any store and no file becomes one string. Corrupt files give no pings;
they, and items that cannot be read, are found by `rejects`. Bodies that lie in a table are sniffed and parsed by `parse_a` and `parse_b`.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copresence.config import Config
from copresence.functions.geo import geodesic_distance, parsed_coordinate
from copresence.functions.rules import MICROS_MINUTE, from_micros, micros
from copresence.operators.clean import dedup_2min
from copresence.sources import hashing

#: Bytes of a file that one task hashes, and larger files that are hashed at the same time.
LARGE_FILE, FILES_AT_ONCE = 128 << 20, 4

_CANDIDATE = "struct<topCandidate: struct<placeLocation: string, semanticType: string>>"
SCHEMA_A = f"semanticSegments array<struct<startTime: string, endTime: string, timelinePath: array<struct<point: string, time: string>>, visit: {_CANDIDATE}>>"
ITEM_TYPES = {
    "startTime": "string", "endTime": "string", "visit": _CANDIDATE, "activity": "struct<start: string, end: string>",
    "timelinePath": "array<struct<point: string, durationMinutesOffsetFromStartTime: string>>",
}
ITEM_FIELDS = list(ITEM_TYPES)
ITEM_B = f"struct<{', '.join(f'{n}: {t}' for n, t in ITEM_TYPES.items())}>"
#: Files of both layouts: an object is a row, an array a row an item.
FILE_SCHEMA = ", ".join([SCHEMA_A, *(f"{n} {t}" for n, t in ITEM_TYPES.items()), "damaged string"])
REJECTS = "source_file string, item long, point int, reason string"


def wall_clock(text: Column) -> Column:
    """Zone-naive time of an ISO string: an offset or Z is dropped."""
    return F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "").try_cast("timestamp_ntz")


def place(candidate: Column) -> Column:
    """Coordinate text of a place, which is a string or an object with latLng (read as its JSON text)."""
    where = candidate["topCandidate"]["placeLocation"]
    return F.coalesce(F.get_json_object(where, "$.latLng"), where)


def layout_of(body: Column) -> Column:
    """A, B or ?, sniffed from the first 500 characters of a body."""
    head = F.substring(body, 1, 500)
    b = head.contains("visit") | head.contains("activity") | F.ltrim(head).startswith("[")
    return F.when(head.contains("semanticSegments"), "A").when(b, "B").otherwise("?")


def _pings(rows: DataFrame, start_date: str) -> DataFrame:
    """rows(t, point, accuracy, source_file, place_type) -> pings that count."""
    lat, lon = parsed_coordinate(F.col("point"))
    out = rows.select(F.col("t").alias("ts"), micros(F.col("t")).alias("us"), lat.alias("lat"), lon.alias("lon"), "accuracy", "source_file", "place_type")
    return out.filter(F.col("ts").isNotNull() & F.col("lat").isNotNull() & (F.col("lat") != 0) & (F.col("lon") != 0) & (F.col("ts") >= F.lit(start_date).cast("timestamp_ntz")))


def parse_a(docs: DataFrame, start_date: str) -> DataFrame:
    """Pings of docs(source_file, body) in layout A."""
    return _pings_a(docs.select("source_file", F.explode(F.from_json("body", SCHEMA_A)["semanticSegments"]).alias("s")), start_date)


def _pings_a(segments: DataFrame, start_date: str) -> DataFrame:
    path = segments.select("source_file", F.explode("s.timelinePath").alias("p")).select(
        wall_clock(F.col("p.time")).alias("t"), F.col("p.point").alias("point"), F.lit(10).alias("accuracy"), "source_file", F.lit(None).cast("string").alias("place_type")
    )
    v = segments.filter("s.visit IS NOT NULL").select(
        "source_file", place(F.col("s.visit")).alias("point"), F.col("s.visit.topCandidate.semanticType").alias("place_type"),
        wall_clock(F.col("s.startTime")).alias("a"), wall_clock(F.col("s.endTime")).alias("b"),
    )
    # the end of a visit counts only if its start does
    visits = v.filter(F.col("a") >= F.lit(start_date).cast("timestamp_ntz")).select(
        F.explode(F.array("a", "b")).alias("t"), "point", F.lit(20).alias("accuracy"), "source_file", "place_type"
    )
    return _pings(path.unionByName(visits), start_date)


def _offset(point: Column) -> Column:
    """Minutes of a path's point from the start of its item; none means 0."""
    return F.coalesce(point["durationMinutesOffsetFromStartTime"], F.lit("0")).try_cast("double")


def parse_b(docs: DataFrame, start_date: str, phantom_m: float = 5000.0) -> DataFrame:
    """Pings of docs(source_file, body) in layout B."""
    return _pings_b(docs.select("source_file", F.explode(F.from_json("body", f"array<{ITEM_B}>")).alias("s")), start_date, phantom_m)


def _pings_b(items: DataFrame, start_date: str, phantom_m: float) -> DataFrame:
    base = items.withColumns({"a": wall_clock(F.col("s.startTime")), "b": wall_clock(F.col("s.endTime"))})
    at = lambda a, p: from_micros(micros(a) + (_offset(p) * MICROS_MINUTE).cast("long"))
    none = F.lit(None).cast("string").alias("place_type")
    path = base.select("source_file", "a", F.explode("s.timelinePath").alias("p")).select(at(F.col("a"), F.col("p")).alias("t"), F.col("p.point").alias("point"), F.lit(15).alias("accuracy"), "source_file", none)
    # the window of a path: its time from the start of the item, and the centre of its points
    parsed = lambda p: parsed_coordinate(p["point"])
    points = F.transform("s.timelinePath", lambda p: F.struct(at(F.col("a"), p).alias("t"), parsed(p)[0].alias("lat"), parsed(p)[1].alias("lon")))
    valid = F.filter(points, lambda p: p["lat"].isNotNull() & (p["lat"] != 0) & (p["lon"] != 0) & p["t"].isNotNull())
    mean = lambda n: F.aggregate(F.col("points")[n], F.lit(0.0), lambda x, y: x + y) / F.size("points")
    windows = base.select("source_file", F.col("a").alias("w_a"), valid.alias("points")).filter(F.size("points") > 0).select(
        "source_file", "w_a", F.array_max(F.col("points")["t"]).alias("w_b"), mean("lat").alias("w_lat"), mean("lon").alias("w_lon")
    )
    visits = base.filter("s.visit IS NOT NULL").select(F.explode(F.array("a", "b")).alias("t"), place(F.col("s.visit")).alias("point"), F.lit(20).alias("accuracy"), "source_file", none)
    moves = base.filter("s.activity IS NOT NULL").select(
        F.explode(F.array(F.struct(F.col("a").alias("t"), F.col("s.activity.start").alias("point")), F.struct(F.col("b").alias("t"), F.col("s.activity.end").alias("point")))).alias("m"),
        "source_file",
    ).select("m.t", "m.point", F.lit(30).alias("accuracy"), "source_file", none)
    return _pings(path, start_date).unionByName(without_phantoms(_pings(visits.unionByName(moves), start_date), windows, phantom_m))


def named_by_file() -> Column:
    return F.col("_metadata.file_name")


def named_by_folder() -> Column:
    """The folder that a file lies in, for services that give all exports one name; of `key=value` the value."""
    return F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -2), "^.*=", "")


def read_files(spark: SparkSession, paths: list[str], name: Column | None = None) -> DataFrame:
    """(source_file, at, semanticSegments, the fields of an item, damaged): a row for an object, one an item for an array. `at` grows with the
    position in the file; `damaged` is set where a file, or a part of it, is not of this form."""
    rows = spark.read.schema(FILE_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "damaged").json(paths)
    return rows.select((named_by_file() if name is None else name).alias("source_file"), F.monotonically_increasing_id().alias("at"), "semanticSegments", *ITEM_FIELDS, "damaged")


def pings_of(files: DataFrame, start_date: str, phantom_m: float = 5000.0) -> DataFrame:
    """Pings of both layouts, which the structure of a file tells apart."""
    segments = files.select("source_file", F.explode("semanticSegments").alias("s"))
    items = files.filter("semanticSegments IS NULL").select("source_file", F.struct(*ITEM_FIELDS).alias("s"))
    return _pings_a(segments, start_date).unionByName(_pings_b(items, start_date, phantom_m))


def _faults(s: Column, path_time) -> Column:
    """(point, reason) of what cannot be read in an item: its own fields first (point is null), then the points of its path. Pings of
    coordinate zero are named too; those before the start date are no faults."""

    def fault(time: Column, text: Column) -> Column:
        lat, lon = parsed_coordinate(text)
        return F.when(time.isNull(), "time").when(lat.isNull(), "place").when((lat == 0) | (lon == 0), "zero")

    nowhere, start, end = F.lit(None).cast("int"), wall_clock(s["startTime"]), wall_clock(s["endTime"])
    ends = F.when(s["visit"].isNotNull(), F.array(*(fault(t, place(s["visit"])) for t in (start, end))))
    moves = F.when(s["activity"].isNotNull(), F.array(fault(start, s["activity"]["start"]), fault(end, s["activity"]["end"])))
    none = F.array().cast("array<string>")
    own = F.transform(F.concat(F.coalesce(ends, none), F.coalesce(moves, none)), lambda r: F.struct(nowhere.alias("point"), r.alias("reason")))
    path = F.transform(s["timelinePath"], lambda p, i: F.struct(i.alias("point"), fault(path_time(start, p), p["point"]).alias("reason")))
    kinds = "array<struct<point: int, reason: string>>"
    return F.filter(F.concat(own.cast(kinds), F.coalesce(path.cast(kinds), F.array().cast(kinds))), lambda x: x["reason"].isNotNull())


def rejects(files: DataFrame) -> DataFrame:
    """(source_file, item, point, reason) of what gives no ping: `damaged` files or items, `unknown` ones without a field of either layout, and
    ends of visits and moves or points of paths without a readable `time` or `place`, or at `zero`. item and point count from 0; what
    is true of a whole file of one object has item 0. A file's items are numbered after all but their faults is gone."""
    nothing = F.coalesce(F.col("semanticSegments").isNull(), F.lit(True))
    for field in ITEM_FIELDS:
        nothing = nothing & F.col(field).isNull()
    whole = F.when(nothing & F.col("damaged").isNotNull(), "damaged").when(nothing, "unknown").when(F.col("damaged").isNotNull(), "damaged")
    struct = F.struct(*ITEM_FIELDS)
    in_b = _faults(struct, lambda start, p: from_micros(micros(start) + (_offset(p) * MICROS_MINUTE).cast("long")))
    in_a = F.flatten(F.transform("semanticSegments", lambda s, i: F.transform(
        # of layout A moves count for nothing
        _faults(F.struct(s["startTime"].alias("startTime"), s["endTime"].alias("endTime"), s["visit"].alias("visit"), F.lit(None).cast("struct<start: string, end: string>").alias("activity"), s["timelinePath"].alias("timelinePath")), lambda start, p: wall_clock(p["time"])),
        lambda x: F.struct(i.cast("long").alias("item"), x["point"].alias("point"), x["reason"].alias("reason")),
    )))
    of_file = F.struct(F.lit(None).cast("long").alias("item"), F.lit(None).cast("int").alias("point"), whole.alias("reason"))
    of_items = F.transform(in_b, lambda x: F.struct(F.lit(None).cast("long").alias("item"), x["point"].alias("point"), x["reason"].alias("reason")))
    found = F.concat(F.array(of_file), F.when(F.col("semanticSegments").isNotNull(), in_a).otherwise(of_items))
    place_in_file = F.row_number().over(Window.partitionBy("source_file").orderBy("at")) - 1
    faults = files.select("source_file", "at", F.filter(found, lambda x: x["reason"].isNotNull()).alias("x")).withColumn("k", place_in_file)
    return faults.select("source_file", F.col("k").cast("long").alias("k"), F.explode("x").alias("x")).select("source_file", F.coalesce("x.item", "k").alias("item"), "x.point", "x.reason")


def rejected(spark: SparkSession, paths: list[str]) -> DataFrame:
    """rejects() of files, and `missing` paths and `empty` files, which have no rows: the names of files, which the driver lists to read them, tell."""
    there = [p for p in paths if _exists(spark, p)]
    missing = [(p.rsplit("/", 1)[-1], None, None, "missing") for p in paths if p not in there]
    out = spark.createDataFrame(missing, REJECTS)
    if there:
        files = read_files(spark, there)
        listed = spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in spark.read.schema(FILE_SCHEMA).json(there).inputFiles()], "source_file string")
        empty = listed.join(files.select("source_file").distinct(), "source_file", "left_anti")
        out = out.unionByName(rejects(files)).unionByName(empty.select("source_file", F.lit(None).cast("long").alias("item"), F.lit(None).cast("int").alias("point"), F.lit("empty").alias("reason")))
    return out


def without_phantoms(pings: DataFrame, windows: DataFrame, phantom_m: float) -> DataFrame:
    """pings but those within a path's window of time (its hours deal them out) and over `phantom_m` from the path's centre."""
    hour = lambda ts: F.date_trunc("HOUR", ts).cast("timestamp_ntz")
    w = windows.select(F.col("source_file").alias("w_file"), "w_a", "w_b", "w_lat", "w_lon", F.explode(F.sequence(hour("w_a"), hour("w_b"), F.expr("INTERVAL 1 HOUR"))).alias("w_hour"))
    far = geodesic_distance(F.col("lat"), F.col("lon"), F.col("w_lat"), F.col("w_lon")) > phantom_m
    on = (F.col("source_file") == F.col("w_file")) & (F.col("_hour") == F.col("w_hour")) & F.col("ts").between(F.col("w_a"), F.col("w_b")) & far
    return pings.withColumn("_hour", hour("ts")).join(w, on, "left_anti").drop("_hour")


def read_person(spark: SparkSession, paths: list[str], person: int, config: Config) -> DataFrame:
    """All pings of a person's files, deduplicated. Files that are not there are passed over (see `rejected`)."""
    there = [p for p in paths if _exists(spark, p)]
    return person_pings(read_files(spark, there), person, config) if there else spark.createDataFrame([], PING_SCHEMA)


def person_pings(files: DataFrame, person: int, config: Config) -> DataFrame:
    """The pings of read_files() as those of a person, deduplicated."""
    # an id from the contents, so that a recomputed task gives the same order
    named = pings_of(files, config.start_date).withColumns({"person": F.lit(person), "ping_id": F.xxhash64("us", "lat", "lon", "accuracy", "source_file")})
    return dedup_2min(named.select(*PING_SCHEMA.names))


PING_SCHEMA = T.StructType([
    T.StructField("ping_id", T.LongType()), T.StructField("person", T.IntegerType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("us", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("accuracy", T.IntegerType()), T.StructField("source_file", T.StringType()), T.StructField("place_type", T.StringType()),
])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def file_fingerprints(spark: SparkSession, paths: list[str], name: Column | None = None) -> DataFrame:
    """(file, file_hash): first 16 hex digits of each file's SHA-256. Files of up to LARGE_FILE bytes are read whole by a task; larger ones are hashed
    split by split when this is called, some of them side by side (see hashing.py). Packed files, and all where OpenSSL gives out no state,
    are read whole."""
    files = spark.read.format("binaryFile").load(paths)
    named = (named_by_file() if name is None else name).alias("file")
    printed = lambda of: of.select(named, F.substring(F.sha2("content", 256), 1, 16).alias("file_hash"))
    found = files.filter(F.col("length") > LARGE_FILE).select(named, "path", "length").collect() if hashing.resumable() else []
    if not found:
        return printed(files)
    large, packed = [r for r in found if not r.path.endswith(hashing.PACKED)], [hashing.literal(r.path) for r in found if r.path.endswith(hashing.PACKED)]
    prints = printed(files.filter(F.col("length") <= LARGE_FILE))
    if packed:
        prints = prints.unionByName(printed(spark.read.format("binaryFile").load(packed)))

    def hashed(r):
        return r.file, hashing.sha256_by_splits(spark, r.path, r.length)[:16]

    with ThreadPool(max(1, min(FILES_AT_ONCE, len(large)))) as pool:
        made = pool.map(inheritable_thread_target(spark)(hashed), large)
    return prints.unionByName(spark.createDataFrame(made, "file string, file_hash string"))


def file_metadata(pings: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(file, records, first, last, file_hash) of each source file."""
    counted = pings.groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("records"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return fingerprints.join(counted, "file", "left").fillna(0, ["records"])
