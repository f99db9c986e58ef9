"""Registered queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions import geo, rules
from copresence.operators import clean, datasets, features, joins, matrix, metrics, ml, presence
from copresence.plans.analysis import Analysis
from copresence.plans.oracles import ORACLES
from copresence.session import configure, stored
from copresence.plans.report import report
from copresence.sources import exports
from copresence.sources.exports import file_fingerprints
from copresence.sources.photos import couple_photos, read_photo_pages
from copresence.sources.photos import photo_labels as label_photos
from copresence.sources.pings import event_pings
from copresence.streaming import colocation as streams
from copresence.streaming import run as streaming
from copresence.streaming import sequence as streamed

CONFIG = Config(first_meeting="2024-01-05", key_dates={"first_meeting": "2024-01-05"})
QUERIES = {}
c = F.col


def _r(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


def query(build):
    """Register a function of an Analysis under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Analysis(event_pings(configure(spark), sf_dir), CONFIG))

    QUERIES[build.__name__] = run
    return build


def _positions(df: DataFrame, *more):
    return df.select("person", "ping_id", "ts", _r("lat"), _r("lon"), *more)


def _labels(a: Analysis) -> DataFrame:
    """Made-up labels for training of the days with trusted overlaps: together and apart take turns, every eleventh day is mixed."""
    day = F.dayofmonth("date")
    label = F.when(day % 11 == 0, "mixed").when(day % 4 < 2, "together").otherwise("apart")
    return metrics.days(a.trusted).select("date", label.alias("label"))


@query
def days_together(a):
    return a.days_together()


@query
def usable_pings(a):
    return _positions(clean.usable(a.raw, a.config.start_date), "accuracy")


@query
def dedup_2min(a):
    return _positions(a.deduplicated, "accuracy")


@query
def jitter_filter(a):
    return _positions(clean.drop_jitter(a.deduplicated))


@query
def geofence_tag(a):
    return a.pings.select("person", "ping_id", "accuracy", "geofence_radius")


@query
def speed_lead(a):
    return clean.with_speed(a.pings).select("person", "ping_id", _r("speed_kmh"))


@query
def movement_segments(a):
    return clean.segments(a.pings).select("person", "seg_id", "start_us", "end_us", _r("dist_m"), _r("speed_kmh"), "movement", "geofence_radius")


@query
def movement_summary(a):
    legs = clean.segments(a.pings)
    return legs.groupBy("person", "movement").agg(F.count("*").alias("n"), F.round(F.sum("dist_m"), 3).alias("total_m"), F.round(F.sum("gap_h"), 6).alias("hours"))


@query
def distance_functions(a):
    order = clean.in_order()
    nxt = [F.lead(x).over(order) for x in ("lat", "lon")]
    legs = a.deduplicated.select("ping_id", "lat", "lon", nxt[0].alias("la"), nxt[1].alias("lo")).filter("la IS NOT NULL")
    points = (c("lat"), c("lon"), c("la"), c("lo"))
    return legs.select("ping_id", F.round(geo.fast_distance(*points), 6).alias("fast_m"), F.round(geo.geodesic_distance(*points), 3).alias("geodesic_m"))


@query
def country_detect(a):
    return a.pings.select("ping_id", geo.country(c("lat"), c("lon"), a.config).alias("country"), geo.in_home_region(c("lat"), c("lon"), a.config).alias("home_region"))


@query
def privacy_rounding(a):
    return a.pings.select("ping_id", geo.rounded(c("lat")).alias("lat"), geo.rounded(c("lon")).alias("lon"))


@query
def date_parts(a):
    h, d = F.hour("ts"), F.to_date("ts")
    return a.pings.select(
        "ping_id", rules.month_of(c("ts")).alias("month"), F.weekday(d).alias("weekday"), (F.weekday(d) >= 5).alias("is_weekend"),
        rules.is_night(h).alias("night"), rules.is_morning(h).alias("morning"), rules.is_evening(h).alias("evening"),
    )


@query
def coordinate_parse(a):
    lat, lon = c("lat").cast("string"), c("lon").cast("string")
    made = a.deduplicated.select("ping_id", F.when(c("ping_id") % 5 == 4, F.concat(F.lit("near "), lat)).when(
        c("ping_id") % 2 == 0, F.concat(F.lit("geo:"), lat, F.lit(","), lon)
    ).otherwise(F.concat(lat, F.lit("°, "), lon, F.lit("°"))).alias("text"))
    lat, lon = geo.parsed_coordinate(c("text"))
    return made.select("ping_id", lat.alias("lat"), lon.alias("lon"))


@query
def home_cell(a):
    return a.homes


@query
def home_cell_3_decimals(a):
    return presence.home_cells(a.pings, a.config, digits=3, least=5)


@query
def overnight_fill(a):
    fill = presence.overnight_fill(a.pings, a.homes, a.config)
    return fill.select("person", "ts", _r("lat"), _r("lon"), "geofence_radius", "accuracy")


@query
def interp_presence(a):
    made = presence.interpolated(a.overnight, a.config)
    return made.select("person", "ts", _r("lat"), _r("lon"), "interp_type", "geofence_radius", _r("interp_speed_kmh"), "accuracy")


@query
def raw_overlaps(a):
    return a.raw_overlaps.select("p1_ping_id", "p2_ping_id", "ts", _r("lat"), _r("lon"), _r("distance_m"), "tier")


@query
def raw_tier_counts(a):
    return a.raw_overlaps.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("distance_m"), 6).alias("avg_distance_m"))


@query
def segment_pairs(a):
    return joins.segment_pairs(a.legs).select("a_seg_id", "b_seg_id", "a_start_us", "b_start_us", "overlap_start", "overlap_end")


@query
def fine_overlaps(a):
    return a.overlaps.select("bucket", "ts", _r("lat"), _r("lon"), _r("distance_m"), "tier", "p1_geofence", "p2_geofence", "p1_movement", "p2_movement", "geofence_match")


@query
def fine_tier_counts(a):
    return a.overlaps.groupBy("tier", "p1_movement", "p2_movement").agg(F.count("*").alias("n"))


@query
def trusted_overlaps(a):
    return a.trusted.select("bucket", "ts", _r("distance_m"), "tier")


@query
def overlap_stats(a):
    return metrics.overlap_stats(a.overlaps)


@query
def tracked_metrics(a):
    return metrics.tracked_metrics(a.filled, a.trusted, a.config)


def _sides(a):
    """Days on which both were tracked, and nights on which they were together."""
    return metrics.both_tracked(a.filled), metrics.days(a.trusted, night_only=True)


@query
def day_intersect(a):
    one, two = _sides(a)
    return one.intersect(two)


@query
def day_except(a):
    one, two = _sides(a)
    return metrics.only_first(one, two)


@query
def day_symdiff(a):
    one, two = _sides(a)
    return metrics.either_not_both(one, two)


@query
def day_union(a):
    one, two = _sides(a)
    return one.union(two).distinct()


@query
def monthly_summary(a):
    return metrics.monthly_summary(a.trusted)


@query
def month_coverage(a):
    return metrics.month_coverage(a.filled, a.overlaps, a.config)


@query
def daily_counts(a):
    return metrics.daily_counts(a.overlaps)


@query
def residence(a):
    return metrics.residence(a.trusted)


@query
def hour_coverage(a):
    return matrix.hour_coverage(a.filled)


@query
def hourly_matrix(a):
    return a.matrix


def _rule_ensemble(a):
    """States of days by rule and, in place of a model, the share of confirmed overlaps."""
    stand_in = a.features.select("date", c("pct_confirmed").alias("ml_probability"))
    return ml.ensemble(a.filled, a.trusted, stand_in, 0.7)


@query
def hourly_overlay(a):
    return matrix.with_codes(matrix.overlay(a.matrix, _overlay_days(a))).select("date", "hour", "state", "code")


def _overlay_days(a):
    return metrics.days(a.pings).select("date", F.when(F.dayofmonth("date") % 3 == 0, "ml_together").otherwise("apart").alias("state"))


@query
def hourly_gapfill(a):
    return matrix.with_codes(matrix.fill_dense_days(a.matrix)).select("date", "hour", "state", "code")


@query
def calendar_cells(a):
    return datasets.calendar(a.filled, a.overlaps, a.config)


@query
def map_cells(a):
    return datasets.map_cells(a.overlaps)


@query
def map_pyramid(a):
    return datasets.map_pyramid(a.overlaps, (0, 4, 8, 12, 16)).select("zoom", "x", "y", "n", "unique_days", "nights")


@query
def density_timeline(a):
    return datasets.density(a.filled, a.overlaps, a.config)


@query
def gap_islands(a):
    return datasets.gap_islands(datasets.density(a.filled, a.trusted, a.config), "overlaps", least_days=1)


def report_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four dates or more without an event of a user and type."""
    events = configure(spark).read.parquet(f"{sf_dir}/events.parquet")
    reports = events.select(F.concat_ws(":", c("user_id").cast("string"), "event_type").alias("reporter"), "ts")
    return datasets.report_gaps(reports, metrics.bounds_of(CONFIG, events), "reporter")


QUERIES["report_gaps"] = report_gaps


@query
def day_calendar(a):
    return datasets.day_states(a.filled, a.trusted, _rule_ensemble(a), a.config)


@query
def day_features(a):
    rows = a.features
    return rows.select("date", *(F.round(c(n).cast("double"), 6).alias(n) for n in features.feature_names(rows)))


@query
def night_labels(a):
    """Labels that are known do not depend on overlaps, so that days with a confirmed one are left to the operator to rule out."""
    known = metrics.days(a.pings).filter(F.dayofmonth("date") % 5 == 1).select("date", F.lit("together").alias("label"))
    return ml.night_labels(a.pings, a.overlaps, known, a.config, "2024-01-01", "2024-01-31")


@query
def merged_labels(a):
    more = metrics.days(a.pings).select("date", F.lit("apart").alias("label"))
    return ml.merge_labels(_labels(a), more)


@query
def ensemble_days(a):
    return _rule_ensemble(a)


@query
def ensemble_counts(a):
    return metrics.ensemble_counts(_rule_ensemble(a), a.config)


@query
def prob_at_instant(a):
    days = metrics.days(a.pings)
    noon = F.explode(F.array(*(F.lit(h) for h in (3, 9, 12, 21))))
    midnight = rules.micros(c("date").cast("timestamp_ntz"))
    targets = days.select("date", noon.alias("h")).select((midnight + c("h") * rules.MICROS_HOUR).alias("target_us"))
    return matrix.probability_at(a.pings, targets, a.config).select("target_us", _r("prob"))


@query
def prediction_rows(a):
    """What gbt_predictions has beside the model's own columns."""
    return ml.rule_rows(a.features, _labels(a))


@query
def cv_groups(a):
    """The days that loo_half_month_cv predicts, and their groups."""
    return ml.labelled_rows(a.features, _labels(a)).select("date", "y", _half("date").alias("part"))


def _half(date):
    return F.when(F.dayofmonth(date) <= 15, "first").otherwise("second")


def _labelled(a) -> Analysis:
    """The analysis with labels, from end to end, with tables between its steps."""
    labelled = Analysis(a.raw, a.config, tables=True)
    labelled.given_labels = stored(_labels(labelled))
    return labelled


def _trained(a):
    labelled = _labelled(a)
    return labelled.features, labelled.given_labels


@query
def ensemble_from_model(a):
    return _labelled(a).ensemble


@query
def analysis_report(a):
    """The report's lines."""
    lines = list(enumerate(report(_labelled(a)).split("\n")))
    return a.raw.sparkSession.createDataFrame(lines, "line int, text string")


def _documents(a, body) -> DataFrame:
    """A file of an export for each person and day, sorted by time."""
    times = F.array_sort(F.collect_list(F.struct("us", "ping_id", "ts", "lat", "lon")))
    days = a.deduplicated.groupBy("person", F.to_date("ts").alias("date")).agg(times.alias("p"))
    name = F.concat_ws("-", F.lit("person"), "person", c("date").cast("string"))
    return days.select(name.alias("source_file"), body(c("p"), c("date")).alias("body"))


def _iso(ts, zone: str = "Z"):
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(zone))


def _geo(p):
    return F.concat(F.lit("geo:"), p["lat"].cast("string"), F.lit(","), p["lon"].cast("string"))


_PATH_A = "array<struct<point: string, time: string>>"
_VISIT_A = "struct<topCandidate: struct<placeLocation: struct<latLng: string>, semanticType: string>>"


def _body_a(p, point=_geo, time=lambda x: _iso(x["ts"], "+02:00")):
    """Layout A: a day's pings as a path, and a visit from the first to the last."""
    path = F.transform(p, lambda x: F.struct(point(x).alias("point"), time(x).alias("time")))
    place = F.struct(F.struct(_geo(p[0]).alias("latLng")).alias("placeLocation"), F.lit("HOME").alias("semanticType"))
    ends = lambda: (_iso(p[0]["ts"]).alias("startTime"), _iso(F.element_at(p, -1)["ts"]).alias("endTime"))
    visit = F.struct(*ends(), F.lit(None).cast(_PATH_A).alias("timelinePath"), F.struct(place.alias("topCandidate")).alias("visit"))
    legs = F.struct(*ends(), path.alias("timelinePath"), F.lit(None).cast(_VISIT_A).alias("visit"))
    return F.to_json(F.struct(F.array(legs, visit).alias("semanticSegments")))


def _body_b(p, date, point=_geo):
    """Layout B: a day's pings as a path by minutes from the first, which has no offset; a visit, on every other day too far off to be true;
    and a move."""
    start, last = p[0], F.element_at(p, -1)
    minute = lambda x: F.hour(x["ts"]) * 60 + F.minute(x["ts"]) - (F.hour(start["ts"]) * 60 + F.minute(start["ts"]))
    path = F.transform(p, lambda x, i: F.struct(point(x).alias("point"), F.when(i > 0, minute(x).cast("string")).alias("durationMinutesOffsetFromStartTime")))
    far = F.when(F.dayofmonth(date) % 2 == 0, 1.0).otherwise(0.0)
    place = F.concat((start["lat"] + far).cast("string"), F.lit("°, "), start["lon"].cast("string"), F.lit("°"))
    item = lambda **given: F.struct(*((given[n] if n in given else F.lit(None).cast(t)).alias(n) for n, t in exports.ITEM_TYPES.items()))
    times = {"startTime": _iso(F.date_trunc("MINUTE", start["ts"])), "endTime": _iso(F.date_trunc("MINUTE", last["ts"]))}
    visit = F.struct(F.struct(place.alias("placeLocation"), F.lit(None).cast("string").alias("semanticType")).alias("topCandidate"))
    move = F.struct(_geo(start).alias("start"), _geo(last).alias("end"))
    return F.to_json(F.array(item(timelinePath=path, **times), item(visit=visit, **times), item(activity=move, **times)))


@query
def export_a_pings(a):
    """Bodies of layout A in a table."""
    found = exports.parse_a(_documents(a, lambda p, date: _body_a(p)), a.config.start_date)
    return found.select("source_file", "ts", _r("lat"), _r("lon"), "accuracy", "place_type")


@query
def export_b_pings(a):
    """Bodies of layout B in a table."""
    found = exports.parse_b(_documents(a, _body_b), a.config.start_date)
    return found.select("source_file", "ts", _r("lat"), _r("lon"), "accuracy")


def _files(docs: DataFrame) -> list[str]:
    """docs(source_file, body) as files, a folder each, in the shared folder -> the pattern that matches them."""
    path = streaming.scratch(docs.sparkSession)
    docs.write.partitionBy("source_file").text(path)
    return [f"{path}/*/*"]


def _odd(date):
    return F.dayofmonth(date) % 2 == 1


def _mixed(a) -> DataFrame:
    """Days in turns as files of layout A and B."""
    return _documents(a, lambda p, date: F.when(_odd(date), _body_a(p)).otherwise(_body_b(p, date)))


def _read(a, docs) -> DataFrame:
    return exports.read_files(a.raw.sparkSession, _files(docs), exports.named_by_folder())


@query
def export_layouts(a):
    """Layouts by the head of each body; of every fifth day the head is not telling."""
    docs = _mixed(a).withColumn("body", F.when(F.expr("cast(right(source_file, 2) AS int) % 5 = 0"), F.concat(F.repeat(F.lit(" "), F.lit(500)), "body")).otherwise(c("body")))
    return docs.select("source_file", exports.layout_of(c("body")).alias("layout"))


@query
def export_union(a):
    """Pings of a person, deduplicated, from files of both layouts."""
    read = _read(a, _mixed(a))
    persons = [exports.person_pings(read.filter(c("source_file").startswith(f"person-{p}-")), p, a.config) for p in (1, 2)]
    return persons[0].unionByName(persons[1]).select("person", "ts", "accuracy")


@query
def export_metadata(a):
    """What each file holds: pings, the first and the last, and whether it has a hash."""
    paths = _files(_mixed(a))
    pings = exports.pings_of(exports.read_files(a.raw.sparkSession, paths, exports.named_by_folder()), a.config.start_date)
    meta = exports.file_metadata(pings, exports.file_fingerprints(a.raw.sparkSession, paths, exports.named_by_folder()))
    return meta.select("file", "records", "first", "last", F.rlike("file_hash", F.lit("^[0-9a-f]{16}$")).alias("hashed"))


@query
def export_rejects(a):
    """Files of both layouts with points at no place or zero, in layout A also without a time; files of every tenth day are cut off."""
    point = lambda x: F.when(x["ping_id"] % 7 == 3, "near by").when(x["ping_id"] % 7 == 4, "geo:0.0,5.0").otherwise(_geo(x))
    time = lambda x: F.when(x["ping_id"] % 11 != 5, _iso(x["ts"]))
    body = lambda p, date: F.when(_odd(date), _body_a(p, point, time)).otherwise(_body_b(p, date, point))
    docs = _documents(a, lambda p, date: F.when(F.dayofmonth(date) % 10 == 0, F.expr("'[{\"startTime\": '")).otherwise(body(p, date)))
    return exports.rejects(_read(a, docs))


def _photos(a) -> DataFrame:
    """A photo service's dump made of all pings: pages of 50 by month, of which the next one repeats the last photo."""
    rank = F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("us", "ping_id")) - 1
    exif = F.struct(F.when(c("ping_id") % 13 != 0, c("lat")).alias("latitude"), c("lon").alias("longitude"), F.element_at(F.array(*map(F.lit, ("Apple", "APPLE Inc.", "realme", ""))), (c("ping_id") % 4 + 1).cast("int")).alias("make"))
    asset = F.struct(c("ping_id").cast("string").alias("id"), F.when(c("ping_id") % 17 != 0, _iso(c("ts"))).alias("fileCreatedAt"), exif.alias("exifInfo"), c("person"))
    taken = a.deduplicated.select(F.to_date("ts").alias("date"), "person", rank.alias("k"), asset.alias("asset"))
    first, again = F.floor(c("k") / 50), F.when((c("k") % 50 == 49), F.floor(c("k") / 50) + 1)
    paged = taken.withColumn("page", F.explode(F.array_compact(F.array(first, again))))
    pages = paged.groupBy(rules.month_of(c("date")).alias("month"), "date", "person", "page").agg(F.collect_list("asset").alias("items"))
    body = F.to_json(F.struct(F.struct("items", (c("page") + 2).cast("string").alias("nextPage")).alias("assets")))
    path = streaming.scratch(a.raw.sparkSession)
    pages.select("person", "month", body.alias("value")).write.partitionBy("person", "month").text(path)
    of = lambda p: read_photo_pages(a.raw.sparkSession, f"{path}/person={p}", "2024-01-03", "2024-01-28")
    return couple_photos(of(1), of(2))


@query
def photo_evidence(a):
    """Photos of both: all of one person, those of the other that a phone of the brand took."""
    return _photos(a).select("asset_id", "timestamp", _r("lat"), _r("lon"), "camera_make")


@query
def photo_labels(a):
    """Labels from the dump, in the second place after those that are given."""
    return ml.merge_labels(_labels(a), label_photos(_photos(a)))


@query
def photo_features(a):
    """Features of days with photos."""
    rows = features.day_features(a.filled, a.overlaps, _photos(a))
    return rows.select("date", *(_r(n) for n in ("n_overlaps", "n_couple_photos", "has_couple_photos")))


@query
def loo_half_month_cv(a):
    """The driver's events lie in one month, so halves of it are the groups."""
    rows, labels = _trained(a)
    return ml.leave_one_group_out(rows, labels, _half)


@query
def gbt_predictions(a):
    rows, labels = _trained(a)
    model = ml.fit(rows, labels)
    return ml.predict_all(model, rows, labels)


@query
def gbt_importances(a):
    rows, labels = _trained(a)
    return ml.importances(ml.fit(rows, labels), rows)


@query
def classifier_comparison(a):
    rows, labels = _trained(a)
    return ml.comparison(ml.predict_all(ml.fit(rows, labels), rows, labels))


@query
def classification_metrics(a):
    stand_in = a.features.select("date", c("pct_confirmed").alias("p")).join(_labels(a), "date")
    return ml.metrics_of(stand_in.withColumn("y", rules.label_to_binary(c("label"))), "y", "p", 0.5)


def _clocked(rows: DataFrame) -> DataFrame:
    """ts as the time that a watermark can follow."""
    return rows.withColumn("ts", F.timestamp_micros("us"))


#: Microseconds behind the last row that move the watermark past all windows and the longest leg.
_LATER = 60 * rules.MICROS_HOUR
_NOBODY = {"person": 0, "ping_id": -1, "lat": 0.0, "lon": 0.0}


@query
def stream_raw_overlaps(a):
    """raw_overlaps of pings replayed in four stretches of time."""
    pings = streaming.replayed(clean.with_speed(a.pings).drop("ts"))
    found = streaming.drained(streams.raw_overlaps_stream(_clocked(pings), a.config))
    return found.select("p1_ping_id", "p2_ping_id", "ts", _r("lat"), _r("lon"), _r("distance_m"), "tier")


@query
def stream_segments(a):
    """movement_segments of deduplicated pings that are replayed: jitter is dropped in the stream."""
    streamed.use_rocksdb(a.raw.sparkSession)
    pings = streaming.replayed(a.deduplicated.drop("ts"), heartbeat=(_NOBODY, _LATER))
    legs = streaming.drained(streamed.legs_stream(_clocked(pings), a.config, drop_leaps=True))
    return legs.select("person", "seg_id", "start_us", "end_us", _r("dist_m"), _r("speed_kmh"), "movement", "geofence_radius")


@query
def stream_overnight(a):
    """overnight_fill of pings that are replayed."""
    streamed.use_rocksdb(a.raw.sparkSession)
    pings = streaming.replayed(a.pings.drop("ts"), heartbeat=(_NOBODY, _LATER))
    fill = streaming.drained(streamed.overnight_stream(_clocked(pings), streaming.stored(a.homes), a.config))
    return fill.select("person", "ts", _r("lat"), _r("lon"), "geofence_radius", "accuracy")


@query
def stream_fine_overlaps(a):
    """fine_overlaps in two streams: legs to matches, matches to the closest of each bucket."""
    matches = streaming.drained(streams.fine_matches_stream(streaming.replayed(a.legs, at="end_us"), a.config))
    found = streaming.drained(streams.closest_stream(streaming.replayed(matches, heartbeat=({}, _LATER))))
    return found.select("bucket", "ts", _r("lat"), _r("lon"), _r("distance_m"), "tier", "p1_geofence", "p2_geofence", "p1_movement", "p2_movement", "geofence_match")


@query
def stream_gap_islands(a):
    """gap_islands of trusted overlaps between their first and last day, from spells of a stream."""
    met = a.trusted.select(F.lit(1).alias("person"), "us")
    pings = streaming.replayed(met, heartbeat=({"person": 0}, 40 * rules.MICROS_DAY))
    spells = streaming.drained(streams.spells_stream(_clocked(pings), least_days=1)).filter("person = 1")
    return streams.gaps_between(spells, least_days=1).select("first_day", "last_day")


def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_fingerprints(spark, [f"{sf_dir}/*.parquet"])


QUERIES["file_fingerprint"] = file_fingerprint
