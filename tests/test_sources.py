"""Loaders on hand-written exports; photos, labels, fingerprints, sinks, report."""

import gzip
import hashlib
import json
import random
from datetime import datetime
from urllib.parse import quote

import pytest

from copresence.config import Config
from copresence.plans.analysis import Analysis
from copresence.plans.report import report
from copresence.sources import exports, photos, sinks

CONFIG = Config(start_date="2024-01-01", key_dates={"first_meeting": "2024-01-02"})


def _write(folder, name, content):
    path = folder / name
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(path)


def _pings(spark, *paths, config=CONFIG):
    rows = exports.read_person(spark, list(paths), 1, config).orderBy("us", "accuracy").collect()
    return [(r.ts, r.lat, r.lon, r.accuracy) for r in rows]


A = {
    "semanticSegments": [
        {"startTime": "2024-01-02T10:00:00.000+02:00", "endTime": "2024-01-02T12:00:00.000+02:00", "timelinePath": [
            {"point": "50.85°, 5.70°", "time": "2024-01-02T10:10:00.000+02:00"}, {"point": "geo:50.86,5.71", "time": "2024-01-02T10:20:00Z"},
            {"point": "nonsense", "time": "2024-01-02T10:30:00Z"}, {"point": "geo:50.85,5.70"}, {"point": "geo:0.0,5.70", "time": "2024-01-02T10:40:00Z"},
        ]},
        {"startTime": "2024-01-02T13:00:00Z", "endTime": "2024-01-02T14:00:00Z", "visit": {"topCandidate": {"placeLocation": {"latLng": "50.9°, 5.8°"}, "semanticType": "HOME"}}},
        {"startTime": "2023-12-31T23:00:00Z", "endTime": "2024-01-01T08:00:00Z", "visit": {"topCandidate": {"placeLocation": "geo:50.1,5.1"}}},
    ]
}


def test_layout_a(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 2, h, m)
    assert _pings(spark, _write(tmp_path, "a.json", A)) == [
        (at(10, 10), 50.85, 5.70, 10), (at(10, 20), 50.86, 5.71, 10), (at(13, 0), 50.9, 5.8, 20), (at(14, 0), 50.9, 5.8, 20),
    ]


def test_layout_b_offsets_activities_and_phantoms(spark, tmp_path):
    b = [
        {"startTime": "2024-01-02T10:00:00Z", "endTime": "2024-01-02T12:00:00Z", "timelinePath": [
            {"point": "geo:50.0,5.0", "durationMinutesOffsetFromStartTime": 0}, {"point": "geo:50.0,5.0", "durationMinutesOffsetFromStartTime": "90"}]},
        {"startTime": "2024-01-02T10:30:00Z", "endTime": "2024-01-02T12:30:00Z", "visit": {"topCandidate": {"placeLocation": "geo:51.0,5.0"}}},
        {"startTime": "2024-01-02T15:00:00Z", "endTime": "2024-01-02T16:00:00Z", "activity": {"start": "geo:50.0,5.0", "end": "geo:50.2,5.0"}},
    ]
    at = lambda h, m: datetime(2024, 1, 2, h, m)
    assert _pings(spark, _write(tmp_path, "b.json", b)) == [
        (at(10, 0), 50.0, 5.0, 15), (at(11, 30), 50.0, 5.0, 15), (at(12, 30), 51.0, 5.0, 20), (at(15, 0), 50.0, 5.0, 30), (at(16, 0), 50.2, 5.0, 30),
    ]


def test_layout_b_without_an_offset(spark, tmp_path):
    """A point without an offset is at the start, and counts for the window of its path."""
    b = [
        {"startTime": "2024-01-02T10:00:00Z", "endTime": "2024-01-02T12:00:00Z", "timelinePath": [{"point": "geo:50.0,5.0"}, {"point": "geo:50.0,5.0", "durationMinutesOffsetFromStartTime": 60}]},
        {"startTime": "2024-01-02T10:10:00Z", "endTime": "2024-01-02T11:30:00Z", "visit": {"topCandidate": {"placeLocation": "geo:51.0,5.0"}}},
    ]
    at = lambda h, m: datetime(2024, 1, 2, h, m)
    assert _pings(spark, _write(tmp_path, "b.json", b)) == [(at(10, 0), 50.0, 5.0, 15), (at(11, 0), 50.0, 5.0, 15), (at(11, 30), 51.0, 5.0, 20)]


@pytest.mark.parametrize("content", ["", "{not json", "[]", "{}", '{"semanticSegments": null}', '[{"visit": 5}]'])
def test_corrupt_and_empty_files(spark, tmp_path, content):
    assert _pings(spark, _write(tmp_path, "x.json", content)) == []


def test_missing_files_are_passed_over(spark, tmp_path):
    assert _pings(spark, str(tmp_path / "none.json")) == []
    assert len(_pings(spark, str(tmp_path / "none.json"), _write(tmp_path, "a.json", A))) == 4


def test_fingerprints_and_metadata(spark, tmp_path):
    path = _write(tmp_path, "a.json", A)
    prints = exports.file_fingerprints(spark, [path])
    meta = exports.file_metadata(exports.read_person(spark, [path], 1, CONFIG), prints).first()
    assert meta.file_hash == hashlib.sha256(open(path, "rb").read()).hexdigest()[:16] and meta.records == 4


def test_photos_and_labels(spark, tmp_path):
    lines = [
        {"timestamp": "2024-01-02T10:00:00", "lat": 50.0, "lon": 5.0, "asset_id": "a", "camera_make": "Apple"},
        {"timestamp": "2024-01-03T10:00:00", "lat": None, "lon": 5.0, "asset_id": "b", "camera_make": "Apple"},
        {"timestamp": "2024-01-05T10:00:00", "lat": 50.0, "lon": 5.0, "asset_id": "c", "camera_make": None},
    ]
    found = photos.read_photos(spark, _write(tmp_path, "p.json", "\n".join(map(json.dumps, lines))), "2024-01-02", "2024-01-04")
    assert [r.asset_id for r in photos.by_phone(found).collect()] == ["a"]
    assert [(str(r.date), r.label) for r in photos.photo_labels(found).collect()] == [("2024-01-02", "together")]
    labels = photos.read_labels(spark, _write(tmp_path, "l.csv", "date,label\n2024-01-01,apart\n2024-01-02,odd\n"))
    assert [(str(r.date), r.label) for r in labels.collect()] == [("2024-01-01", "apart")]


def test_report_and_sinks(spark, tmp_path):
    other = json.loads(json.dumps(A).replace("5.70", "5.7001"))
    one, two = (exports.read_person(spark, [_write(tmp_path, f"{p}.json", x)], p, CONFIG) for p, x in ((1, A), (2, other)))
    analysis = Analysis(one.unionByName(two), CONFIG)
    text = report(analysis, exports.file_metadata(one, exports.file_fingerprints(spark, [str(tmp_path / "1.json")])))
    assert "together on 1 (100.0%)" in text and "First Meeting: 2024-01-02" in text and "4 records" in text
    sinks.write_text(text, str(tmp_path / "report.txt"))
    assert (tmp_path / "report.txt").read_text(encoding="utf-8") == text
    sinks.write_csv(analysis.days_together(), str(tmp_path / "days"))
    assert spark.read.option("header", True).csv(str(tmp_path / "days")).first().date == "2024-01-02"
    pyramid, n = analysis.charts()["map_pyramid"], analysis.overlaps.count()
    sinks.write_map(pyramid, str(tmp_path / "map"))
    assert "<table>" in (tmp_path / "map" / "index.html").read_text()
    levels = spark.read.json(str(tmp_path / "map" / "tiles")).groupBy("zoom").agg({"n": "sum"}).collect()
    assert len(levels) == 18 and {r["sum(n)"] for r in levels} == {n} and n > 0


def test_streaming_dedup_matches_the_batch(spark, tmp_path):
    from copresence.streaming.dedup import dedup_2min_stream

    rows = [(i, 1 + i % 2, datetime(2024, 1, 1, 0, i % 50, i % 60), (10, 15, 20)[i % 3]) for i in range(200)] + [(999, 1, datetime(2024, 1, 1, 9), 10)]
    schema = "ping_id long, person int, ts timestamp, accuracy int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = dedup_2min_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("deduped").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    best = {}
    for i, p, ts, a in rows:
        key = (p, ts.replace(minute=ts.minute // 2 * 2, second=0))
        best[key] = min(best.get(key, (99,)), (a, ts, i))
    want = {v[2] for k, v in best.items() if k[1].hour == 0}
    assert {r.ping_id for r in spark.table("deduped").collect()} - {999} == want


def test_rejects_name_what_gives_no_ping(spark, tmp_path):
    b = [
        {"startTime": "2024-01-02T10:00:00Z", "endTime": "later", "visit": {"topCandidate": {"placeLocation": "somewhere"}}, "timelinePath": [{"point": "geo:50.0,5.0"}, {"point": "geo:50.0,5.0", "durationMinutesOffsetFromStartTime": "x"}, {"point": "?"}]},
        {"startTime": "2024-01-02T10:00:00Z", "endTime": "2024-01-02T11:00:00Z", "activity": {"start": "geo:50.0,5.0", "end": "geo:0,0"}},
        {"other": 1},
    ]
    whole = json.dumps(b)
    paths = [_write(tmp_path, n, x) for n, x in {"a.json": A, "b.json": b, "cut.json": whole[:-4], "empty.json": "", "none.json": "[]", "object.json": "{}", "odd.json": '[{"visit": 5}]'}.items()]
    got = exports.rejected(spark, [*paths, str(tmp_path / "gone.json")]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("a.json", 0, 2, "place"), ("a.json", 0, 3, "time"), ("a.json", 0, 4, "zero"),
        ("b.json", 0, None, "place"), ("b.json", 0, None, "time"), ("b.json", 0, 1, "time"), ("b.json", 0, 2, "place"), ("b.json", 1, None, "zero"), ("b.json", 2, None, "unknown"),
        ("cut.json", 0, None, "damaged"), ("empty.json", None, None, "empty"), ("none.json", None, None, "empty"), ("object.json", 0, None, "unknown"), ("odd.json", 0, None, "damaged"),
        ("gone.json", None, None, "missing"),
    ], key=str)
    assert exports.rejected(spark, [str(tmp_path / "gone.json")]).count() == 1


def test_layouts_are_sniffed_from_the_head(spark):
    bodies = [('{"semanticSegments": []}', "A"), ("  [{}]", "B"), ('{"x": "activity"}', "B"), ("{}", "?"), (" " * 500 + "[]", "?"), (None, "?")]
    docs = spark.createDataFrame(bodies, "body string, want string")
    assert docs.filter(exports.layout_of(docs.body) != docs.want).count() == 0


def test_photo_pages(spark, tmp_path):
    asset = lambda i, at, lat=50.0, make="Apple", **more: {"id": i, "fileCreatedAt": at, "exifInfo": {"latitude": lat, "longitude": 5.0, "make": make}} | more
    pages = {
        ("2023-12", 1): [asset("old", "2023-12-31T10:00:00Z")],
        ("2024-01", 1): [asset("a", "2024-01-02T10:00:00.5Z"), asset("b", "2024-01-02T11:00:00+02:00", make=None), asset("c", "never"), asset("d", None, createdAt="2024-01-03T08:00:00Z", make="samsung")],
        ("2024-01", 2): [asset("a", "2024-01-02T10:00:00.5Z"), asset("e", "2024-01-04T10:00:00Z", lat=None), asset("f", "2024-01-04T10:00:00Z", lat=0.0), asset("g", "2024-01-09T10:00:00Z")],
    }
    for (month, k), items in pages.items():
        (folder := tmp_path / "dump" / f"month={month}").mkdir(parents=True, exist_ok=True)
        _write(folder, f"{k}.json", {"assets": {"items": items, "nextPage": None}})
    found = photos.read_photo_pages(spark, str(tmp_path / "dump"), "2024-01-01", "2024-01-08")
    assert sorted((r.asset_id, r.timestamp, r.camera_make) for r in found.collect()) == [
        ("a", datetime(2024, 1, 2, 10, 0, 0, 500000), "Apple"), ("b", datetime(2024, 1, 2, 11), None), ("d", datetime(2024, 1, 3, 8), "samsung"),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    both = photos.couple_photos(found.filter("asset_id = 'd'"), found)
    assert sorted(r.asset_id for r in both.collect()) == ["a", "d"]


def test_large_files_are_hashed_by_splits(spark, tmp_path, monkeypatch):
    noise = random.Random(5).randbytes(30_000)
    bodies = {
        "noise": noise, "end": noise + b"\n", "mark": b"\xef\xbb\xbf" + noise, "mark-end": b"\xef\xbb\xbfa\r\n" + b"\xff\n" * 3000, "feeds": b"\n" * 5000,
        "line": b"\0" * 9000, "json": json.dumps(A).encode() * 20, "small": b"x", "odd [1]": noise,
    }
    for n, body in bodies.items():
        (tmp_path / n).write_bytes(body)
    (tmp_path / "packed.gz").write_bytes(gzip.compress(noise[:1900]))
    bodies["packed.gz"] = (tmp_path / "packed.gz").read_bytes()
    monkeypatch.setattr(exports, "LARGE_FILE", 1000, raising=False)
    # a task that reads a file whole fails beyond this length
    limits = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.sources.binaryFile.maxLength": "2500"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = {r.file: r.file_hash for r in exports.file_fingerprints(spark, [str(tmp_path)]).collect()}
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert got == {quote(n): hashlib.sha256(body).hexdigest()[:16] for n, body in bodies.items()}
