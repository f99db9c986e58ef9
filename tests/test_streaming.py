"""Streams against the batch operators: replayed in order they give the same rows, late rows are dropped, and state expires."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions.rules import MICROS_HOUR, micros
from copresence.operators import clean, datasets, joins, matrix, presence
from copresence.streaming import colocation, run, sequence

CONFIG = Config()
START = datetime(2024, 1, 1, 12)
DAY = 24 * MICROS_HOUR


@pytest.fixture(autouse=True)
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    sequence.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def _pings(spark, rows):
    """rows: (person, minutes after the start, lat, lon)."""
    data = [(i, p, START + timedelta(minutes=m), lat, lon, 10) for i, (p, m, lat, lon) in enumerate(rows)]
    return spark.createDataFrame(data, "ping_id long, person int, ts timestamp_ntz, lat double, lon double, accuracy int").withColumn("us", micros(F.col("ts")))


def _walk(seed, n=150):
    """Two persons near each other with stays, moves, leaps, nights at home and days without reports."""
    rng, rows = random.Random(seed), []
    for person in (1, 2):
        m = person
        for _ in range(n):
            far = rng.random()
            spot = (53.0, 5.0) if far < 0.05 else (50.0 + rng.choice([0, 0.0003, 0.003]), 5.0 + rng.choice([0, 0.0004, 0.02]))
            rows.append((person, m, *spot))
            m += rng.choice([3, 7, 20, 45, 70, 300, 700]) if rng.random() < 0.98 else 19 * 60
    return rows


def _streamed(rows, hours):
    """A replayed table of pings with a heartbeat of nobody's."""
    read = rows.withColumn("ts", F.timestamp_micros("us"))
    return run.replayed(read, parts=2, heartbeat=({"person": 0, "ping_id": -1, "lat": 0.0, "lon": 0.0}, hours * MICROS_HOUR)).withColumn("ts", F.timestamp_micros("us"))


def _same(found, want, *drop):
    columns = [c for c in want.columns if c not in drop]
    tidy = lambda df: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)
    one, two = tidy(found), tidy(want)
    assert one == two and one


@pytest.mark.parametrize("seed", [1])
def test_legs_speeds_and_presence_are_those_of_the_batch(spark, seed):
    rows = _pings(spark, _walk(seed))
    kept = clean.drop_jitter(rows)
    assert kept.count() < rows.count()
    _same(run.drained(sequence.legs_stream(_streamed(rows, 30), CONFIG, drop_leaps=True)), clean.segments(kept))
    _same(run.drained(sequence.speed_stream(_streamed(kept, 30))).select("person", "ping_id", "speed_kmh"), clean.with_speed(kept).select("person", "ping_id", "speed_kmh"))
    _same(run.drained(sequence.presence_stream(_streamed(kept, 30), CONFIG)), presence.interpolated(kept, CONFIG))


def test_overnight_stays_are_those_of_the_batch(spark):
    rows = _pings(spark, [(p, 60 * 24 * d + m, 50.0, 5.0 + p / 10) for p in (1, 2) for d in range(4) for m in (0, 480 + 10 * d, 1140)])
    homes = spark.createDataFrame([(1, 50.0, 5.1), (2, 50.0, 5.2)], "person int, home_lat double, home_lon double")
    _same(run.drained(sequence.overnight_stream(_streamed(rows, 30), homes, CONFIG)), presence.overnight_fill(rows, homes, CONFIG))


def _fed(spark, tmp_path, build, batches, schema):
    """Rows of a stream that gets one batch at a time, and what its state held after each."""
    path, sizes = str(tmp_path / "in"), []
    spark.createDataFrame([], schema).write.parquet(path)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        stream = build(spark.readStream.schema(schema).parquet(path))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        ops = query.lastProgress["stateOperators"]
        sizes.append((sum(o["numRowsTotal"] for o in ops), sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])))
    return spark.read.parquet(out), sizes


PING = "person int, ping_id long, ts timestamp, lat double, lon double, speed_kmh double"


def test_pairs_expire_and_late_pings_are_dropped(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, 0) + timedelta(hours=h, minutes=m)
    near = lambda p, i, h, m=0: (p, i, at(h, m), 50.0, 5.0, 0.0)
    batches = [
        [near(1, 1, 10), near(2, 2, 10, 20), near(2, 3, 10, 31)],
        [near(1, 4, 40), near(2, 5, 40, 10)],
        [near(2, 6, 10, 5), near(2, 7, 40, 30), near(2, 8, 39, 20)],  # the first is a day late, the last within the hour
        [near(1, 9, 90), near(2, 10, 90)],
    ]
    found, sizes = _fed(spark, tmp_path, lambda s: colocation.raw_overlaps_stream(s, CONFIG, "1 hour"), batches, PING)
    assert sorted((r.p1_ping_id, r.p2_ping_id) for r in found.collect()) == [(1, 2), (4, 5), (4, 7), (9, 10)]
    assert sizes[2][1] > 0  # dropped by the watermark
    assert sizes[-1][0] <= 8  # three buckets of one side, one of the other, and no older pings


def test_late_pings_do_not_change_legs_that_are_out(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, 0) + timedelta(hours=h, minutes=m)
    ping = lambda i, h, m=0: (1, i, at(h, m), 50.0, 5.0, 0.0)
    batches = [[ping(2, 10, 30), ping(1, 10)], [ping(3, 14), ping(4, 13, 30)], [ping(5, 10, 15), ping(6, 12, 50)], [ping(7, 60)], [ping(8, 90)]]
    found, sizes = _fed(spark, tmp_path, lambda s: sequence.legs_stream(s, CONFIG, "2 hours"), batches, PING)
    # 6 came within the two hours and finds its place; 5 came too late
    assert sorted((r.seg_id, (r.end_us - r.start_us) // 60_000_000) for r in found.collect()) == [(1, 30), (2, 140), (4, 30), (6, 40)]
    assert sizes[-1][0] <= 4


def test_raw_overlaps_and_closest_matches_are_those_of_the_batch(spark):
    rows = clean.with_speed(clean.tag_radius(_pings(spark, _walk(3, 120))))
    streamed = run.replayed(rows.withColumn("ts", F.timestamp_micros("us")))
    _same(run.drained(colocation.raw_overlaps_stream(streamed, CONFIG)), joins.raw_overlaps(rows, CONFIG))
    legs = clean.segments(rows)
    matches = run.drained(colocation.fine_matches_stream(run.replayed(legs, at="end_us"), CONFIG))
    _same(matches, joins.fine_matches(legs, CONFIG))
    late = ({}, 40 * MICROS_HOUR)
    closest = run.drained(colocation.closest_stream(run.replayed(matches, heartbeat=late)))
    want = joins.closest_per_bucket(joins.fine_matches(legs, CONFIG))
    _same(closest, want)
    hours = run.drained(colocation.best_per_hour_stream(run.replayed(want, heartbeat=late)))
    best = matrix.best_per_hour(want, CONFIG)
    assert {(r.date, r.hour) for r in hours.collect()} == {(r.date, r.hour) for r in best.collect()}


@pytest.mark.parametrize("least", [1, 4])
def test_gaps_between_spells_are_those_of_the_batch(spark, least):
    rng = random.Random(least)
    days, d = [], 0
    for _ in range(40):
        days.append(d)
        d += rng.choice([1, 1, 2, 4, 5, 6, 9])
    rows = _pings(spark, [(1, 1440 * x + rng.choice([0, 700]), 50.0, 5.0) for x in days])
    spells = run.drained(colocation.spells_stream(_streamed(rows, 24 * 30), least)).filter("person = 1")
    daily = spark.createDataFrame([(START.date() + timedelta(days=x), int((START + timedelta(days=x)).date() in {r.ts.date() for r in rows.collect()})) for x in range(0, days[-1] + 1)], "date date, n int")
    _same(colocation.gaps_between(spells, least).select("first_day", "last_day"), datasets.gap_islands(daily, "n", least))


def test_a_second_ping_that_leaps_waits_for_a_third(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, 0) + timedelta(hours=h, minutes=m)
    near, far = (lambda p, i, h, m=0: (p, i, at(h, m), 50.0, 5.0, 0.0)), (lambda p, i, h, m=0: (p, i, at(h, m), 58.0, 5.0, 0.0))
    batches = [[near(1, 1, 10), far(1, 2, 10, 5), near(2, 3, 10), far(2, 4, 10, 5), far(2, 5, 10, 10)], [near(3, 6, 60)]]
    found, _ = _fed(spark, tmp_path, lambda s: sequence.legs_stream(s, CONFIG, "1 hour", drop_leaps=True), batches, PING)
    assert sorted((r.person, r.seg_id) for r in found.collect()) == [(1, 1), (2, 3)]
    assert {r.end_us for r in found.filter("person = 2").collect()} == {r.end_us + 5 * 60_000_000 for r in found.filter("person = 1").collect()}
