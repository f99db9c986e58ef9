"""Operators on hand-made pings, and joins against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions.rules import MICROS_MINUTE, micros
from copresence.operators import clean, datasets, features, joins, metrics, presence
from copresence.plans.analysis import Analysis

CONFIG = Config()
START = datetime(2024, 1, 1, 12)


@pytest.fixture
def pings_of(spark):
    def make(rows):
        """rows: (person, minutes after noon of the first day, lat, lon, accuracy)."""
        data = [(i, p, START + timedelta(minutes=m), lat, lon, a) for i, (p, m, lat, lon, a) in enumerate(rows)]
        df = spark.createDataFrame(data, "ping_id long, person int, ts timestamp_ntz, lat double, lon double, accuracy int")
        return df.withColumn("us", micros(F.col("ts")))

    return make


def test_dedup_keeps_the_most_accurate_then_earliest(pings_of):
    rows = [(1, 0, 50.0, 5.0, 20), (1, 0.5, 50.0, 5.1, 10), (1, 1, 50.0, 5.2, 10), (1, 2, 50.0, 5.3, 30), (2, 0, 50.0, 5.0, 30)]
    assert sorted(r.ping_id for r in clean.dedup_2min(pings_of(rows)).collect()) == [1, 3, 4]


def test_spike_and_return_leg_are_dropped(pings_of):
    rows = [(1, 0, 50.0, 5.0, 10), (1, 5, 53.0, 5.0, 10), (1, 10, 50.0, 5.0, 10), (1, 15, 50.0, 5.0, 10)]
    assert sorted(r.ping_id for r in clean.drop_jitter(pings_of(rows)).collect()) == [0, 3]
    assert clean.drop_jitter(pings_of(rows[:2])).count() == 2


def test_segments_stop_at_18_hours(pings_of):
    rows = [(1, 0, 50.0, 5.0, 10), (1, 18 * 60, 50.0, 5.0, 10), (1, 36 * 60 + 1, 50.0, 5.0, 10)]
    assert [r.seg_id for r in clean.segments(pings_of(rows)).collect()] == [0]


def test_interpolation_leaves_out_the_last_step(pings_of):
    made = presence.interpolated(clean.tag_radius(pings_of([(1, 0, 50.0, 5.0, 10), (1, 70, 50.0, 5.0, 10)])), CONFIG).collect()
    assert [r.ts for r in made] == [START + timedelta(minutes=30)]


def test_range_join_matches_plain_python(spark):
    rng = random.Random(1)
    a, b = [rng.randrange(10_000) for _ in range(200)], [rng.randrange(10_000) for _ in range(200)]
    one, two = spark.createDataFrame([(x,) for x in a], "x long"), spark.createDataFrame([(y,) for y in b], "y long")
    joined = joins.bucketed_range_join(one, two, "x", "y", 50)
    assert sorted(map(tuple, joined.collect())) == sorted((x, y) for x in a for y in b if abs(x - y) <= 50)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interval_join_matches_plain_python(spark):
    rng = random.Random(2)
    make = lambda: [(s, s + rng.randrange(0, 400)) for s in (rng.randrange(5000) for _ in range(150))]
    a, b = make(), make()
    one, two = spark.createDataFrame(a, "s long, e long"), spark.createDataFrame(b, "p long, q long")
    joined = joins.interval_overlap_join(one, two, ("s", "e"), ("p", "q"), 100)
    want = sorted((s, e, p, q, max(s, p), min(e, q)) for s, e in a for p, q in b if max(s, p) < min(e, q))
    assert sorted(map(tuple, joined.collect())) == want


def _minute_by_minute(legs):
    """Closest match of each 15 minutes by plain loops, at home and on foot only."""
    import math

    best = {}
    ones, twos = [x for x in legs if x.person == 1], [x for x in legs if x.person == 2]
    for a in ones:
        for b in twos:
            start, end = max(a.start_us, b.start_us), min(a.end_us, b.end_us)
            for t in range(start, end + 1 if start < end else start, MICROS_MINUTE):
                at = lambda x: [x[f"start_{k}"] + (t - x.start_us) / (x.end_us - x.start_us) * (x[f"end_{k}"] - x[f"start_{k}"]) for k in ("lat", "lon")]  # noqa: B023, E731
                (la, lo), (ma, mo) = at(a), at(b)
                cos = math.cos(math.radians((a.start_lat + b.start_lat) / 2))
                d = math.hypot((ma - la) * 111_320, (mo - lo) * 111_320 * cos)
                if d <= max(a.geofence_radius + b.geofence_radius, 750):
                    key = t // (15 * MICROS_MINUTE)
                    best[key] = min(best.get(key, (1e18,)), (d, a.start_us, a.seg_id, b.start_us, b.seg_id, t))
    return best


def test_fine_overlaps_match_plain_loops(pings_of):
    rng = random.Random(3)
    rows = [(p, m + rng.random(), 50.85 + rng.random() * 0.004, 5.70 + rng.random() * 0.004, 10) for p in (1, 2) for m in range(0, 600, 40)]
    legs = clean.segments(pings_of(rows))
    want = _minute_by_minute(legs.collect())
    got = {r.bucket: (r.distance_m, r.us) for r in joins.fine_overlaps(legs, CONFIG).collect()}
    assert set(got) == set(want) and want
    for k, (d, *_, t) in want.items():
        assert got[k][0] == pytest.approx(d, abs=1e-6) and got[k][1] == t


def test_exactly_30_minutes_matches(pings_of):
    rows = [(1, 0, 50.85, 5.7, 10), (2, 30, 50.85, 5.7, 10), (2, 61, 50.85, 5.7, 10)]
    found = joins.raw_overlaps(clean.with_speed(clean.tag_radius(pings_of(rows))), CONFIG).collect()
    assert [(r.p1_ping_id, r.p2_ping_id, r.tier) for r in found] == [(0, 1, "confirmed")]


def test_overnight_stay_is_filled_hourly(pings_of):
    evening, morning = 8 * 60 + 30, 19 * 60 + 15  # 20:30 and 07:15
    rows = [(1, evening, 50.85, 5.7, 10), (1, morning, 50.85, 5.7, 10), (1, 36 * 60, 50.85, 5.7, 10)]
    pings = clean.tag_radius(pings_of(rows))
    homes = presence.home_cells(pings, CONFIG)
    stays = presence.overnight_fill(pings, homes, CONFIG)
    assert [r.ts.hour for r in stays.orderBy("us").collect()] == [21, 22, 23, 0, 1, 2, 3, 4, 5, 6]
    assert homes.collect()[0].home_lat == 50.85


def test_no_rows_give_typed_empty_results(pings_of):
    empty = Analysis(pings_of([]), CONFIG)
    assert empty.overlaps.count() == 0 and empty.raw_overlaps.count() == 0 and empty.matrix.count() == 24  # the hours of the start date
    stats = metrics.overlap_stats(empty.overlaps).first()
    assert stats.total_colocations == 0 and stats.first_day is None
    tracked = metrics.tracked_metrics(empty.filled, empty.trusted, CONFIG).first()
    assert tracked.total_tracked_days == 0 and tracked.pct_days_together == 0




def test_dedup_without_accuracies(pings_of):
    pings = pings_of([(1, 0, 50.0, 5.0, 20), (1, 0, 50.0, 5.0, 10), (1, 0, 50.0, 5.1, 10), (1, 1, 50.0, 5.0, 10), (2, 0, 50.0, 5.0, 10)]).drop("accuracy")
    kept = clean.dedup_2min(pings)
    assert kept.columns == pings.columns and sorted(r.ping_id for r in kept.collect()) == [0, 2, 3, 4]


def test_overlaps_without_radii_reach_the_city_radius(pings_of):
    """40.0 lies outside the home region, so distance alone decides; sources and made-up marks go along."""
    rows = [(1, 0, 40.0, -3.0, 10), (2, 5, 40.04, -3.0, 10), (2, 6, 40.05, -3.0, 10)]
    pings = clean.with_speed(pings_of(rows)).withColumn("source_file", F.concat(F.lit("f"), "person"))
    got = joins.raw_overlaps(pings, CONFIG).collect()
    assert [(r.p2_ping_id, r.tier, r.p1_source_file, r.p2_source_file, r.interpolated) for r in got] == [(1, "city", "f1", "f2", False)]
    marked = clean.tag_radius(pings).withColumn("interpolated", F.col("person") == 2).drop("source_file")
    assert joins.raw_overlaps(marked, CONFIG).count() == 0
    near = clean.tag_radius(clean.with_speed(pings_of([(1, 0, 40.0, -3.0, 10), (2, 5, 40.0005, -3.0, 10)]))).withColumn("interpolated", F.col("person") == 2)
    assert [(r.tier, r.p1_source_file, r.interpolated) for r in joins.raw_overlaps(near, CONFIG).collect()] == [("confirmed", "unknown", True)]


def test_sets_of_days(spark):
    dates = lambda *days: spark.createDataFrame([(datetime(2024, 1, d),) for d in days], "ts timestamp_ntz")
    one, two = metrics.days(dates(1, 2, 2, 5)), metrics.days(dates(2, 3))
    day = lambda rows: sorted(r.date.day for r in rows.collect())
    assert day(metrics.only_first(one, two)) == [1, 5] and day(metrics.either_not_both(one, two)) == [1, 3, 5] and day(one.intersect(two)) == [2]
    assert day(one.union(two).distinct()) == [1, 2, 3, 5]


def test_gap_islands(spark):
    daily = spark.createDataFrame([(datetime(2024, 1, d).date(), 0 if d in (3, 9, 10, 11, 12, 20, 21, 22) else 1) for d in range(1, 32)], "date date, n int")
    got = [(r.first_day.day, r.last_day.day) for r in datasets.gap_islands(daily, "n").collect()]
    assert got == [(9, 12)]


def test_neighbours_cross_days_and_gaps(spark, pings_of):
    from copresence.operators.sequence import with_neighbours

    rng = random.Random(4)
    rows = [(p, rng.choice([0, 1440, 1440 * 9, 1440 * 10]) + rng.randrange(1440), 50.0 + i, 5.0, 10) for p in (1, 2, 3) for i in range(30)]
    got = with_neighbours(pings_of([*rows, (4, 0, 1.0, 1.0, 10)]), ["lat"], following="n", previous="p", total="all").collect()
    for person in (1, 2, 3, 4):
        own = sorted((r for r in got if r.person == person), key=lambda r: (r.us, r.ping_id))
        assert [r.n and r.n.lat for r in own] == [*(r.lat for r in own[1:]), None] and [r.p and r.p.lat for r in own] == [None, *(r.lat for r in own[:-1])]
        assert {r["all"] for r in own} == {len(own)}


def test_runs_of_days_join_across_months_years_and_centuries(spark):
    from datetime import date

    from copresence.operators.sequence import runs_of_days

    rng, days, at = random.Random(5), set(), date(1998, 12, 1)
    for _ in range(40):
        length, off = rng.choice([1, 2, 40, 400]), rng.choice([1, 2, 30, 9000])
        days |= {at + timedelta(days=k) for k in range(length)}
        at += timedelta(days=length + off)
    ordered = sorted(days)
    want, first = set(), ordered[0]
    for a, b in zip(ordered, [*ordered[1:], None]):
        if b is None or (b - a).days > 1:
            want.add((first, a))
            first = b
    found = runs_of_days(spark.createDataFrame([(d,) for d in [*ordered, *ordered[:9], None]], "date date"))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and max(d.year for d in days) > 2100
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = runs_of_days(spark.createDataFrame([(date(2024, 1, 1),)], "date date"))._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Window" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_distances_of_pairs_are_computed_once(spark, pings_of):
    rows = clean.with_speed(clean.tag_radius(pings_of([(p, m, 50.0, 5.0, 10) for p in (1, 2) for m in (0, 50)])))
    plan = joins.raw_overlaps(rows.select("person", "ping_id", "us", "lat", "lon", "geofence_radius", F.lit(0.0).alias("speed_kmh")), CONFIG)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_positions_on_legs_are_computed_once(pings_of):
    rows = [(p, m + p, 50.0 + m * 0.0001, 5.0, 10) for p in (1, 2) for m in range(0, 60, 10)]
    matches = joins.fine_matches(clean.segments(pings_of(rows)), CONFIG)
    plan = matches._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("greatest(0.0, least(1.0") == 4 and plan.count("111320.0) * cos_lat") <= 2
    assert matches.count() > 0


def test_hours_of_features_are_counted_without_a_shuffle_of_their_own(pings_of):
    rows = [(1, m, 50.0, 5.0, 10) for m in (0, 5, 61, 62, 400)] + [(2, m, 50.0, 5.0, 10) for m in (0, 59)]
    pings = pings_of(rows)
    found = features.day_features(pings, joins.fine_overlaps(clean.segments(pings), CONFIG))
    day = found.first()
    assert (day.p1_hours_covered, day.p2_hours_covered, day.overlap_hours_span) == (3, 1, 1)
    assert (found.schema["p1_hours_covered"].dataType.simpleString(), found.schema["overlap_hours_span"].dataType.simpleString()) == ("bigint", "bigint")
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString()
