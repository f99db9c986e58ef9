"""Boundaries of the scalar rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from copresence.config import Config, from_mapping
from copresence.functions import geo, rules

CONFIG = Config()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "km, hours, kind",
    [(0.5, 1, "stationary"), (7, 1, "walking"), (150, 1, "driving"), (151, 1, "flying"), (1000.1 * 29 / 60, 29 / 60, "jitter"), (1000.1 / 2, 0.5, "flying"), (5, 0, "stationary"), (5, -1, "stationary")],
)
def test_movement(spark, km, hours, kind):
    assert value(spark, rules.movement(F.lit(km * 1000.0), F.lit(float(hours)))) == kind


@pytest.mark.parametrize("metres, tier", [(150.0, "confirmed"), (150.1, "neighborhood"), (750.0, "neighborhood"), (751.0, "city"), (5000.0, "city"), (5001.0, "geofence")])
def test_tiers(spark, metres, tier):
    assert value(spark, rules.fine_tier(F.lit(metres), CONFIG)) == tier
    assert value(spark, rules.raw_tier(F.lit(metres), CONFIG)) == ("city" if tier == "geofence" else tier)


@pytest.mark.parametrize("hour, night", [(22, True), (21, False), (6, True), (7, False), (0, True)])
def test_night(spark, hour, night):
    assert value(spark, rules.is_night(F.lit(hour))) is night


@pytest.mark.parametrize(
    "text, want",
    [("geo:50.85,5.70", (50.85, 5.70)), ("50.85°, 5.70°", (50.85, 5.70)), ("-1.5°, -2.25°", (-1.5, -2.25)), ("50.85,5.70", (None, None)), ("geo:x,5", (None, None)), ("geo:5", (None, None)), ("", (None, None)), (None, (None, None))],
)
def test_coordinates(spark, text, want):
    lat, lon = geo.parsed_coordinate(F.lit(text).cast("string"))
    assert (value(spark, lat), value(spark, lon)) == want


def test_distances(spark):
    points = [F.lit(x) for x in (50.0, 5.0, 50.001, 5.001)]
    cos = math.cos(math.radians(50.0005))
    assert value(spark, geo.fast_distance(*points)) == pytest.approx(math.hypot(111.32, 111.32 * cos))
    assert value(spark, geo.geodesic_distance(*points)) == pytest.approx(132.3, abs=0.5)


def _meridian(a, b, steps=200_000):
    """Metres along a meridian of the ellipsoid, by the midpoint rule."""
    f = 1 / 298.257223563
    e2, h = f * (2 - f), math.radians(b - a) / steps
    return abs(sum(6378137.0 * (1 - e2) / (1 - e2 * math.sin(math.radians(a) + (i + 0.5) * h) ** 2) ** 1.5 for i in range(steps)) * h)


@pytest.mark.parametrize("points, metres, off", [
    ((40.6, -73.8, 51.6, -0.5), 5551759.400, 1e-2),  # a published example
    ((-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600, -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600), 54972.271, 1e-2),  # another
    ((0.0, 10.0, 0.0, 11.0), 6378137.0 * math.pi / 180, 1e-3), ((0.0, 179.5, 0.0, -179.5), 6378137.0 * math.pi / 180, 1e-3),
    ((50.0, 7.0, 50.001, 7.0), _meridian(50.0, 50.001), 1e-4), ((41.0, 7.0, 50.0, 7.0), _meridian(41.0, 50.0), 1e-3), ((50.0, 7.0, 50.02, 7.0), _meridian(50.0, 50.02), 1e-4),
    ((50.0, 5.0, 50.0, 5.0), 0.0, 0),
])
def test_geodesic_against_other_sources(spark, points, metres, off):
    assert value(spark, geo.geodesic_distance(*map(F.lit, points))) == pytest.approx(metres, abs=off)


def test_geodesic_over_the_antimeridian_and_at_the_seam(spark):
    at = lambda *p: value(spark, geo.geodesic_distance(*map(F.lit, p)))
    assert at(50.0, 179.999, 50.0, -179.999) == pytest.approx(at(50.0, 0.0, 50.0, 0.002), abs=1e-6) and at(50.0, 179.999, 50.0, -179.999) == pytest.approx(143.4, abs=0.2)
    places = [F.lit(x) for x in (50.0, 5.0, 50.01, 5.02)]
    assert value(spark, geo.short_distance(*places)) == pytest.approx(value(spark, geo._vincenty(places[0], places[2], F.radians(F.lit(0.02)))), abs=1e-3)


def test_country_titles(spark):
    config = Config(country_bounds=(("your_country", 0.0, 10.0, 0.0, 10.0), ("new zealand", 20.0, 30.0, 0.0, 10.0)), border_box=None)
    assert [value(spark, geo.country(F.lit(x), F.lit(5.0), config)) for x in (5.0, 25.0, 50.0)] == ["Your_Country", "New Zealand", "Other"]


@pytest.mark.parametrize("lat, lon, name", [(50.72, 5.8, "Belgium"), (50.9, 6.05, "Germany"), (50.9, 5.7, "Netherlands (South Limburg)"), (52.0, 5.0, "Netherlands"), (40.4, -3.7, "Spain"), (0.0, 0.0, "Other")])
def test_country(spark, lat, lon, name):
    assert value(spark, geo.country(F.lit(lat), F.lit(lon), CONFIG)) == name


@pytest.mark.parametrize("x", [50.985, 2.345, 1.005, -2.345, 0.125, 5.704999])
def test_rounding_is_numpys(spark, x):
    assert value(spark, geo.rounded(F.lit(x), 2)) == np.round(x, 2)


def test_probability_and_decay(spark):
    ladder = [value(spark, rules.base_probability(F.lit(d), F.lit(100.0), CONFIG, 0.3)) for d in (100.0, 150.0, 750.0, 5000.0, 5000.1)]
    assert ladder == [1.0, 0.95, 0.8, 0.5, 0.3]
    assert value(spark, rules.base_probability(F.lit(9999.0), F.lit(100.0), CONFIG, None)) is None
    assert [value(spark, rules.decay(F.lit(h), 2.0)) for h in (0.0, 1.0, 3.0)] == [1.0, 0.5, 0.0]


def test_small_rules(spark):
    assert [value(spark, rules.label_to_binary(F.lit(x))) for x in ("apart", "together", "mixed")] == [0, 1, 1]
    assert value(spark, rules.title_of(F.lit("first_meeting"))) == "First Meeting"
    assert [value(spark, rules.is_phone_camera(F.lit(x).cast("string"))) for x in ("Apple", "canon", None)] == [True, False, False]
    assert [value(spark, rules.accuracy_radius(F.lit(a))) for a in (10, 15, 20, 30, 99)] == [75, 100, 150, 200, 150]
    ts = F.expr("TIMESTAMP_NTZ '2024-02-29 13:14:15.123456'")
    assert str(value(spark, rules.from_micros(rules.micros(ts)))) == "2024-02-29 13:14:15.123456"
    assert str(value(spark, rules.from_micros(F.lit(-1)))) == "1969-12-31 23:59:59.999999"


def test_config_from_mapping():
    raw = {
        "start_date": "2025-01-01", "key_dates": {"first_meeting": "2025-01-15"}, "thresholds": {"distance_meters": 120},
        "interpolation": {"overnight_hours": {"start": 23, "end": 5}}, "country_bounds": {"here": {"border": [1, 2, 3, 4], "general": [1, 5, 3, 9]}, "there": [5, 6, 7, 8]},
    }
    config = from_mapping(raw)
    assert (config.start_date, config.first_meeting, config.distance_m, config.neighborhood_m) == ("2025-01-01", "2025-01-15", 120, 750)
    assert (config.night_from, config.night_to, config.border_box) == (23, 5, (1, 2, 3, 4))
    assert config.country_bounds == (("here", 1, 5, 3, 9), ("there", 5, 6, 7, 8))
