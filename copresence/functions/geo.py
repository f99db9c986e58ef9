"""Distances, positions and regions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copresence.config import Config

METERS_A_DEGREE = 111_320.0
#: WGS-84 semi-major axis in metres, squared eccentricity, flattening, semi-minor axis.
SEMI_MAJOR, ECCENTRICITY_2 = 6378137.0, 0.00669437999014
FLATTENING, SEMI_MINOR = 1 / 298.257223563, 6378137.0 * (1 - 1 / 298.257223563)
#: Metres below which the short formula is exact enough; iterations of the long one.
SHORT, ITERATIONS = 2000.0, 12


def planar_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos_lat: Column) -> Column:
    """Metres between two points on a plane whose longitudes are scaled by cos_lat."""
    dy, dx = (lat2 - lat1) * METERS_A_DEGREE, (lon2 - lon1) * METERS_A_DEGREE * cos_lat
    return F.sqrt(dy * dy + dx * dx)


def fast_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres, scaled at the mean latitude of the two points."""
    return planar_distance(lat1, lon1, lat2, lon2, F.cos(F.radians((lat1 + lat2) * 0.5)))


def wrapped(degrees: Column) -> Column:
    """A difference of longitudes, the short way round."""
    return F.when(degrees > 180.0, degrees - 360.0).when(degrees < -180.0, degrees + 360.0).otherwise(degrees)


def short_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the WGS-84 ellipsoid from its radii of curvature at the mean latitude: under a millimetre off below 5 km."""
    middle = F.radians((lat1 + lat2) * 0.5)
    w2 = 1.0 - ECCENTRICITY_2 * F.sin(middle) * F.sin(middle)
    w = F.sqrt(w2)
    dy = F.radians(lat2 - lat1) * (SEMI_MAJOR * (1.0 - ECCENTRICITY_2)) / (w2 * w)
    dx = F.radians(wrapped(lon2 - lon1)) * SEMI_MAJOR / w * F.cos(middle)
    return F.sqrt(dy * dy + dx * dx)


def geodesic_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the WGS-84 ellipsoid: the short formula below SHORT metres, Vincenty's inverse series beyond, under a millimetre off. Between
    points that are nearly antipodal the series has not settled after ITERATIONS and is some kilometres off."""
    near = short_distance(lat1, lon1, lat2, lon2)
    return F.when(near < SHORT, near).otherwise(_vincenty(lat1, lat2, F.radians(wrapped(lon2 - lon1))))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _named(**columns: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in columns.items()))


def _vincenty(lat1: Column, lat2: Column, dlon: Column) -> Column:
    reduced = lambda lat: F.atan((1.0 - FLATTENING) * F.tan(F.radians(lat)))
    ends = _named(s1=F.sin(reduced(lat1)), c1=F.cos(reduced(lat1)), s2=F.sin(reduced(lat2)), c2=F.cos(reduced(lat2)), dlon=dlon)

    def arc(p: Column, lam: Column, body) -> Column:
        """body of the arc between the ends on the auxiliary sphere: sine, cosine and length, azimuth and mid-point terms."""
        across, along = p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)
        sides = _named(sin=F.sqrt(across * across + along * along), cos=p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam))
        azimuth = lambda q: F.when(q["sin"] == 0, 0.0).otherwise(p["c1"] * p["c2"] * F.sin(lam) / q["sin"])
        turned = lambda q: _named(sin=q["sin"], cos=q["cos"], length=F.atan2(q["sin"], q["cos"]), az=azimuth(q), c=1.0 - azimuth(q) * azimuth(q))
        middle = lambda q: F.when(q["c"] < 1e-15, 0.0).otherwise(q["cos"] - 2.0 * p["s1"] * p["s2"] / q["c"])
        return _let(sides, lambda q: _let(turned(q), lambda t: _let(middle(t), lambda m: body(t, m))))

    def longitude(p: Column):
        def of(t: Column, m: Column) -> Column:
            k = FLATTENING / 16.0 * t["c"] * (4.0 + FLATTENING * (4.0 - 3.0 * t["c"]))
            return p["dlon"] + (1.0 - k) * FLATTENING * t["az"] * (t["length"] + k * t["sin"] * (m + k * t["cos"] * (2.0 * m * m - 1.0)))

        return of

    def metres(t: Column, m: Column) -> Column:
        u = t["c"] * (SEMI_MAJOR * SEMI_MAJOR - SEMI_MINOR * SEMI_MINOR) / (SEMI_MINOR * SEMI_MINOR)
        a = 1.0 + u / 16384.0 * (4096.0 + u * (-768.0 + u * (320.0 - 175.0 * u)))
        b = u / 1024.0 * (256.0 + u * (-128.0 + u * (74.0 - 47.0 * u)))
        inner = t["cos"] * (2.0 * m * m - 1.0) - b / 6.0 * m * (4.0 * t["sin"] * t["sin"] - 3.0) * (4.0 * m * m - 3.0)
        return SEMI_MINOR * a * (t["length"] - b * t["sin"] * (m + b / 4.0 * inner))

    steps = F.sequence(F.lit(1), F.lit(ITERATIONS))
    return _let(ends, lambda p: _let(F.aggregate(steps, p["dlon"], lambda lam, _: arc(p, lam, longitude(p))), lambda lam: arc(p, lam, metres)))


def between_positions(start: Column, end: Column, share: Column) -> Column:
    """Linear position at a share of the way, clamped to 0..1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return start + s * (end - start)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def in_home_region(lat: Column, lon: Column, config: Config) -> Column:
    return in_box(lat, lon, config.home_region)


def country(lat: Column, lon: Column, config: Config) -> Column:
    """Country label: the border box first, then boxes in the order of the settings, else 'Other'."""
    label = None
    if config.border_box:
        south, east, rest = config.border_names
        inside = F.when(lat < config.split_lat, south).when(lon > config.split_lon, east).otherwise(rest)
        label = F.when(in_box(lat, lon, config.border_box), inside)
    for name, *box in config.country_bounds:
        fits, title = in_box(lat, lon, tuple(box)), name.title()
        label = F.when(fits, title) if label is None else label.when(fits, title)
    return label.otherwise("Other") if label is not None else F.lit("Other")


def rounded(x: Column, digits: int = 3) -> Column:
    """Half-even rounding by scaling, as privacy rounding of coordinates wants it."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def parsed_coordinate(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of `geo:LAT,LON` or `LAT°, LON°`; nulls for anything else."""
    stripped = F.when(text.startswith("geo:"), F.substring(text, 5, 1 << 20)).when(text.contains("°"), F.replace(text, F.lit("°"), F.lit("")))
    parts = F.split(stripped, ",")
    number = lambda i: F.btrim(F.get(parts, F.lit(i))).try_cast("double")
    good = number(0).isNotNull() & number(1).isNotNull()
    return F.when(good, number(0)), F.when(good, number(1))
