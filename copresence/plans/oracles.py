"""DuckDB SQL of the registered queries: a chain of named steps, and one select a query on top of those it needs.

Written from the description of each operator and not from the Spark plans: theta joins in place of bucketed ones, window functions
in place of combined minima.
"""

from __future__ import annotations

from copresence.sources.pings import PINGS_SQL

DEDUP_COLUMNS = "ping_id, person, ts, us, accuracy, lat, lon"


def _fast(a: str, b: str, x: str, y: str) -> str:
    cosine = f"cos(radians(({a} + {x}) * 0.5::DOUBLE))"
    return f"sqrt(pow(({x} - {a}) * 111320.0::DOUBLE, 2) + pow(({y} - {b}) * 111320.0::DOUBLE * {cosine}, 2))"


def _short(a: str, b: str, x: str, y: str) -> str:
    phi = f"radians(({a} + {x}) * 0.5::DOUBLE)"
    w = f"sqrt(1.0::DOUBLE - 0.00669437999014::DOUBLE * sin({phi}) * sin({phi}))"
    north = f"radians({x} - {a}) * (6378137.0::DOUBLE * (1.0::DOUBLE - 0.00669437999014::DOUBLE)) / ({w} * {w} * {w})"
    east = f"radians({y} - {b}) * 6378137.0::DOUBLE / {w} * cos({phi})"
    return f"sqrt(pow({north}, 2) + pow({east}, 2))"


def _geodesic(a: str, b: str, x: str, y: str) -> str:
    """Short distances by radii of curvature, long ones by Vincenty's formulae as published (Survey Review 1975), ten iterations."""
    f, major = "(1.0::DOUBLE / 298.257223563::DOUBLE)", "6378137.0::DOUBLE"
    minor = f"({major} * (1.0::DOUBLE - {f}))"
    u = lambda lat: f"atan((1.0::DOUBLE - {f}) * tan(radians({lat})))"
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"

    def sphere(lam: str, body: str) -> str:
        """body over s: {ss, cs} and t: {sigma, sa, ca2} and m: cos of twice the mid angle."""
        s = f"{{ss: sqrt(pow(cos(p.u2) * sin({lam}), 2) + pow(cos(p.u1) * sin(p.u2) - sin(p.u1) * cos(p.u2) * cos({lam}), 2)), cs: sin(p.u1) * sin(p.u2) + cos(p.u1) * cos(p.u2) * cos({lam})}}"
        sa = f"CASE WHEN s.ss = 0 THEN 0.0::DOUBLE ELSE cos(p.u1) * cos(p.u2) * sin({lam}) / s.ss END"
        t = f"{{sigma: atan2(s.ss, s.cs), sa: {sa}, ca2: 1.0::DOUBLE - pow({sa}, 2)}}"
        m = "CASE WHEN t.ca2 < 1e-15::DOUBLE THEN 0.0::DOUBLE ELSE s.cs - 2.0::DOUBLE * sin(p.u1) * sin(p.u2) / t.ca2 END"
        return let(s, "s", let(t, "t", let(m, "m", body)))

    c = f"({f} / 16.0::DOUBLE * t.ca2 * (4.0::DOUBLE + {f} * (4.0::DOUBLE - 3.0::DOUBLE * t.ca2)))"
    step = f"p.l + (1.0::DOUBLE - {c}) * {f} * t.sa * (t.sigma + {c} * s.ss * (m + {c} * s.cs * (2.0::DOUBLE * m * m - 1.0::DOUBLE)))"
    q = f"(t.ca2 * (pow({major}, 2) - pow({minor}, 2)) / pow({minor}, 2))"
    big_a = f"(1.0::DOUBLE + {q} / 16384.0::DOUBLE * (4096.0::DOUBLE + {q} * (-768.0::DOUBLE + {q} * (320.0::DOUBLE - 175.0::DOUBLE * {q}))))"
    big_b = f"({q} / 1024.0::DOUBLE * (256.0::DOUBLE + {q} * (-128.0::DOUBLE + {q} * (74.0::DOUBLE - 47.0::DOUBLE * {q}))))"
    rest = f"s.cs * (2.0::DOUBLE * m * m - 1.0::DOUBLE) - {big_b} / 6.0::DOUBLE * m * (4.0::DOUBLE * s.ss * s.ss - 3.0::DOUBLE) * (4.0::DOUBLE * m * m - 3.0::DOUBLE)"
    length = f"{minor} * {big_a} * (t.sigma - {big_b} * s.ss * (m + {big_b} / 4.0::DOUBLE * ({rest})))"
    turn = f"CASE WHEN {y} - {b} > 180 THEN {y} - {b} - 360 WHEN {y} - {b} < -180 THEN {y} - {b} + 360 ELSE {y} - {b} END"
    settled = f"list_reduce(list_concat([p.l], list_transform(range(10), lambda i: 0.0::DOUBLE)), lambda g, i: {sphere('g', step)})"
    whole = let(f"{{u1: {u(a)}, u2: {u(x)}, l: radians({turn})}}", "p", let(settled, "g", sphere("g", length)))
    near = _short(a, b, x, y)
    return f"CASE WHEN {near} < 2000 THEN {near} ELSE {whole} END"


def _home(lat: str, lon: str) -> str:
    return f"({lat} BETWEEN 47.0 AND 55.0 AND {lon} BETWEEN 2.5 AND 15.0)"


def _cell(x: str, digits: int) -> str:
    scale = 10**digits
    return f"round_even({x} * {scale}.0::DOUBLE, 0) / {scale}.0::DOUBLE"


def _country(lat: str, lon: str) -> str:
    boxes = (
        ("Netherlands", 50.75, 53.55, 3.36, 7.23), ("Belgium", 49.50, 51.51, 2.54, 6.41), ("Germany", 47.27, 55.06, 5.87, 15.04),
        ("Spain", 36.0, 43.8, -9.3, 3.3), ("France", 41.33, 51.09, -5.14, 9.56),
    )
    whens = " ".join(f"WHEN {lat} BETWEEN {a} AND {b} AND {lon} BETWEEN {x} AND {y} THEN '{n}'" for n, a, b, x, y in boxes)
    border = f"CASE WHEN {lat} < 50.75 THEN 'Belgium' WHEN {lon} > 6.0 THEN 'Germany' ELSE 'Netherlands (South Limburg)' END"
    return f"CASE WHEN {lat} BETWEEN 50.7 AND 51.1 AND {lon} BETWEEN 5.5 AND 6.1 THEN {border} {whens} ELSE 'Other' END"


def _movement(dist: str, gap: str) -> str:
    v = f"({dist} / 1000.0::DOUBLE / {gap})"
    return (
        f"CASE WHEN {gap} <= 0 THEN 'stationary' WHEN {v} > 1000 AND {gap} < 0.5 THEN 'jitter' WHEN {v} <= 0.5 THEN 'stationary' "
        f"WHEN {v} <= 7 THEN 'walking' WHEN {v} <= 150 THEN 'driving' ELSE 'flying' END"
    )


def _radius(kind: str) -> str:
    return f"CASE {kind} WHEN 'stationary' THEN 50.0 WHEN 'walking' THEN 100.0 WHEN 'driving' THEN 500.0 WHEN 'jitter' THEN 50.0 END::DOUBLE"


def _legs(source: str, keep: str = "") -> str:
    part = f"{keep}person" if not keep else f"{keep}, person"
    return f"""SELECT *, {_radius("movement")} AS geofence_radius FROM (
  SELECT *, CASE WHEN gap_h > 0 THEN dist_m / 1000.0::DOUBLE / gap_h ELSE 0.0 END::DOUBLE AS speed_kmh, {_movement("dist_m", "gap_h")} AS movement FROM (
    SELECT *, (end_us - start_us) / 3600000000.0::DOUBLE AS gap_h, {_fast("start_lat", "start_lon", "end_lat", "end_lon")} AS dist_m FROM (
      SELECT {part}, ping_id AS seg_id, us AS start_us, lat AS start_lat, lon AS start_lon,
        lead(us) OVER w AS end_us, lead(lat) OVER w AS end_lat, lead(lon) OVER w AS end_lon
      FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY us, ping_id)
    ) WHERE end_us IS NOT NULL
  ) WHERE gap_h <= 18
)"""


def _at(side: str, what: str, t: str = "t") -> str:
    share = f"CASE WHEN {side}.end_us > {side}.start_us THEN ({t} - {side}.start_us)::DOUBLE / ({side}.end_us - {side}.start_us)::DOUBLE ELSE 0.0 END"
    return f"{side}.start_{what} + greatest(0.0::DOUBLE, least(1.0::DOUBLE, {share})) * ({side}.end_{what} - {side}.start_{what})"


NIGHT = "(hour(ts) >= 22 OR hour(ts) <= 6)"
DAY = "CAST(ts AS DATE)"
TS = "make_timestamp(us) AS ts"

STEPS = {
    "pings": f"SELECT *, epoch_us(ts) AS us FROM ({PINGS_SQL.format(events='events')}) p",
    "usable": "SELECT * FROM pings WHERE ts >= TIMESTAMP '2024-01-01' AND lat <> 0 AND lon <> 0",
    "dedup": f"""SELECT {DEDUP_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY person, us // 120000000 ORDER BY accuracy, us, ping_id) AS k FROM usable) WHERE k = 1""",
    "clean": f"""SELECT {DEDUP_COLUMNS} FROM (
  SELECT *, {_fast("pa", "po", "lat", "lon")} AS d FROM (
    SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, (us - lag(us) OVER w) / 3600000000.0::DOUBLE AS g
    FROM dedup WINDOW w AS (PARTITION BY person ORDER BY us, ping_id))
) WHERE NOT coalesce(g > 0 AND g < 0.5 AND d / 1000.0::DOUBLE / g > 1000, FALSE)""",
    "tagged": f"""SELECT {DEDUP_COLUMNS}, CASE accuracy WHEN 10 THEN 75.0 WHEN 15 THEN 100.0 WHEN 20 THEN 150.0 WHEN 30 THEN 200.0 ELSE 150.0 END::DOUBLE AS geofence_radius,
  FALSE AS interpolated, NULL::VARCHAR AS interp_type, NULL::DOUBLE AS interp_speed_kmh FROM clean""",
    "speeds": f"""SELECT *, CASE WHEN g > 0 AND g < 2 THEN d / 1000.0::DOUBLE / g ELSE 0.0 END::DOUBLE AS speed_kmh FROM (
  SELECT *, {_geodesic("lat", "lon", "na", "no")} AS d FROM (
    SELECT *, lead(lat) OVER w AS na, lead(lon) OVER w AS no, (lead(us) OVER w - us) / 3600000000.0::DOUBLE AS g
    FROM tagged WINDOW w AS (PARTITION BY person ORDER BY us, ping_id)))""",
    "homes": f"""SELECT person, la AS home_lat, lo AS home_lon FROM (
  SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, la, lo) AS k FROM (
    SELECT person, {_cell("lat", 2)} AS la, {_cell("lon", 2)} AS lo, count(*) AS n FROM tagged WHERE {NIGHT} GROUP BY ALL)) WHERE k = 1""",
    "homes3": f"""SELECT person, la AS home_lat, lo AS home_lon FROM (
  SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, la, lo) AS k, sum(n) OVER (PARTITION BY person) AS total FROM (
    SELECT person, {_cell("lat", 3)} AS la, {_cell("lon", 3)} AS lo, count(*) AS n FROM tagged WHERE {NIGHT} GROUP BY ALL)) WHERE k = 1 AND total >= 5""",
    "stays": f"""SELECT person, unnest(generate_series((us // 3600000000 + 1) * 3600000000, (n_us // 3600000000) * 3600000000 - 1, 3600000000)) AS us, home_lat, home_lon FROM (
  SELECT *, lead(us) OVER w AS n_us, lead(ts) OVER w AS n_ts, lead(lat) OVER w AS na, lead(lon) OVER w AS no
  FROM tagged WINDOW w AS (PARTITION BY person ORDER BY us, ping_id)
) JOIN homes USING (person)
WHERE hour(ts) >= 19 AND hour(n_ts) <= 10 AND n_ts::DATE > ts::DATE AND n_us - us <= 16 * 3600000000
  AND {_fast("lat", "lon", "home_lat", "home_lon")} <= 300 AND {_fast("na", "no", "home_lat", "home_lon")} <= 300""",
    "overnight": f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY person, us, lat, lon ORDER BY ping_id) AS k FROM (
  SELECT * FROM tagged UNION ALL
  SELECT 1152921504606846976 + us // 1000000, person, {TS}, us, 50, home_lat, home_lon, 50.0, TRUE, 'overnight', NULL FROM stays)) WHERE k = 1""",
    "legs": _legs("overnight"),
    "made": """SELECT person, us, start_lat + s * (end_lat - start_lat) AS lat, start_lon + s * (end_lon - start_lon) AS lon, movement, geofence_radius, speed_kmh FROM (
  SELECT *, (us - start_us)::DOUBLE / (end_us - start_us)::DOUBLE AS s FROM (
    SELECT *, start_us + k * step AS us FROM (
      SELECT *, unnest(generate_series(1, (end_us - start_us) // step - 1)) AS k FROM (
        SELECT *, CASE movement WHEN 'stationary' THEN 30 WHEN 'walking' THEN 15 ELSE 60 END * 60000000::BIGINT AS step FROM legs
        WHERE gap_h >= 0.5 AND movement IN ('stationary', 'walking', 'driving')))
  ) WHERE us < end_us)""",
    "filled": f"""SELECT * FROM overnight UNION ALL
  SELECT 1152921504606846976 + us // 1000000, person, {TS}, us, CASE movement WHEN 'stationary' THEN 50 ELSE 100 END, lat, lon, geofence_radius, TRUE, movement, speed_kmh FROM made""",
    "rawov": f"""SELECT p1_ping_id, p2_ping_id, us, {TS}, lat, lon, d AS distance_m,
  CASE WHEN d <= 150 THEN 'confirmed' WHEN d <= 750 THEN 'neighborhood' ELSE 'city' END AS tier FROM (
  SELECT a.ping_id AS p1_ping_id, b.ping_id AS p2_ping_id, a.us, (a.lat + b.lat) / 2 AS lat, (a.lon + b.lon) / 2 AS lon, a.speed_kmh AS s1, b.speed_kmh AS s2,
    a.geofence_radius + b.geofence_radius AS reach, {_country("a.lat", "a.lon")} AS country, {_short("a.lat", "a.lon", "b.lat", "b.lon")} AS d
  FROM speeds a JOIN speeds b ON a.person = 1 AND b.person = 2 AND abs(a.us - b.us) <= 1800000000
) WHERE d <= reach AND NOT (d > 150 AND (country LIKE '%Netherlands%' OR country LIKE '%Belgium%' OR country LIKE '%Germany%')
  AND (((s1 > 20 OR s2 > 20) AND (s1 < 2 OR s2 < 2)) OR d > 750 OR NOT (s1 < 7 AND s2 < 7)))""",
    "pairs": """SELECT a, b, greatest(a.start_us, b.start_us) AS s, least(a.end_us, b.end_us) AS e
  FROM legs a JOIN legs b ON a.person = 1 AND b.person = 2 AND a.start_us < b.end_us AND b.start_us < a.end_us AND greatest(a.start_us, b.start_us) < least(a.end_us, b.end_us)""",
    "checked": f"""SELECT * FROM (
  SELECT *, a.geofence_radius + b.geofence_radius AS reach,
    CASE WHEN (a.movement = 'driving' OR b.movement = 'driving') AND NOT {_home("(a.start_lat + b.start_lat) * 0.5::DOUBLE", "(a.start_lon + b.start_lon) * 0.5::DOUBLE")}
      THEN 2000.0 ELSE 750.0 END AS ctx
  FROM pairs WHERE a.geofence_radius IS NOT NULL AND b.geofence_radius IS NOT NULL
) WHERE least({_fast("a.start_lat", "a.start_lon", "b.start_lat", "b.start_lon")}, {_fast("a.end_lat", "a.end_lon", "b.end_lat", "b.end_lon")})
  <= greatest(ctx, reach) + a.dist_m + b.dist_m""",
    "grid": f"""SELECT *, sqrt(pow((lat2 - lat1) * 111320.0::DOUBLE, 2)
    + pow((lon2 - lon1) * 111320.0::DOUBLE * cos(radians((a.start_lat + b.start_lat) * 0.5::DOUBLE)), 2)) AS d FROM (
  SELECT *, {_at("a", "lat")} AS lat1, {_at("a", "lon")} AS lon1, {_at("b", "lat")} AS lat2, {_at("b", "lon")} AS lon2
  FROM (SELECT *, unnest(generate_series(s, e, 60000000)) AS t FROM checked))""",
    "matched": f"""SELECT *, (lat1 + lat2) * 0.5::DOUBLE AS lat, (lon1 + lon2) * 0.5::DOUBLE AS lon FROM grid WHERE (d <= reach OR d <= ctx)
  AND NOT (d > 150 AND {_home("(lat1 + lat2) * 0.5::DOUBLE", "(lon1 + lon2) * 0.5::DOUBLE")} AND (
    ((a.movement = 'driving' OR b.movement = 'driving') AND (a.movement = 'stationary' OR b.movement = 'stationary')) OR d > 750
    OR NOT (a.movement IN ('stationary', 'walking') AND b.movement IN ('stationary', 'walking'))))""",
    "fine": """SELECT t // 900000000 AS bucket, t AS us, make_timestamp(t) AS ts, lat, lon, d AS distance_m,
  CASE WHEN d <= 150 THEN 'confirmed' WHEN d <= 750 THEN 'neighborhood' WHEN d <= 5000 THEN 'city' ELSE 'geofence' END AS tier,
  a.geofence_radius AS p1_geofence, b.geofence_radius AS p2_geofence, a.movement AS p1_movement, b.movement AS p2_movement, d <= reach AS geofence_match
FROM (SELECT *, row_number() OVER (PARTITION BY t // 900000000 ORDER BY d, a.start_us, a.seg_id, b.start_us, b.seg_id, t) AS k FROM matched) WHERE k = 1""",
    "trust": f"SELECT * FROM fine WHERE tier = 'confirmed' OR NOT {_home('lat', 'lon')}",
    "spine": "SELECT unnest(generate_series(DATE '2024-01-01', (SELECT max(ts)::DATE FROM filled), INTERVAL 1 DAY))::DATE AS date",
    "hourspine": "SELECT unnest(generate_series(DATE '2024-01-01', (SELECT max(ts)::DATE FROM fine), INTERVAL 1 DAY))::DATE AS date",
    "known": f"SELECT {DAY} AS date, bool_or(person = 1) AS d1, bool_or(person = 2) AS d2, bool_or(person = 1 AND {NIGHT}) AS n1, bool_or(person = 2 AND {NIGHT}) AS n2 FROM filled GROUP BY 1",
    "hours": f"SELECT {DAY} AS date, hour(ts) AS hour FROM filled WHERE person = 1 INTERSECT SELECT {DAY}, hour(ts) FROM filled WHERE person = 2",
    "besth": """SELECT date, hour, CASE WHEN distance_m <= p1_geofence + p2_geofence THEN 1.0 WHEN distance_m <= 150 THEN 0.95 WHEN distance_m <= 750 THEN 0.8
    WHEN distance_m <= 5000 THEN 0.5 ELSE 0.3 END AS prob FROM (
  SELECT *, ts::DATE AS date, hour(ts) AS hour, row_number() OVER (PARTITION BY ts::DATE, hour(ts) ORDER BY distance_m, us) AS k FROM fine) WHERE k = 1""",
    "matrix": """SELECT date, CAST(hour AS INTEGER) AS hour, CAST(prob AS DOUBLE) AS prob, CASE WHEN prob IS NULL THEN 'no_data' WHEN prob >= 0.4 THEN 'co_located' ELSE 'apart' END AS state FROM (
  SELECT s.date, g.hour, coalesce(b.prob, CASE WHEN h.date IS NOT NULL THEN 0.0 END) AS prob
  FROM hourspine s CROSS JOIN (SELECT unnest(range(24)) AS hour) g LEFT JOIN besth b ON b.date = s.date AND b.hour = g.hour LEFT JOIN hours h ON h.date = s.date AND h.hour = g.hour)""",
    "overlaydays": f"SELECT DISTINCT {DAY} AS date, CASE WHEN day({DAY}) % 3 = 0 THEN 'ml_together' ELSE 'apart' END AS state FROM tagged",
    "labels_": f"""SELECT DISTINCT {DAY} AS date, CASE WHEN day(ts) % 11 = 0 THEN 'mixed' WHEN day(ts) % 4 < 2 THEN 'together' ELSE 'apart' END AS label
  FROM trust""",
    "side1": "SELECT date FROM known WHERE d1 AND d2",
    "side2": f"SELECT DISTINCT {DAY} AS date FROM trust WHERE {NIGHT}",
    "mornings": f"SELECT *, concat('person-', person, '-', {DAY}) AS source_file, row_number() OVER (PARTITION BY person, {DAY} ORDER BY us, ping_id) AS k, row_number() OVER (PARTITION BY person, {DAY} ORDER BY us DESC, ping_id DESC) AS back FROM dedup",
    "ends": """SELECT a.source_file, day(a.ts) AS d, a.ts AS a_ts, b.ts AS b_ts, a.lat AS a_lat, a.lon AS a_lon, b.lat AS b_lat, b.lon AS b_lon FROM mornings a JOIN mornings b USING (source_file)
  WHERE a.k = 1 AND b.back = 1""",
    "paths": "SELECT source_file, avg(lat) AS w_lat, avg(lon) AS w_lon FROM dedup JOIN mornings USING (ping_id, person, ts, us, accuracy, lat, lon) GROUP BY 1",
    "monthly": f"""SELECT strftime(ts, '%Y-%m') AS month, count(*) AS total_colocations, count(DISTINCT {DAY}) AS unique_days,
  count(DISTINCT {DAY}) FILTER ({NIGHT}) AS nights FROM SOURCE GROUP BY 1""",
    "density": f"""SELECT s.date, coalesce(p1_reports, 0) AS p1_reports, coalesce(p2_reports, 0) AS p2_reports, coalesce(p1_interpolated, 0) AS p1_interpolated,
  coalesce(p2_interpolated, 0) AS p2_interpolated, coalesce(n_overlaps, 0) AS "overlaps" FROM spine s
  LEFT JOIN (SELECT {DAY} AS date, count(*) FILTER (person = 1) AS p1_reports, count(*) FILTER (person = 2) AS p2_reports,
    count(*) FILTER (person = 1 AND interpolated) AS p1_interpolated, count(*) FILTER (person = 2 AND interpolated) AS p2_interpolated FROM filled GROUP BY 1) USING (date)
  LEFT JOIN (SELECT {DAY} AS date, count(*) AS n_overlaps FROM fine GROUP BY 1) USING (date)""",
    "pingf": f"""SELECT {DAY} AS date, person, count(*) AS points, count(DISTINCT hour(ts)) AS hours_covered, min(hour(ts)) AS first_hour, max(hour(ts)) AS last_hour,
  median(lat) AS lat, median(lon) AS lon, CASE WHEN count(*) >= 2 THEN {_fast("min(lat)", "min(lon)", "max(lat)", "max(lon)")} ELSE 0.0 END AS spread_m
  FROM filled GROUP BY 1, 2""",
    "ovf": f"""SELECT {DAY} AS date, count(*) AS n_overlaps, min(distance_m) AS min_distance_m, avg(distance_m) AS mean_distance_m, median(distance_m) AS median_distance_m,
  max(distance_m) AS max_distance_m, coalesce(stddev_samp(distance_m), 0) AS std_distance_m, count(*) FILTER (tier = 'confirmed') AS n_confirmed,
  count(*) FILTER (tier = 'neighborhood') AS n_neighborhood, count(*) FILTER (tier = 'city') AS n_city, count(DISTINCT hour(ts)) AS overlap_hours_span,
  min(hour(ts)) AS overlap_first_hour, max(hour(ts)) AS overlap_last_hour, count(*) FILTER ({NIGHT}) AS n_night_overlaps,
  count(*) FILTER (hour(ts) BETWEEN 6 AND 10) AS n_morning_overlaps, count(*) FILTER (hour(ts) BETWEEN 18 AND 21) AS n_evening_overlaps,
  count(*) FILTER (p1_movement = 'stationary') AS n_stationary_overlaps, count(*) FILTER (p1_movement = 'walking') AS n_walking_overlaps,
  count(*) FILTER (p1_movement = 'driving') AS n_driving_overlaps FROM fine GROUP BY 1""",
    "feat": f"""SELECT *, CASE WHEN both_ AND NOT near_ AND centre < 50000 THEN 1.0 ELSE 0.0 END AS both_abroad_ FROM (
  SELECT *, both_ AND la1 BETWEEN 49.5 AND 53.5 AND lo1 BETWEEN 2.5 AND 7.2 AND la2 BETWEEN 49.5 AND 53.5 AND lo2 BETWEEN 2.5 AND 7.2 AS near_,
    {_fast("la1", "lo1", "la2", "lo2")} AS centre FROM (
    SELECT coalesce(x.date, y.date) AS date, x, y, x.points IS NOT NULL AND y.points IS NOT NULL AS both_, x.lat AS la1, x.lon AS lo1, y.lat AS la2, y.lon AS lo2
    FROM (SELECT * FROM pingf WHERE person = 1) x FULL JOIN (SELECT * FROM pingf WHERE person = 2) y ON x.date = y.date))""",
    "ens": f"""SELECT k.date, CASE WHEN d1 AND d2 AND t.date IS NOT NULL THEN 'together' WHEN d1 AND d2 AND coalesce(n_confirmed / n_overlaps, 0) >= 0.7 THEN 'ml_together'
  WHEN d1 AND d2 THEN 'apart' ELSE 'no_data' END AS state
  FROM known k LEFT JOIN (SELECT DISTINCT {DAY} AS date FROM trust) t USING (date) LEFT JOIN ovf USING (date)""",
    "targets": f"""SELECT epoch_us(date::TIMESTAMP) + h * 3600000000 AS target_us FROM (SELECT DISTINCT {DAY} AS date FROM tagged) CROSS JOIN (SELECT unnest([3, 9, 12, 21]) AS h)""",
    "local": "SELECT target_us, person, ping_id, us, lat, lon FROM targets JOIN tagged ON abs(us - target_us) <= 3 * 3600000000",
    "locallegs": _legs("local", "target_us"),
    "bylegs": f"""SELECT target_us, max(least(1.0, CASE WHEN d <= reach THEN 1.0 WHEN d <= 150 THEN 0.95 WHEN d <= 750 THEN 0.8 WHEN d <= 5000 THEN 0.5 END
    * greatest(0.0, 1.0 - abs(t - target_us) / 3600000000.0::DOUBLE / 2.0::DOUBLE))) AS p FROM (
  SELECT *, sqrt(pow((lat2 - lat1) * 111320.0::DOUBLE, 2) + pow((lon2 - lon1) * 111320.0::DOUBLE * cos(radians((a.start_lat + b.start_lat) * 0.5::DOUBLE)), 2)) AS d FROM (
    SELECT *, {_at("a", "lat")} AS lat1, {_at("a", "lon")} AS lon1, {_at("b", "lat")} AS lat2, {_at("b", "lon")} AS lon2 FROM (
      SELECT *, unnest(generate_series(s, e, 60000000)) AS t FROM (
        SELECT a.target_us, a, b, a.geofence_radius + b.geofence_radius AS reach, greatest(a.start_us, b.start_us, a.target_us - 7200000000) AS s,
          least(a.end_us, b.end_us, a.target_us + 7200000000) AS e FROM locallegs a JOIN locallegs b ON a.target_us = b.target_us AND a.person = 1 AND b.person = 2
      ) WHERE s < e AND reach IS NOT NULL)))
  GROUP BY 1""",
    "nearest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_us, person ORDER BY us, ping_id) AS k FROM local WHERE abs(us - target_us) <= 7200000000) WHERE k <= 10",
    "bypoints": f"""SELECT target_us, max(coalesce(least(1.0, CASE WHEN d <= 150 THEN 1.0 WHEN d <= 750 THEN 0.8 WHEN d <= 5000 THEN 0.5 END
    * greatest(0.0, 1.0 - off / 3600000000.0::DOUBLE / 2.0::DOUBLE)), 0.0)) AS p FROM (
  SELECT a.target_us, {_fast("a.lat", "a.lon", "b.lat", "b.lon")} AS d, greatest(abs(a.us - a.target_us), abs(b.us - b.target_us)) AS off
  FROM nearest a JOIN nearest b ON a.target_us = b.target_us AND a.person = 1 AND b.person = 2) GROUP BY 1""",
}


def chain(final: str, source: str = "trust") -> str:
    """WITH the steps that `final` needs, each after those it needs itself."""
    import re

    order: list[str] = []
    monthly = STEPS["monthly"].replace("SOURCE", source)

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN|SELECT DISTINCT \* FROM)\s+(\w+)", text):
            if name in STEPS and name not in order:
                visit(monthly if name == "monthly" else STEPS[name])
                if name not in order:
                    order.append(name)

    visit(final)
    steps = ",\n".join(f"{n} AS MATERIALIZED ({monthly if n == 'monthly' else STEPS[n]})" for n in order)
    return f"WITH {steps}\n{final}" if order else final


def _r(x: str, alias: str | None = None) -> str:
    return f"round({x}, 6) AS {alias or x}"


def _calendar_tail(code: str, extra: str) -> str:
    return f"""SELECT s.date, CAST((date_diff('day', DATE '2024-01-01', s.date) + isodow(DATE '2024-01-01') - 1) // 7 AS INTEGER) AS week,
  CAST(isodow(s.date) - 1 AS INTEGER) AS dow, {code} FROM spine s LEFT JOIN known k USING (date) {extra}"""


_FEATURES = ", ".join(
    f"round(CAST({sql} AS DOUBLE), 6) AS {name}"
    for name, sql in {
        **{f"p{p}_{n}": f"coalesce({s}.{n}, {d})" for p, s in ((1, "x"), (2, "y")) for n, d in (("points", 0), ("hours_covered", 0), ("first_hour", -1), ("last_hour", -1), ("spread_m", 0))},
        **{f"p{p}_{n}": f"CASE WHEN both_ THEN {v}{p} ELSE 0 END" for p in (1, 2) for n, v in (("lat", "la"), ("lon", "lo"))},
        "both_have_data": "CASE WHEN both_ THEN 1 ELSE 0 END", "centroid_distance_m": "CASE WHEN both_ THEN centre ELSE 999999 END",
        "both_in_nl_be": "CASE WHEN near_ THEN 1 ELSE 0 END", "both_abroad": "both_abroad_",
        **{n: f"coalesce({n}, 999999)" for n in ("min_distance_m", "mean_distance_m", "median_distance_m", "max_distance_m")},
        **{
            n: f"coalesce({n}, 0)"
            for n in (
                "n_overlaps", "std_distance_m", "n_confirmed", "n_neighborhood", "n_city", "overlap_hours_span", "overlap_first_hour", "overlap_last_hour",
                "n_night_overlaps", "n_morning_overlaps", "n_evening_overlaps", "n_stationary_overlaps", "n_walking_overlaps", "n_driving_overlaps",
            )
        },
        "overlap_duration_hours": "coalesce(overlap_last_hour - overlap_first_hour, 0)", "has_night_overlap": "CASE WHEN n_night_overlaps > 0 THEN 1 ELSE 0 END",
        "pct_confirmed": "coalesce(n_confirmed / n_overlaps, 0)", "pct_stationary": "coalesce(n_stationary_overlaps / n_overlaps, 0)",
        "day_of_week": "isodow(f.date) - 1", "is_weekend": "CASE WHEN isodow(f.date) >= 6 THEN 1 ELSE 0 END",
    }.items()
)

_CODE = "CAST(CASE state WHEN 'co_located' THEN 2 WHEN 'ml_rescued' THEN 1 WHEN 'apart' THEN -1 ELSE 0 END AS INTEGER) AS code"
_STATE = "CAST(CASE {} WHEN 'together' THEN 2 WHEN 'ml_together' THEN 1 WHEN 'apart' THEN -1 ELSE 0 END AS INTEGER) AS code"
_SIDE_MOVES = "person, movement"

FINALS = {
    "days_together": f"SELECT {DAY} AS date, count(*) AS n FROM trust GROUP BY 1",
    "usable_pings": f"SELECT person, ping_id, ts, {_r('lat')}, {_r('lon')}, accuracy FROM usable",
    "dedup_2min": f"SELECT person, ping_id, ts, {_r('lat')}, {_r('lon')}, accuracy FROM dedup",
    "jitter_filter": f"SELECT person, ping_id, ts, {_r('lat')}, {_r('lon')} FROM clean",
    "geofence_tag": "SELECT person, ping_id, accuracy, geofence_radius FROM tagged",
    "speed_lead": f"SELECT person, ping_id, {_r('speed_kmh')} FROM speeds",
    "movement_segments": f"SELECT person, seg_id, start_us, end_us, {_r('dist_m')}, {_r('speed_kmh')}, movement, geofence_radius FROM ({_legs('tagged')})",
    "movement_summary": f"SELECT {_SIDE_MOVES}, count(*) AS n, round(sum(dist_m), 3) AS total_m, round(sum(gap_h), 6) AS hours FROM ({_legs('tagged')}) GROUP BY 1, 2",
    "distance_functions": f"""SELECT ping_id, round({_fast("lat", "lon", "la", "lo")}, 6) AS fast_m, round({_geodesic("lat", "lon", "la", "lo")}, 3) AS geodesic_m FROM (
  SELECT *, lead(lat) OVER w AS la, lead(lon) OVER w AS lo FROM dedup WINDOW w AS (PARTITION BY person ORDER BY us, ping_id)) WHERE la IS NOT NULL""",
    "country_detect": f"SELECT ping_id, {_country('lat', 'lon')} AS country, {_home('lat', 'lon')} AS home_region FROM tagged",
    "privacy_rounding": f"SELECT ping_id, {_cell('lat', 3)} AS lat, {_cell('lon', 3)} AS lon FROM tagged",
    "date_parts": f"""SELECT ping_id, strftime(ts, '%Y-%m') AS month, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, isodow(ts) >= 6 AS is_weekend, {NIGHT} AS night,
  hour(ts) BETWEEN 6 AND 10 AS morning, hour(ts) >= 18 AND hour(ts) < 22 AS evening FROM tagged""",
    "coordinate_parse": "SELECT ping_id, CASE WHEN ping_id % 5 <> 4 THEN lat END AS lat, CASE WHEN ping_id % 5 <> 4 THEN lon END AS lon FROM dedup",
    "home_cell": "SELECT * FROM homes",
    "home_cell_3_decimals": "SELECT * FROM homes3",
    "overnight_fill": f"SELECT person, {TS}, round(home_lat, 6) AS lat, round(home_lon, 6) AS lon, 50.0::DOUBLE AS geofence_radius, 50 AS accuracy FROM stays",
    "interp_presence": f"""SELECT person, {TS}, {_r("lat")}, {_r("lon")}, movement AS interp_type, geofence_radius, round(speed_kmh, 6) AS interp_speed_kmh,
  CASE movement WHEN 'stationary' THEN 50 ELSE 100 END AS accuracy FROM made""",
    "raw_overlaps": f"SELECT p1_ping_id, p2_ping_id, ts, {_r('lat')}, {_r('lon')}, {_r('distance_m')}, tier FROM rawov",
    "raw_tier_counts": "SELECT tier, count(*) AS n, round(avg(distance_m), 6) AS avg_distance_m FROM rawov GROUP BY 1",
    "segment_pairs": "SELECT a.seg_id AS a_seg_id, b.seg_id AS b_seg_id, a.start_us AS a_start_us, b.start_us AS b_start_us, s AS overlap_start, e AS overlap_end FROM pairs",
    "fine_overlaps": f"SELECT bucket, ts, {_r('lat')}, {_r('lon')}, {_r('distance_m')}, tier, p1_geofence, p2_geofence, p1_movement, p2_movement, geofence_match FROM fine",
    "fine_tier_counts": "SELECT tier, p1_movement, p2_movement, count(*) AS n FROM fine GROUP BY ALL",
    "trusted_overlaps": f"SELECT bucket, ts, {_r('distance_m')}, tier FROM trust",
    "overlap_stats": f"""SELECT count(*) AS total_colocations, count(DISTINCT {DAY}) AS unique_days, min({DAY}) AS first_day, max({DAY}) AS last_day,
  round(avg(distance_m), 6) AS avg_distance_m, count(DISTINCT {DAY}) FILTER ({NIGHT}) AS nights_together FROM fine""",
    "tracked_metrics": f"""SELECT *, CASE WHEN total_tracked_days > 0 THEN round_even(days_together * 1000.0::DOUBLE / total_tracked_days, 0) / 10.0::DOUBLE ELSE 0.0 END::DOUBLE AS pct_days_together,
  CASE WHEN total_tracked_nights > 0 THEN round_even(nights_at_shared_address * 1000.0::DOUBLE / total_tracked_nights, 0) / 10.0::DOUBLE ELSE 0.0 END::DOUBLE AS pct_nights_together FROM (
  SELECT count(*) FILTER (f AND d1 AND d2) AS total_tracked_days, count(*) FILTER (f AND d1 AND d2 AND met IS NOT NULL) AS days_together,
    count(*) FILTER (f AND n1 AND n2) AS total_tracked_nights, count(*) FILTER (f AND n1 AND n2 AND met_night) AS nights_at_shared_address,
    min(date) FILTER (f AND d1 AND d2) AS date_range_start, max(date) FILTER (f AND d1 AND d2) AS date_range_end,
    count(*) FILTER (d1 AND NOT d2) AS p1_only_days, count(*) FILTER (d2 AND NOT d1) AS p2_only_days, count(*) FILTER (d1 <> d2) AS total_gap_days
  FROM (SELECT *, date >= DATE '2024-01-05' AS f FROM known LEFT JOIN (SELECT {DAY} AS met, bool_or({NIGHT}) AS met_night FROM trust GROUP BY 1) ON date = met))""",
    "day_intersect": "SELECT * FROM side1 INTERSECT SELECT * FROM side2",
    "day_except": "SELECT * FROM side1 EXCEPT SELECT * FROM side2",
    "day_symdiff": """(SELECT * FROM side1 EXCEPT SELECT * FROM side2) UNION (SELECT * FROM side2 EXCEPT SELECT * FROM side1)""",
    "day_union": "SELECT * FROM side1 UNION SELECT * FROM side2",
    "monthly_summary": "SELECT * FROM monthly",
    "month_coverage": """SELECT strftime(m, '%Y-%m') AS month, CAST(day(last_day(m)) AS INTEGER) AS days_in_month, coalesce(total_colocations, 0) AS total_colocations,
  coalesce(unique_days, 0) AS unique_days, coalesce(nights, 0) AS nights, coalesce(days_both_tracked, 0) AS days_both_tracked FROM (
  SELECT unnest(generate_series(DATE '2024-01-01', (SELECT date_trunc('month', max(date)) FROM spine), INTERVAL 1 MONTH)) AS m)
  LEFT JOIN monthly ON month = strftime(m, '%Y-%m')
  LEFT JOIN (SELECT strftime(date, '%Y-%m') AS mm, count(*) AS days_both_tracked FROM known WHERE d1 AND d2 GROUP BY 1) ON mm = strftime(m, '%Y-%m')""",
    "daily_counts": f"SELECT {DAY} AS date, count(*) AS n FROM fine GROUP BY 1",
    "residence": f"""SELECT lat, lon, nights, first_date, last_date FROM (
  SELECT {_cell("lat", 2)} AS lat, {_cell("lon", 2)} AS lon, count(*) AS n, count(DISTINCT {DAY}) AS nights, min({DAY}) AS first_date, max({DAY}) AS last_date
  FROM trust WHERE {NIGHT} GROUP BY 1, 2) ORDER BY n DESC, lat, lon LIMIT 1""",
    "hour_coverage": "SELECT date, CAST(hour AS INTEGER) AS hour FROM hours",
    "hourly_matrix": "SELECT * FROM matrix",
    "hourly_overlay": f"""SELECT date, hour, state, {_CODE} FROM (SELECT m.date, hour, CASE WHEN o.date IS NULL THEN m.state WHEN m.state = 'apart' THEN 'ml_rescued'
  WHEN m.state = 'no_data' THEN 'ml_rescued_nodata' ELSE m.state END AS state FROM matrix m LEFT JOIN (SELECT * FROM overlaydays WHERE state = 'ml_together') o USING (date))""",
    "hourly_gapfill": f"""SELECT date, hour, state, {_CODE} FROM (SELECT date, hour, CASE WHEN state = 'apart' AND co + ap >= 6 AND co > 0 AND co >= 0.7::DOUBLE * (co + ap)
  THEN 'co_located' ELSE state END AS state FROM (SELECT *, count(*) FILTER (state = 'co_located') OVER (PARTITION BY date) AS co,
  count(*) FILTER (state = 'apart') OVER (PARTITION BY date) AS ap FROM matrix))""",
    "calendar_cells": _calendar_tail(
        "coalesce(n, 0) AS n, NOT coalesce(d1 AND d2, FALSE) AS missing", f"LEFT JOIN (SELECT {DAY} AS date, count(*) AS n FROM fine GROUP BY 1) USING (date)"
    ),
    "map_cells": f"""SELECT *, CASE WHEN nights > 10 THEN 'darkgreen' WHEN unique_days > 30 THEN 'green' WHEN unique_days > 10 THEN 'orange' ELSE 'blue' END AS color,
  CASE WHEN nights > 10 THEN 'bed' WHEN unique_days > 30 THEN 'home' ELSE 'map-marker' END AS icon FROM (
  SELECT {_cell("lat", 3)} AS lat, {_cell("lon", 3)} AS lon, count(*) AS n, count(DISTINCT {DAY}) AS unique_days, min({DAY}) AS first_day, max({DAY}) AS last_day,
    count(*) FILTER ({NIGHT}) AS nights FROM fine GROUP BY 1, 2)""",
    "density_timeline": "SELECT * FROM density",
    "gap_islands": f"""SELECT min(date) AS first_day, max(date) AS last_day FROM (
  SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS island FROM spine WHERE date NOT IN (SELECT {DAY} FROM trust)) GROUP BY island""",
    "day_calendar": _calendar_tail(
        _STATE.format("coalesce(o.state, CASE WHEN d1 AND d2 AND t.date IS NOT NULL THEN 'together' WHEN d1 AND d2 THEN 'apart' ELSE 'no_data' END)"),
        f"LEFT JOIN (SELECT DISTINCT {DAY} AS date FROM trust) t USING (date) LEFT JOIN ens o USING (date)",
    ),
    "prediction_rows": """SELECT f.date, CAST(coalesce(n_overlaps, 0) > 0 AS INTEGER) AS rule_based, coalesce(label, 'unknown') AS true_label, coalesce(n_overlaps, 0) AS n_overlaps,
  round(coalesce(min_distance_m, 999999), 6) AS min_distance_m FROM feat f LEFT JOIN ovf USING (date) LEFT JOIN labels_ USING (date)""",
    "cv_groups": "SELECT date, CASE label WHEN 'apart' THEN 0.0 ELSE 1.0 END::DOUBLE AS y, CASE WHEN day(date) <= 15 THEN 'first' ELSE 'second' END AS part FROM feat JOIN labels_ USING (date)",
    "export_a_pings": f"""SELECT source_file, ts, {_r("lat")}, {_r("lon")}, 10 AS accuracy, NULL::VARCHAR AS place_type FROM mornings
UNION ALL SELECT source_file, unnest([a_ts, b_ts]), round(a_lat, 6), round(a_lon, 6), 20, 'HOME' FROM ends""",
    "export_b_pings": f"""SELECT m.source_file, date_trunc('minute', ts) AS ts, {_r("lat")}, {_r("lon")}, 15 AS accuracy FROM mornings m
UNION ALL SELECT source_file, unnest([date_trunc('minute', a_ts), date_trunc('minute', b_ts)]), round(a_lat, 6), round(a_lon, 6), 20 FROM ends JOIN paths USING (source_file)
  WHERE d % 2 = 1 AND {_short("a_lat", "a_lon", "w_lat", "w_lon")} <= 5000
UNION ALL SELECT source_file, ts, lat, lon, 30 FROM (
  SELECT source_file, date_trunc('minute', a_ts) AS ts, round(a_lat, 6) AS lat, round(a_lon, 6) AS lon, {_short("a_lat", "a_lon", "w_lat", "w_lon")} AS d FROM ends JOIN paths USING (source_file)
  UNION ALL SELECT source_file, date_trunc('minute', b_ts), round(b_lat, 6), round(b_lon, 6), {_short("b_lat", "b_lon", "w_lat", "w_lon")} FROM ends JOIN paths USING (source_file)
) WHERE d <= 5000""",
    "day_features": f"SELECT f.date, {_FEATURES} FROM feat f LEFT JOIN ovf USING (date)",
    "night_labels": f"""SELECT date, 'apart' AS label FROM (
  SELECT CASE WHEN us % 86400000000 >= 22 * 3600000000 THEN {DAY} WHEN us % 86400000000 <= 6 * 3600000000 THEN {DAY} - 1 END AS date, person
  FROM tagged JOIN homes3 USING (person) WHERE {_fast("lat", "lon", "home_lat", "home_lon")} <= 500
    AND (SELECT {_fast("a.home_lat", "a.home_lon", "b.home_lat", "b.home_lon")} FROM homes3 a JOIN homes3 b ON a.person = 1 AND b.person = 2) >= 5000
) WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND day(date) % 5 <> 1 AND date NOT IN (SELECT {DAY} FROM fine WHERE tier = 'confirmed') GROUP BY 1 HAVING count(DISTINCT person) = 2""",
    "merged_labels": f"SELECT * FROM labels_ UNION ALL SELECT DISTINCT {DAY}, 'apart' FROM tagged WHERE {DAY} NOT IN (SELECT date FROM labels_)",
    "ensemble_days": "SELECT * FROM ens",
    "ensemble_counts": """SELECT count(*) FILTER (state = 'together') AS together, count(*) FILTER (state = 'ml_together') AS ml_together, count(*) FILTER (state = 'apart') AS apart,
  count(*) FILTER (state <> 'no_data') AS tracked, count(*) FILTER (state = 'no_data') AS no_data FROM ens WHERE date >= DATE '2024-01-05'""",
    "prob_at_instant": """SELECT target_us, round(CASE WHEN n1 IS NULL OR n1 = 0 OR n2 = 0 THEN NULL WHEN coalesce(l1, 0) = 0 OR coalesce(l2, 0) = 0 THEN q.p ELSE coalesce(b.p, 0.0) END, 6) AS prob
FROM targets LEFT JOIN (SELECT target_us, count(*) FILTER (person = 1) AS n1, count(*) FILTER (person = 2) AS n2 FROM local GROUP BY 1) USING (target_us)
  LEFT JOIN (SELECT target_us, count(*) FILTER (person = 1) AS l1, count(*) FILTER (person = 2) AS l2 FROM locallegs GROUP BY 1) USING (target_us)
  LEFT JOIN bylegs b USING (target_us) LEFT JOIN bypoints q USING (target_us)""",
    "classification_metrics": """SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (
  SELECT count(*) FILTER (said AND is_) AS tp, count(*) FILTER (said AND NOT is_) AS fp, count(*) FILTER (NOT said AND is_) AS fn, count(*) FILTER (NOT said AND NOT is_) AS tn FROM (
    SELECT coalesce(n_confirmed / n_overlaps, 0) >= 0.5 AS said, label <> 'apart' AS is_ FROM labels_ JOIN feat USING (date) LEFT JOIN ovf USING (date)))""",
}

#: Streams that are replayed to their end have the rows of the batch.
for _name in ("raw_overlaps", "fine_overlaps"):
    FINALS[f"stream_{_name}"] = FINALS[_name]
FINALS["stream_segments"], FINALS["stream_overnight"] = FINALS["movement_segments"], FINALS["overnight_fill"]
FINALS["stream_gap_islands"] = f"SELECT * FROM ({FINALS['gap_islands']}) WHERE first_day > (SELECT min({DAY}) FROM trust) AND last_day < (SELECT max({DAY}) FROM trust)"
FINALS["report_gaps"] = """WITH e AS (SELECT concat(user_id, ':', event_type) AS reporter, ts::DATE AS date FROM events)
SELECT reporter, min(date) AS first_day, max(date) AS last_day FROM (
  SELECT reporter, date, date - CAST(row_number() OVER (PARTITION BY reporter ORDER BY date) AS INTEGER) AS island
  FROM (SELECT DISTINCT reporter FROM e) CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', (SELECT max(date) FROM e), INTERVAL 1 DAY))::DATE AS date)
  ANTI JOIN (SELECT DISTINCT reporter, date FROM e) USING (reporter, date)) GROUP BY reporter, island HAVING count(*) >= 4"""
# the cells of a level are those of a regular grid: 2 ** zoom of them span the latitudes, twice as many the longitudes
FINALS["map_pyramid"] = f"""SELECT zoom, x, y, count(*) AS n, count(DISTINCT {DAY}) AS unique_days, count(*) FILTER ({NIGHT}) AS nights FROM (
  SELECT ts, zoom, CAST(floor((lon + 180.0::DOUBLE) * (1 << (zoom + 1))::DOUBLE / 360.0::DOUBLE) AS BIGINT) AS x, CAST(floor((90.0::DOUBLE - lat) * (1 << zoom)::DOUBLE / 180.0::DOUBLE) AS BIGINT) AS y
  FROM fine CROSS JOIN (SELECT unnest([0, 4, 8, 12, 16]) AS zoom)) GROUP BY zoom, x, y"""

# days in turns as files of layout A and B
_A, _B = "d % 2 = 1", "d % 2 = 0"
FINALS["export_layouts"] = "SELECT source_file, CASE WHEN d % 5 = 0 THEN '?' WHEN d % 2 = 1 THEN 'A' ELSE 'B' END AS layout FROM ends"
_FILES_A = f"""SELECT source_file, ts, 10 AS accuracy FROM mornings WHERE day(ts) % 2 = 1 UNION ALL SELECT source_file, unnest([a_ts, b_ts]), 20 FROM ends WHERE {_A}"""
_FILES_B = f"""SELECT source_file, ts, accuracy FROM ({FINALS["export_b_pings"]}) WHERE day(ts) % 2 = 0"""
FINALS["export_metadata"] = f"SELECT source_file AS file, count(*) AS records, min(ts) AS first, max(ts) AS last, true AS hashed FROM ({_FILES_A} UNION ALL {_FILES_B}) GROUP BY 1"
FINALS["export_union"] = f"""SELECT person, ts, accuracy FROM (
  SELECT CAST(substr(source_file, 8, 1) AS INTEGER) AS person, ts, accuracy, row_number() OVER (PARTITION BY substr(source_file, 8, 1), epoch_us(ts) // 120000000 ORDER BY accuracy, ts) AS best
  FROM ({_FILES_A} UNION ALL {_FILES_B})) WHERE best = 1"""
FINALS["export_rejects"] = """SELECT source_file, CAST(0 AS BIGINT) AS item, CAST(k - 1 AS INTEGER) AS point,
  CASE WHEN day(ts) % 2 = 1 AND ping_id % 11 = 5 THEN 'time' WHEN ping_id % 7 = 3 THEN 'place' ELSE 'zero' END AS reason
FROM mornings WHERE day(ts) % 10 <> 0 AND (ping_id % 7 IN (3, 4) OR (day(ts) % 2 = 1 AND ping_id % 11 = 5))
UNION ALL SELECT source_file, 0, NULL, 'damaged' FROM ends WHERE d % 10 = 0"""
_COUPLE = """SELECT CAST(ping_id AS VARCHAR) AS asset_id, ts AS "timestamp", lat, lon, CASE ping_id % 4 WHEN 0 THEN 'Apple' WHEN 1 THEN 'APPLE Inc.' WHEN 2 THEN 'realme' ELSE '' END AS camera_make
FROM dedup WHERE ping_id % 13 <> 0 AND ping_id % 17 <> 0 AND ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' AND (person = 1 OR ping_id % 4 < 2)"""
FINALS["photo_evidence"] = f'SELECT asset_id, "timestamp", {_r("lat")}, {_r("lon")}, camera_make FROM ({_COUPLE})'
FINALS["photo_labels"] = f"""SELECT * FROM labels_ UNION ALL SELECT DISTINCT "timestamp"::DATE, 'together' FROM ({_COUPLE}) WHERE "timestamp"::DATE NOT IN (SELECT date FROM labels_)"""
FINALS["photo_features"] = f"""SELECT f.date, coalesce(o.n_overlaps, 0) AS n_overlaps, coalesce(n, 0)::DOUBLE AS n_couple_photos, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_couple_photos
FROM feat f LEFT JOIN ovf o USING (date) LEFT JOIN (SELECT "timestamp"::DATE AS date, count(*) AS n FROM ({_COUPLE}) GROUP BY 1) USING (date)"""

ORACLES = {name: chain(sql, "fine" if name == "month_coverage" else "trust") for name, sql in FINALS.items()}
