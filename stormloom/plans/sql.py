"""DuckDB SQL that the queries are held against: common table expressions, chained by name."""

from __future__ import annotations

from ..sources.sites import site_rows

HAVERSINE = "2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h))"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def there(az: str, rng: str, lat: str = "35.3331", lon: str = "-97.2778") -> tuple[str, str]:
    d = f"(({rng}) / 6371000.0)"
    la = f"asin(sin(radians({lat})) * cos{d} + cos(radians({lat})) * sin{d} * cos(radians({az})))"
    lo = f"atan2(sin(radians({az})) * sin{d} * cos(radians({lat})), cos{d} - sin(radians({lat})) * sin({la}))"
    return f"degrees({la})", f"degrees(radians({lon}) + {lo})"


def intensity(x: str) -> str:
    return f"CASE WHEN {x} < 20 THEN 'drizzle' WHEN {x} < 30 THEN 'light rain' WHEN {x} < 40 THEN 'moderate rain' WHEN {x} < 50 THEN 'heavy rain' WHEN {x} < 60 THEN 'intense rain' ELSE 'severe core' END"


def bearing(x: str) -> str:
    names = "['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW']"
    k = f"CAST(round_even({x} / 22.5, 0) AS INT)"
    return f"{names}[(({k} % 16) + 16) % 16 + 1]"


def delta(a: str, b: str) -> str:
    return f"coalesce(least(abs({a} - {b}) % 360, 360 - abs({a} - {b}) % 360), 0.0)"


def pmod(x: str, m: str = "360.0") -> str:
    return f"((({x}) % {m}) + {m}) % {m}"


def even(x: str, places: int) -> str:
    """x rounded half to even by its shortest decimal text, as Spark's bround() does."""
    scaled = f"(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)) * {10**places})"
    return f"(CAST(floor({scaled}) + CASE WHEN {scaled} - floor({scaled}) > 0.5 OR ({scaled} - floor({scaled}) = 0.5 AND floor({scaled}) % 2 <> 0) THEN 1 ELSE 0 END AS DOUBLE) / {10**places})"


RAYS = "(SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS rng_idx FROM embeddings)"

CTES = {
    "gates": f"""rays AS (SELECT vec_id // 50 AS scan_id, CAST(vec_id % 50 AS INT) AS az_idx, rng_idx, v FROM {RAYS}),
gates AS (SELECT scan_id, az_idx, rng_idx, CASE
  WHEN scan_id % 4 = 3 OR NOT (az_idx BETWEEN 5 AND 23 AND rng_idx BETWEEN 7 AND 39) THEN v * 160 + 20
  WHEN az_idx BETWEEN 6 AND 22 AND rng_idx BETWEEN 8 AND 38 THEN greatest(
    30.0::DOUBLE * greatest(0.0::DOUBLE, 1 - sqrt(pow(az_idx - (scan_id % 3 + 12), 2) + pow(rng_idx - (scan_id % 4 + 16), 2)) / 6),
    CASE
      WHEN scan_id % 2 = 0 THEN 44.0::DOUBLE ELSE 30.0::DOUBLE END * greatest(0.0::DOUBLE,
      1 - sqrt(pow(az_idx - (scan_id % 2 + 15), 2) + pow(rng_idx - (scan_id % 3 + 30), 2)) / 6)) + 28 + v * 10
  ELSE 10.0::DOUBLE END AS dbz FROM rays)""",
    "vgates": f"vgates AS (SELECT vec_id // 100 AS scan_id, CAST((vec_id // 50) % 2 AS INT) AS sweep_idx, CAST(vec_id % 50 AS INT) AS az_idx, rng_idx, v * 80 AS vel FROM {RAYS})",
    "cells": "cells AS MATERIALIZED (SELECT scan_id, t AS threshold, az_idx, rng_idx, dbz, CAST(az_idx AS BIGINT) * 1000000 + rng_idx AS cell FROM gates, (VALUES (20.0), (30.0), (40.0), (50.0), (60.0)) x(t) WHERE dbz >= t)",
    "reach": """
steps AS MATERIALIZED (SELECT a.scan_id, a.threshold, a.cell AS c1, b.cell AS c2 FROM cells a
  JOIN cells b ON a.scan_id = b.scan_id AND a.threshold = b.threshold AND (a.cell - b.cell IN (1, -1, 1000000, -1000000))),
reach AS (SELECT scan_id, threshold, cell, cell AS root FROM cells UNION SELECT s.scan_id, s.threshold, s.c2, r.root FROM reach r
  JOIN steps s ON s.scan_id = r.scan_id AND s.threshold = r.threshold AND s.c1 = r.cell WHERE s.c2 > r.root)""",
    "lab": "least_root AS (SELECT scan_id, threshold, cell, min(root) AS label FROM reach GROUP BY ALL), raw_lab AS (SELECT c.*, l.label FROM cells c JOIN least_root l USING (scan_id, threshold, cell)), lab AS (SELECT *, lag(label) OVER w AS parent_label, first_value(label) OVER w AS blob FROM raw_lab WINDOW w AS (PARTITION BY scan_id, cell ORDER BY threshold))",
    "tree": """
raw_nodes AS (SELECT scan_id, blob, threshold, label, min(parent_label) AS parent_label, count(*) AS pixel_count, max(dbz) AS peak_dbz FROM lab
  GROUP BY scan_id, blob, threshold, label),
nodes AS (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id, blob ORDER BY threshold, label) AS INT) AS node_id FROM raw_nodes),
tree AS (SELECT n.scan_id, n.blob, n.node_id, CAST(n.threshold AS DOUBLE) AS threshold, n.label, p.node_id AS parent_node_id, n.pixel_count, n.peak_dbz,
  CASE n.threshold WHEN 40 THEN n.label WHEN 50 THEN n.parent_label WHEN 60 THEN p.parent_label END AS branch
  FROM nodes n LEFT JOIN nodes p ON p.scan_id = n.scan_id AND p.blob = n.blob AND p.threshold = n.threshold - 10 AND p.label = n.parent_label)""",
    "seeds": """leaves AS (SELECT * FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.scan_id = t.scan_id AND c.blob = t.blob AND c.parent_node_id = t.node_id)),
best AS (SELECT *, min(node_id) OVER (PARTITION BY scan_id, blob, branch) AS first_leaf FROM leaves WHERE pixel_count >= 6 AND threshold >= 50
  QUALIFY row_number() OVER (PARTITION BY scan_id, blob, branch ORDER BY threshold DESC, pixel_count DESC, peak_dbz DESC, node_id) = 1),
seeds AS (SELECT scan_id, blob, CAST(row_number() OVER (PARTITION BY scan_id, blob ORDER BY threshold DESC, pixel_count DESC, peak_dbz DESC, first_leaf) - 1 AS INT) AS seed, threshold, label
  FROM best QUALIFY count(*) OVER (PARTITION BY scan_id, blob) > 1)""",
    "divided": """
seed_gates AS (SELECT l.scan_id, l.blob, s.seed, l.cell, l.az_idx, l.rng_idx, l.dbz FROM lab l
  JOIN seeds s ON s.scan_id = l.scan_id AND s.blob = l.blob AND s.threshold = l.threshold AND s.label = l.label),
centres AS (SELECT scan_id, blob, seed, sum(az_idx * dbz) / sum(dbz) AS r, sum(rng_idx * dbz) / sum(dbz) AS c FROM seed_gates GROUP BY ALL),
divided AS (SELECT b.scan_id, b.blob, b.cell, b.az_idx, b.rng_idx, b.dbz, coalesce(any_value(g.seed),
  arg_min(c.seed, {'d': pow(b.az_idx - c.r, 2) + pow(b.rng_idx - c.c, 2), 's': c.seed}), 0) AS seed
  FROM lab b LEFT JOIN centres c ON c.scan_id = b.scan_id AND c.blob = b.blob LEFT JOIN seed_gates g ON g.scan_id = b.scan_id AND g.cell = b.cell WHERE b.threshold = 20
    GROUP BY b.scan_id, b.blob, b.cell, b.az_idx, b.rng_idx, b.dbz)""",
    "objects": """sized AS (SELECT *, (2000 + 1000.0 * rng_idx) * radians(1.0) * 1000.0 / 1e6 AS area FROM divided),
sums AS (SELECT scan_id, blob, seed, sum(area) AS area, max(dbz) AS peak, sum(az_idx * dbz) / sum(dbz) AS r, sum(rng_idx * dbz) / sum(dbz) AS c, count(*) AS pixel_count,
  min(az_idx) AS min_row, min(rng_idx) AS min_col, max(az_idx) AS max_row, max(rng_idx) AS max_col,
  sum(area) FILTER (dbz < 30) AS l20, sum(area) FILTER (dbz >= 30 AND dbz < 40) AS l30, sum(area) FILTER (dbz >= 40 AND dbz < 50) AS l40,
    sum(area) FILTER (dbz >= 50 AND dbz < 60) AS l50, sum(area) FILTER (dbz >= 60) AS l60
    FROM sized GROUP BY scan_id, blob, seed),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY blob, seed) AS INT) AS object_id FROM sums WHERE area >= 4 AND (area >= 8 OR peak >= 40)),
placed AS (SELECT *, """ + there("r", "2000 + 1000.0 * c")[0] + " AS lat, " + there("r", "2000 + 1000.0 * c")[1] + """ AS lon FROM kept),
objects AS (SELECT scan_id, object_id, blob, seed, round_even(lat, 4) AS centroid_lat, round_even(lon, 4) AS centroid_lon, round_even((2000 + 1000.0 * c) / 1000, 1) AS distance_km, round_even(r % 360, 1) AS bearing_deg, round_even(peak, 1) AS peak_dbz, """ + intensity("peak") + """ AS peak_label, round_even(area, 2) AS area_km2,
  min_row, min_col, max_row, max_col, pixel_count, l20, l30, l40, l50, l60, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY round_even(peak, 1) DESC,
    round_even(area, 2) DESC, object_id) AS INT) AS rank
    FROM placed)""",
    "speckle": """e20 AS (SELECT *, CAST(az_idx AS BIGINT) * 1000000 + rng_idx AS cell FROM gates WHERE dbz >= 20),
steps8 AS (SELECT a.scan_id, a.cell AS c1, b.cell AS c2 FROM e20 a
  JOIN e20 b ON a.scan_id = b.scan_id AND a.cell <> b.cell AND abs(a.az_idx - b.az_idx) <= 1 AND abs(a.rng_idx - b.rng_idx) <= 1),
reach8 AS (SELECT scan_id, cell, cell AS other, 0 AS hop FROM e20 UNION SELECT r.scan_id, r.cell, s.c2, r.hop + 1 FROM reach8 r
  JOIN steps8 s ON s.scan_id = r.scan_id AND s.c1 = r.other WHERE r.hop < 3),
small8 AS (SELECT r.scan_id, r.cell FROM (SELECT DISTINCT scan_id, cell, other FROM reach8) r JOIN e20 o ON o.scan_id = r.scan_id AND o.cell = r.other
  GROUP BY r.scan_id, r.cell HAVING count(*) <= 3 AND max(o.dbz) < 35),
speckle AS (SELECT e.scan_id, e.az_idx, e.rng_idx FROM e20 e JOIN small8 USING (scan_id, cell))""",
    "wind": """
fast AS MATERIALIZED (SELECT *, CASE WHEN vel <= -10 THEN 'inbound' ELSE 'outbound' END AS region_type, CAST(az_idx AS BIGINT) * 1000000 + rng_idx AS cell FROM vgates
  WHERE abs(vel) >= 10),
wsteps AS MATERIALIZED (SELECT a.scan_id, a.sweep_idx, a.region_type, a.cell AS c1, b.cell AS c2 FROM fast a
  JOIN fast b ON a.scan_id = b.scan_id AND a.sweep_idx = b.sweep_idx AND a.region_type = b.region_type AND a.cell <> b.cell AND abs(a.az_idx - b.az_idx) <= 1 AND abs(a.rng_idx - b.rng_idx) <= 1),
wreach AS (SELECT scan_id, sweep_idx, region_type, cell, cell AS root FROM fast UNION SELECT s.scan_id, s.sweep_idx, s.region_type, s.c2, r.root FROM wreach r
  JOIN wsteps s ON s.scan_id = r.scan_id AND s.sweep_idx = r.sweep_idx AND s.region_type = r.region_type AND s.c1 = r.cell WHERE s.c2 > r.root),
wind AS (SELECT f.*, l.label FROM fast f JOIN (SELECT scan_id, sweep_idx, region_type, cell, min(root) AS label FROM wreach
  GROUP BY ALL) l USING (scan_id, sweep_idx, region_type, cell))""",
    "regions": """
wsums AS (SELECT scan_id, sweep_idx, region_type, label, sum((2000 + 1000.0 * rng_idx) * radians(1.0) * 1000.0 / 1e6) AS area, CASE region_type
  WHEN 'inbound' THEN min(vel) ELSE max(vel) END AS peak, avg(vel) AS mean, sum(az_idx * abs(vel)) / sum(abs(vel)) AS r, sum(rng_idx * abs(vel)) / sum(abs(vel)) AS c
  FROM wind GROUP BY scan_id, sweep_idx, region_type, label HAVING area >= 4),
regions AS (SELECT scan_id, sweep_idx, region_type, label, round_even(peak, 1) AS peak_velocity_ms, round_even(mean, 1) AS mean_velocity_ms, round_even(area, 2) AS area_km2, round_even(""" + there("r", "2000 + 1000.0 * c")[0] + ", 4) AS centroid_lat, round_even(" + there("r", "2000 + 1000.0 * c")[1] + """, 4) AS centroid_lon, round_even((2000 + 1000.0 * c) / 1000, 1) AS distance_km, round_even(r % 360, 1) AS bearing_deg, sweep_idx + 0.5::DOUBLE AS elevation FROM wsums)""",
    "shear": """
offs AS (SELECT * FROM (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) o(k, a, r)
  WHERE sqrt(pow(a * radians(1.0) * 33500.0, 2) + pow(r * 1000.0, 2)) / 1000 <= 5),
spairs AS (SELECT g.scan_id, g.sweep_idx, g.az_idx, g.rng_idx, o.k, abs(g.vel - n.vel) AS shear, least(g.vel, n.vel) AS inbound, greatest(g.vel, n.vel) AS outbound
  FROM vgates g, offs o
  JOIN vgates n ON n.scan_id = g.scan_id AND n.sweep_idx = g.sweep_idx AND n.az_idx = (g.az_idx - o.a + 50) % 50 AND n.rng_idx = (g.rng_idx - o.r + 64) % 64
  WHERE (g.vel < 0) <> (n.vel < 0) AND abs(g.vel - n.vel) >= 15),
shear AS (SELECT scan_id, sweep_idx, az_idx, rng_idx, shear, inbound, outbound FROM spairs
  QUALIFY row_number() OVER (PARTITION BY scan_id, sweep_idx, az_idx, rng_idx ORDER BY shear DESC, k) = 1)""",
    "rotations": """turning AS MATERIALIZED (SELECT *, CAST(az_idx AS BIGINT) * 1000000 + rng_idx AS cell FROM shear),
tsteps AS MATERIALIZED (SELECT a.scan_id, a.sweep_idx, a.cell AS c1, b.cell AS c2
  FROM turning a, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(da, dr)
  JOIN turning b ON b.scan_id = a.scan_id AND b.sweep_idx = a.sweep_idx AND b.az_idx = a.az_idx + o.da AND b.rng_idx = a.rng_idx + o.dr),
tlab(scan_id, sweep_idx, cell, label) USING KEY (scan_id, sweep_idx, cell) AS (SELECT scan_id, sweep_idx, cell, cell FROM turning UNION
  SELECT s.scan_id, s.sweep_idx, s.c2, min(t.label) FROM tlab t JOIN tsteps s ON s.scan_id = t.scan_id AND s.sweep_idx = t.sweep_idx AND s.c1 = t.cell
  JOIN recurring.tlab o ON o.scan_id = s.scan_id AND o.sweep_idx = s.sweep_idx AND o.cell = s.c2 WHERE t.label < o.label GROUP BY s.scan_id, s.sweep_idx, s.c2),
tsums AS (SELECT scan_id, sweep_idx, label, count(*) AS n, max(shear) AS shear, min(inbound) AS low, max(outbound) AS high, sum(az_idx * shear) / sum(shear) AS r,
  sum(rng_idx * shear) / sum(shear) AS c,
  max(az_idx) - min(az_idx) AS az_extent, max(rng_idx) - min(rng_idx) AS rng_extent FROM turning JOIN tlab USING (scan_id, sweep_idx, cell)
    GROUP BY scan_id, sweep_idx, label HAVING count(*) >= 2),
rotations AS (SELECT scan_id, sweep_idx, label, r AS azimuth, 2000 + 1000.0::DOUBLE * c AS range_m, round_even(""" + there("r", "2000 + 1000.0 * c")[0] + ", 4) AS centroid_lat, round_even(" + there("r", "2000 + 1000.0 * c")[1] + """, 4) AS centroid_lon,
  round_even((2000 + 1000.0 * c) / 1000, 1) AS distance_km, round_even(r % 360, 1) AS bearing_deg, round_even(shear, 1) AS max_shear_ms, round_even(low,
    1) AS max_inbound_ms, round_even(high, 1) AS max_outbound_ms,
  round_even(sqrt(pow(radians(az_extent * 1.0::DOUBLE) * (2000 + 1000.0 * c), 2) + pow(rng_extent * 1000.0::DOUBLE, 2)) / 1000, 1) AS diameter_km,
    sweep_idx + 0.5::DOUBLE AS elevation,
  CASE WHEN shear >= 35 THEN 'strong' WHEN shear >= 25 THEN 'moderate' ELSE 'weak' END AS strength FROM tsums)""",
    # rows in order, each joining the first earlier result that it fits: one row of the list at a time
    "merged_rotations": """
rrows AS MATERIALIZED (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY sweep_idx, label) AS k, {'az': azimuth, 'rng': range_m, 'lat': centroid_lat,
  'lon': centroid_lon, 'km': distance_km, 'deg': bearing_deg,
  'shear': max_shear_ms, 'low': max_inbound_ms, 'high': max_outbound_ms, 'wide': diameter_km, 'n': 1, 'els': [elevation], 'strength': strength} AS x FROM rotations),
rfold AS (SELECT scan_id, k, [x] AS found FROM rrows WHERE k = 1 UNION ALL SELECT scan_id, next_k, CASE
  WHEN place IS NULL THEN list_append(found, x) ELSE list_transform(found, lambda y, i: CASE WHEN i <> place THEN y ELSE
  {'az': y.az, 'rng': y.rng, 'lat': y.lat, 'lon': y.lon, 'km': y.km, 'deg': y.deg, 'shear': greatest(y.shear, x.shear), 'low': least(y.low, x.low),
    'high': greatest(y.high, x.high), 'wide': greatest(y.wide, x.wide), 'n': y.n + 1, 'els': list_concat(y.els, x.els),
  'strength': CASE WHEN greatest(y.shear, x.shear) >= 35 THEN 'strong' WHEN greatest(y.shear, x.shear) >= 25 THEN 'moderate' ELSE 'weak' END} END) END
  FROM (SELECT f.scan_id, f.found, r.k AS next_k, r.x,
    list_position(list_transform(f.found,
    lambda y: sqrt(pow(least(abs(r.x.az - y.az), 360 - abs(r.x.az - y.az)) * 0.017453292519943295::DOUBLE * r.x.rng, 2) + pow(r.x.rng - y.rng, 2)) / 1000 <= 10),
    true) AS place
    FROM rfold f JOIN rrows r ON r.scan_id = f.scan_id AND r.k = f.k + 1)),
merged_rotations AS (SELECT scan_id, CAST(i AS INT) AS rotation_id, found[i] AS y FROM (SELECT scan_id, found, unnest(generate_series(1, len(found))) AS i FROM rfold
  QUALIFY k = max(k) OVER (PARTITION BY scan_id)))""",
    "merged_regions": """wcells AS MATERIALIZED (SELECT scan_id, sweep_idx, region_type, label, list(cell) AS cells FROM wind GROUP BY ALL),
grows AS MATERIALIZED (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY sweep_idx, region_type, label) AS k, {'kind': region_type,
  'peak': peak_velocity_ms, 'mean': mean_velocity_ms, 'area': area_km2, 'lat': centroid_lat, 'lon': centroid_lon,
  'km': distance_km, 'deg': bearing_deg, 'n': 1, 'els': [elevation], 'cells': cells} AS x FROM regions JOIN wcells USING (scan_id, sweep_idx, region_type, label)),
gfold AS (SELECT scan_id, k, [x] AS found FROM grows WHERE k = 1 UNION ALL SELECT scan_id, next_k, CASE
  WHEN place IS NULL THEN list_append(found, x) ELSE list_transform(found, lambda y, i: CASE WHEN i <> place THEN y ELSE
  {'kind': y.kind, 'peak': CASE y.kind
    WHEN 'inbound' THEN least(y.peak, x.peak) ELSE greatest(y.peak, x.peak) END, 'mean': CAST(printf('%.1f', (y.mean + x.mean) / 2) AS DOUBLE), 'area': greatest(y.area,
    x.area), 'lat': y.lat, 'lon': y.lon,
  'km': y.km, 'deg': y.deg, 'n': y.n + 1, 'els': list_concat(y.els, x.els), 'cells': list_distinct(list_concat(y.cells, x.cells))} END) END
  FROM (SELECT f.scan_id, f.found, g.k AS next_k, g.x,
    list_position(list_transform(f.found,
    lambda y: y.kind = g.x.kind AND len(list_intersect(y.cells, g.x.cells)) >= 0.3::DOUBLE * len(list_distinct(list_concat(y.cells, g.x.cells)))), true) AS place
    FROM gfold f JOIN grows g ON g.scan_id = f.scan_id AND g.k = f.k + 1)),
merged_regions AS (SELECT scan_id, CAST(i AS INT) AS region_id, found[i] AS y FROM (SELECT scan_id, found, unnest(generate_series(1, len(found))) AS i FROM gfold
  QUALIFY k = max(k) OVER (PARTITION BY scan_id)))""",
    "files": "files AS (SELECT DISTINCT 'S' || user_id % 10 AS site_id, 'S' || user_id % 10 || strftime(ts, '%Y%m%d_%H%M%S') || '_V06' || CASE WHEN event_id % 7 = 0 THEN '_MDM' ELSE '' END AS filename FROM events), dated AS (SELECT *, strptime(right(split_part(filename, '_V', 1), 15), '%Y%m%d_%H%M%S') AS scan_ts FROM files)",
    "sites": "sites AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{n.replace(chr(39), chr(39) * 2)}', {la}::DOUBLE, {lo}::DOUBLE, {e}, {k})" for k, (i, n, la, lo, e) in enumerate(site_rows())) + ") s(site_id, name, latitude, longitude, elevation_m, ord))",
    "stations": "stations AS (SELECT s_suppkey AS station_id, s_suppkey % 25 + 25.0::DOUBLE AS lat, s_suppkey % 55 - 125.0::DOUBLE AS lon, abs(s_acctbal) AS elev FROM supplier)",
    "positions": "positions AS (SELECT user_id AS track_id, ts, value / 1000 + 35 AS lat, (event_id % 100) / 1000.0::DOUBLE - 97 AS lon, event_id AS position_id FROM events)",
    "hourly": "hourly AS (SELECT event_id // 12 AS track_id, TIMESTAMP '2024-01-01' + to_hours(event_id % 12) AS ts, 35.0::DOUBLE + (event_id % 12) * (((event_id // 12) % 7 - 3) * 0.01::DOUBLE) + value / 100000 AS lat, -97.0::DOUBLE + (event_id % 12) * ((event_id // 12) % 5 - 2) * 0.02::DOUBLE + value / 50000 AS lon, event_id AS position_id FROM events)",
    "steps_of": """
moved AS (SELECT track_id, ts, position_id, lat, lon, epoch(ts - lag(ts) OVER w) / 3600.0 AS hours, (lat - lag(lat) OVER w) * 111.32 AS north,
  (lon - lag(lon) OVER w) * 111.32 * cos(radians((lat + lag(lat) OVER w) / 2)) AS east FROM {positions} WINDOW w AS (PARTITION BY track_id ORDER BY ts, position_id)),
steps_of AS (SELECT track_id, ts, position_id, sqrt(north * north + east * east) / hours AS speed_kmh, CASE WHEN sqrt(north * north + east * east) / hours >= 5 THEN """ + pmod("degrees(atan2(east, north))") + """ END AS heading_deg FROM moved WHERE hours > 0),
headings AS (SELECT track_id, coalesce(list(heading_deg ORDER BY ts, position_id) FILTER (heading_deg IS NOT NULL), []) AS hs FROM steps_of GROUP BY track_id)""",
    "history": """times AS (SELECT *, epoch(ts - min(ts) OVER (PARTITION BY track_id)) AS t FROM {positions}),
fit AS (SELECT track_id, count(*) AS n, max(t) AS elapsed, avg(lat) AS mlat, regr_slope(lat, t) AS sa, regr_slope(lon, t) AS so,
  sqrt(greatest(regr_syy(lat, t) - regr_sxy(lat, t) * regr_sxy(lat, t) / nullif(regr_sxx(lat, t), 0),
  0) / count(*)) + sqrt(greatest(regr_syy(lon, t) - regr_sxy(lon, t) * regr_sxy(lon, t) / nullif(regr_sxx(lon, t), 0), 0) / count(*)) AS residual
  FROM times GROUP BY track_id),
span AS (SELECT track_id, min(speed_kmh) AS slow, max(speed_kmh) AS quick FROM steps_of GROUP BY track_id),
joined AS (SELECT f.*, s.slow, s.quick, coalesce(h.hs, []) AS hs, n >= 2 AND elapsed > 0 AS moving FROM fit f LEFT JOIN span s USING (track_id) LEFT
  JOIN headings h USING (track_id)),
speeds AS (SELECT *, CASE WHEN moving THEN round_even(sqrt(pow(sa * 3600 * 111.32, 2) + pow(so * 3600 * 111.32 * cos(radians(mlat)), 2)), 1) ELSE 0.0 END AS speed_kmh, round_even(""" + pmod("degrees(atan2(so * 3600 * 111.32 * cos(radians(mlat)), sa * 3600 * 111.32))") + """, 1) AS raw, list_transform(generate_series(1, len(hs) - 1), lambda i: least(abs(hs[i] - hs[i + 1]) % 360, 360 - abs(hs[i] - hs[i + 1]) % 360)) AS turns FROM joined),
graded AS (SELECT *, CASE WHEN n < 2 THEN {'l': 'high', 's': 1.0, 'r': 'insufficient movement history'}
  WHEN elapsed = 0 THEN {'l': 'low', 's': 0.0, 'r': 'zero elapsed time'} WHEN speed_kmh > 160 THEN {'l': 'low', 's': 0.0, 'r': 'speed exceeds plausibility threshold'}
  WHEN slow > 0 AND quick / slow > 2.5 THEN {'l': 'low', 's': 0.2, 'r': 'step speeds are inconsistent'}
    WHEN quick > 160 THEN {'l': 'low', 's': 0.0, 'r': 'step speed exceeds plausibility threshold'}
    WHEN len(list_filter(turns, lambda d: d >= 90)) > 0 THEN {'l': 'low', 's': 0.2, 'r': 'step headings are inconsistent'}
  WHEN n = 2 THEN {'l': 'medium', 's': 0.6, 'r': 'two-point estimate'} WHEN residual > 0.05 THEN {'l': 'low', 's': 0.25, 'r': 'high regression residual'}
    WHEN residual > 0.01 THEN {'l': 'medium', 's': 0.55, 'r': 'moderate regression residual'} ELSE {'l': 'high', 's': 0.9, 'r': 'stable multi-point history'} END AS g
    FROM speeds),
history AS (SELECT track_id, hs, turns, speed_kmh, CAST(round_even(speed_kmh / 1.60934, 0) AS INT) AS speed_mph, CASE WHEN moving AND speed_kmh >= 2 AND g.l <> 'low' THEN raw END AS heading_deg, CASE WHEN NOT moving THEN 'stationary' WHEN speed_kmh < 2 THEN 'nearly stationary' WHEN g.l = 'low' THEN 'uncertain' ELSE """ + bearing("raw") + """ END AS heading_label, g.l AS confidence_label, CAST(g.s AS DOUBLE) AS confidence_score, g.r AS confidence_reason FROM graded)""",
    "recent": """recent AS (SELECT *, CASE WHEN len(hs) >= 2 AND len(list_filter(hs[-3:], lambda x: least(abs(hs[-1] - x) % 360, 360 - abs(hs[-1] - x) % 360) > 60)) = 0 THEN """ + pmod("degrees(atan2(list_sum(list_transform(hs[-3:], lambda x: sin(radians(x)))), list_sum(list_transform(hs[-3:], lambda x: cos(radians(x))))))") + """ END AS recent_heading, CAST(len(list_filter(turns[-3:], lambda d: d >= 90)) AS INT) AS flips FROM history)""",
}

DETECTION = ["gates", "cells", "reach", "lab", "tree", "seeds", "divided", "objects"]


def chain(*names: str, then: str, **fill: str) -> str:
    """Final query over the named expressions, in order; `upto:x` is the detection chain up to x."""
    parts = []
    for n in names:
        for m in DETECTION[: DETECTION.index(n[5:]) + 1] if n.startswith("upto:") else [n]:
            text = CTES[m]
            for k, v in fill.items():
                text = text.replace("{" + k + "}", v)
            parts.append(text)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + then
