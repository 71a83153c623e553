"""Queries over whole tables, one or more for each operator, with the SQL that they are held against where SQL can say
it. Values that aren't rounded by the operator are rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import association as A
from ..operators import detection as D
from ..operators import motion as M
from ..operators import quality as Q
from ..operators import velocity as V
from ..operators.unfolding import unfold_velocity
from ..operators.labels import label_gates
from ..sources import catalog, sites, standins, volumes
from ..sources.landing import landed
from ..streaming import buffer
from ..streaming.tracker import all_tracks, scan_rows, track_scans
from . import api, replay, summary
from .ingest import Ingested, ingest
from .sql import bearing, chain, delta, even, hav, intensity, pmod, there

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.bround(c, 6)


# -- sources ----------------------------------------------------------------------------------------------------------


@query(chain("files", then="SELECT site_id, filename, scan_ts FROM dated WHERE site_id = 'S3' AND NOT filename LIKE '%\\_MDM' ESCAPE '\\' AND CAST(scan_ts AS DATE) = DATE '2024-01-15'"))
def scans_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.scans_of_day(standins.scan_files(spark, sf), "S3", "2024-01-15").select("site_id", "filename", F.col("scan_ts").cast("timestamp_ntz").alias("scan_ts"))


@query(chain("files", then="SELECT site_id, filename FROM dated d WHERE site_id = 'S4' AND NOT filename LIKE '%\\_MDM' ESCAPE '\\' AND CAST(scan_ts AS DATE) = (SELECT max(CAST(scan_ts AS DATE)) FROM dated WHERE site_id = 'S4' AND NOT filename LIKE '%\\_MDM' ESCAPE '\\' AND CAST(scan_ts AS DATE) BETWEEN DATE '2024-01-30' AND DATE '2024-01-31')"))
def latest_scans(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest_scans(standins.scan_files(spark, sf), "S4", "2024-01-31").select("site_id", "filename")


@query(chain("files", then="""
SELECT e.event_id AS request_id, 'S' || (e.user_id + 3) % 10 AS site_id, e.ts + INTERVAL 7 MINUTES AS dt, min_by(d.filename,
  {'o': abs(CAST(floor(epoch(d.scan_ts)) AS BIGINT) - CAST(floor(epoch(e.ts + INTERVAL 7 MINUTES)) AS BIGINT)), 'f': d.filename}) AS filename,
min(abs(CAST(floor(epoch(d.scan_ts)) AS BIGINT) - CAST(floor(epoch(e.ts + INTERVAL 7 MINUTES)) AS BIGINT))) AS seconds_off FROM events e LEFT
  JOIN dated d ON d.site_id = 'S' || (e.user_id + 3) % 10 AND CAST(d.scan_ts AS DATE) = CAST(e.ts + INTERVAL 7 MINUTES AS DATE) AND NOT d.filename LIKE '%\\_MDM' ESCAPE '\\'
  WHERE e.event_type = 'click' GROUP BY ALL"""))
def nearest_scans(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.nearest_scans(standins.scan_requests(spark, sf), standins.scan_files(spark, sf)).withColumn("dt", F.col("dt").cast("timestamp_ntz"))


@query(chain("files", then="""
SELECT site_id, filename, '/cache/' || site_id || '/' || filename AS path FROM files WHERE right(split_part(filename, '_V', 1), 1) IN ('0', '2', '4', '6', '8')
"""))
def cached_scans(spark: SparkSession, sf: str) -> DataFrame:
    files = standins.scan_files(spark, sf)
    even = F.substring(F.substring_index("filename", "_V", 1), -1, 1).isin("0", "2", "4", "6", "8")
    return catalog.cached_scans(files, files.filter(even)).select("site_id", "filename", catalog.cache_path("/cache/").alias("path"))


@query("""
SELECT c_custkey, n_name AS city, 'R' || n_regionkey AS state, n_nationkey + 20.5::DOUBLE AS lat, -n_nationkey - 60.25::DOUBLE AS lon FROM customer
  JOIN nation ON n_nationkey = c_nationkey
""")
def known_places(spark: SparkSession, sf: str) -> DataFrame:
    """Geocoding from a table of places: customers stand in for those who ask, nations for the places."""
    nation = standins.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("city"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("state"))
    asked = standins.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "city", "state")
    known = nation.select("city", "state", (F.col("n_nationkey") + 20.5).alias("lat"), (-F.col("n_nationkey") - 60.25).alias("lon"))
    return sites.places(asked, known)


@query(chain("files", then="""SELECT 1 AS request_id, site_id, filename FROM files WHERE site_id = 'S1' QUALIFY row_number() OVER (ORDER BY filename DESC) <= 5
UNION ALL SELECT 2, site_id, filename FROM files WHERE site_id = 'S2' AND filename <= (SELECT min(filename) FROM files WHERE site_id = 'S2' AND filename > 'S220240110')
  QUALIFY row_number() OVER (ORDER BY filename DESC) <= 3"""))
def scan_windows(spark: SparkSession, sf: str) -> DataFrame:
    files = standins.scan_files(spark, sf)
    end = files.filter("site_id = 'S2' AND filename > 'S220240110'").agg(F.lit(2).alias("request_id"), F.lit("S2").alias("site_id"), F.lit(3).alias("n"), F.min("filename").alias("end_filename"))
    asked = spark.range(1).select(F.lit(1).alias("request_id"), F.lit("S1").alias("site_id"), F.lit(5).alias("n"), F.lit(None).cast("string").alias("end_filename")).unionByName(end)
    return catalog.scan_windows(files, asked).select("request_id", "site_id", "filename")


@query(chain("files", then="""
SELECT site_id, filename FROM files WHERE site_id = 'S5' AND filename LIKE '%20240112%' QUALIFY row_number() OVER (ORDER BY filename DESC) <= 4
"""))
def local_scans(spark: SparkSession, sf: str) -> DataFrame:
    """None of the listed files is cached, so the day's cached files are taken."""
    files = standins.scan_files(spark, sf)
    return catalog.local_scans(files.filter(F.lit(False)), files, "S5", "2024-01-12", 4).select("site_id", "filename")


@query("""
SELECT vec_id // 100 AS scan_id, min(CAST(strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(5 * (vec_id // 100) AS INT)), '%Y-%m-%d %H:%M:%S') AS VARCHAR)) AS scan_ts,
  list_sort(list_distinct(list(round_even(((vec_id // 10) % 5) * 0.97::DOUBLE + 0.48, 1)))) AS elevations
  FROM embeddings GROUP BY 1 HAVING count(*) FILTER ((vec_id // 50) % 2 = 0 AND (vec_id // 10) % 5 = 0) > 0
""")
def reflectivity_headers(spark: SparkSession, sf: str) -> DataFrame:
    heads = volumes.reflectivity_scans(standins.volumes(spark, sf)[0])
    return heads.select("scan_id", F.date_format("scan_ts", "yyyy-MM-dd HH:mm:ss").alias("scan_ts"), "elevations")


@query("""SELECT vec_id // 100 AS scan_id, CAST((vec_id // 10) % 5 AS INT) AS sweep_idx, count(*) AS n, round_even(sum(v), 6) AS total FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE (vec_id // 50) % 2 = 1 AND (vec_id // 10) % 5 < 3 AND v > -0.2 GROUP BY 1, 2""")
def velocity_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The lowest three velocity sweeps; missing gates are out."""
    return volumes.velocity_gates(standins.volumes(spark, sf)[1]).groupBy("scan_id", "sweep_idx").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("vel")).alias("total"))


@query("""SELECT vec_id // 100 AS scan_id, count(*) AS n, round_even(sum(v), 6) AS total FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE (vec_id // 50) % 2 = 0 AND (vec_id // 10) % 5 = 0 AND v > -0.2 GROUP BY 1""")
def reflectivity_extract(spark: SparkSession, sf: str) -> DataFrame:
    return volumes.reflectivity_gates(standins.volumes(spark, sf)[1]).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("dbz")).alias("total"))


def _archive(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in volumes as archive files: words of 16 bits, a thousandth apart."""
    return landed(volumes.pack_volumes(*standins.volumes(spark, sf), {m: (1000.0, 32768.0) for m in volumes.MOMENT_NAMES}), "archive")


@query("""
SELECT vec_id // 100 AS scan_id, CASE WHEN (vec_id // 50) % 2 = 0 THEN 'reflectivity' ELSE 'velocity' END AS moment, CAST((vec_id // 10) % 5 AS INT) AS sweep_idx,
  CAST(vec_id % 10 AS INT) AS az_idx, count(*) AS n, round_even(sum(round_even(v * 1000 + 32768, 0) - 32768) / 1000, 6) AS total
FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE v > -0.2 GROUP BY ALL""")
def archive_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Gates of volumes that were written as archive files and decoded."""
    _, gates = volumes.archive_volumes(_archive(spark, sf))
    return gates.groupBy("scan_id", "moment", "sweep_idx", "az_idx").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("""
SELECT vec_id // 100 AS scan_id, 'KTLX' AS site_id, strftime(TIMESTAMP '2024-01-01' + INTERVAL 5 MINUTE * (vec_id // 100), '%Y-%m-%d %H:%M:%S') AS scan_ts,
  50 AS n_rays, 64 AS n_gates, CAST(65000 AS DOUBLE) AS last_m, list_sort(list(DISTINCT round_even(CAST(CAST(0.48 + 0.97 * ((vec_id // 10) % 5) AS FLOAT) AS DOUBLE), 1))) AS elevations
FROM embeddings GROUP BY vec_id // 100 HAVING min(vec_id % 100) < 10""")
def archive_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of the lowest reflectivity sweep, from archive files."""
    heads = volumes.reflectivity_scans(volumes.archive_volumes(_archive(spark, sf))[0])
    return heads.select("scan_id", "site_id", F.date_format("scan_ts", "yyyy-MM-dd HH:mm:ss").alias("scan_ts"), F.size("azimuths").alias("n_rays"), F.size("ranges_m").alias("n_gates"), F.element_at("ranges_m", -1).alias("last_m"), "elevations")


@query("""
SELECT vec_id // 100 AS scan_id, CAST((vec_id // 50) % 2 AS INT) AS sweep_idx, CAST(vec_id % 50 AS INT) AS az_idx, CAST(i AS INT) AS rng_idx,
  round_even(40 * sin(2 * pi() * (vec_id % 50) / 50) + (vec_id // 100) % 3 + 5 * v, 6) AS vel
FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE v > -0.2""")
def unfolded_gates(spark: SparkSession, sf: str) -> DataFrame:
    """A smooth wind back from velocities folded into the Nyquist interval."""
    found = unfold_velocity(standins.velocity_sweeps(spark, sf), standins.folded_gates(spark, sf))
    return found.select("scan_id", "sweep_idx", "az_idx", "rng_idx", r6("vel").alias("vel"))


@query(chain("sites", "stations", then=f"""
SELECT station_id, site_id, round_even(d, 6) AS distance_km, round_even(b, 4) AS beam_height_m, CAST(row_number() OVER (PARTITION BY station_id ORDER BY b,
  ord) AS INT) AS site_rank
FROM (SELECT *, d * 1000 * tan(radians(0.5)) + pow(d * 1000, 2) / (2 * 6371000.0) + elevation_m AS b
  FROM (SELECT s.*, t.*, {hav("t.lat", "t.lon", "s.latitude", "s.longitude")} AS d FROM stations t, sites s)) WHERE b <= 10000"""))
def rank_sites(spark: SparkSession, sf: str) -> DataFrame:
    return sites.rank_sites(standins.stations(spark, sf)).select("station_id", "site_id", r6("distance_km").alias("distance_km"), F.bround("beam_height_m", 4).alias("beam_height_m"), "site_rank")


@query(chain("sites", then="""
SELECT n_nationkey, coalesce(s.name, upper(x)) AS site_name FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'ktlx'
  WHEN n_nationkey % 3 = 1 THEN 'KABR' ELSE 'zz' || n_nationkey END AS x FROM nation) LEFT JOIN sites s ON s.site_id = upper(x)
"""))
def site_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    x = F.when(k % 3 == 0, "ktlx").when(k % 3 == 1, "KABR").otherwise(F.concat(F.lit("zz"), k.cast("string")))
    return sites.site_name(standins.table(spark, sf, "nation").select(k, x.alias("site_id")), "site_id", F.upper("site_id")).select("n_nationkey", "site_name")


# -- scalar functions -------------------------------------------------------------------------------------------------


@query(chain("stations", then=f"""SELECT station_id, round_even({hav("lat", "lon", "35.3331", "-97.2778")}, 6) AS distance_km, round_even({there("elev % 360", "station_id * 1000.0", "lat", "lon")[0]}, 6) AS to_lat, round_even({there("elev % 360", "station_id * 1000.0", "lat", "lon")[1]}, 6) AS to_lon FROM stations"""))
def geography(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = S.polar_to_lat_lon("lat", "lon", F.col("elev") % 360, F.col("station_id") * 1000.0)
    return standins.stations(spark, sf).select("station_id", r6(S.haversine_km("lat", "lon", F.lit(35.3331), F.lit(-97.2778))).alias("distance_km"), r6(lat).alias("to_lat"), r6(lon).alias("to_lon"))


@query(f"""
SELECT event_id, {intensity("value / 6")} AS intensity, {bearing("value")} AS bearing, CASE WHEN value / 10 >= 35 THEN 'strong'
  WHEN value / 10 >= 25 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN value / 500 >= 0.75 THEN 'high'
  WHEN value / 500 >= 0.45 THEN 'medium' ELSE 'low' END AS confidence,
CAST(round_even(value / 1.60934, 0) AS INT) AS miles, CAST(round_even(value / (1.60934 * 1.60934), 0) AS INT) AS square_miles, greatest(0.25, least(value / 400,
  1.0)) AS quality_factor, round_even(greatest(0.0, least(1.0, 1 - value / 100 / 10)), 2) AS match_quality
  FROM events""")
def labels_and_units(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return standins.table(spark, sf, "events").select("event_id", S.intensity_label(v / 6).alias("intensity"), S.bearing_label(v).alias("bearing"), S.rotation_strength(v / 10).alias("strength"), S.confidence_label(v / 500).alias("confidence"), S.miles(v).alias("miles"), S.square_miles(v).alias("square_miles"), S.scan_quality_factor(v / 400).alias("quality_factor"), S.match_quality(v / 100).alias("match_quality"))


@query(f"""SELECT event_id, round_even({delta("value", "nullif(event_id % 360, 7)")}, 6) AS delta_deg, round_even(coalesce({pmod("event_id % 360 - value + 540")} - 180, 0.0), 6) AS turn_deg FROM events""")
def heading_deltas(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("value"), (F.col("event_id") % 360).cast("double")
    return standins.table(spark, sf, "events").select("event_id", r6(S.heading_delta(a, F.nullif(b, F.lit(7.0)))).alias("delta_deg"), r6(S.signed_heading_delta(a, b)).alias("turn_deg"))


@query(f"""SELECT user_id, round_even({pmod("degrees(atan2(sum(sin(radians(value))), sum(cos(radians(value)))))")}, 6) AS mean_heading FROM events GROUP BY user_id""")
def circular_means(spark: SparkSession, sf: str) -> DataFrame:
    return standins.table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.sin(F.radians("value"))).alias("s"), F.sum(F.cos(F.radians("value"))).alias("c")).select("user_id", r6(F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))).alias("mean_heading"))


# -- cleaning and objects ---------------------------------------------------------------------------------------------


@query(chain("upto:lab", then="SELECT scan_id, az_idx, rng_idx, label FROM lab WHERE threshold = 20"))
def echo_components(spark: SparkSession, sf: str) -> DataFrame:
    echo = Q.echo_gates(standins.gates(spark, sf))
    return label_gates(echo, ["scan_id"], diagonal=False).select("scan_id", "az_idx", "rng_idx", "label")


@query(chain("gates", "speckle", then="SELECT * FROM speckle"))
def speckle(spark: SparkSession, sf: str) -> DataFrame:
    return Q.speckle_gates(standins.gates(spark, sf))


@query(chain("gates", "speckle", then="""
SELECT g.scan_id, g.az_idx, g.rng_idx, round_even(g.dbz, 6) AS dbz FROM gates g ANTI JOIN speckle s USING (scan_id, az_idx, rng_idx)
"""))
def clean_gates(spark: SparkSession, sf: str) -> DataFrame:
    g = standins.gates(spark, sf)
    return Q.remove_speckle(g, Q.speckle_gates(g)).withColumn("dbz", r6("dbz"))


@query(chain("gates", "speckle", then="""
SELECT scan_id, round_even(greatest(0.0, least(1.0, 1 - (1 - n / 3200.0) * 0.7 - least(gone / 3200.0 * 20, 0.3))), 3) AS score, round_even(n / 3200.0,
  3) AS finite_fraction, gone AS removed_speckle_pixels, round_even(gone / 3200.0, 5) AS removed_speckle_fraction,
list_filter([CASE WHEN 1 - n / 3200.0 >= 0.35 THEN 'high_missing_fraction' END, CASE WHEN gone > 0 THEN 'speckle_filtered' END, CASE
  WHEN echo <= gone THEN 'no_object_scale_echo' END], lambda x: x IS NOT NULL) AS flags
FROM (SELECT scan_id, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (dbz >= 20) AS echo, (SELECT count(*) FROM speckle s WHERE s.scan_id = g.scan_id) AS gone
  FROM gates g GROUP BY scan_id)"""))
def scan_quality(spark: SparkSession, sf: str) -> DataFrame:
    g = standins.gates(spark, sf)
    return Q.scan_quality(standins.scans(spark, sf), g, Q.speckle_gates(g))


@query(chain("upto:tree", then="SELECT scan_id, blob, node_id, threshold, label, parent_node_id, pixel_count, round_even(peak_dbz, 6) AS peak_dbz, branch FROM tree"))
def threshold_tree(spark: SparkSession, sf: str) -> DataFrame:
    return D.threshold_tree(D.threshold_labels(standins.gates(spark, sf))).withColumn("peak_dbz", r6("peak_dbz"))


@query(chain("upto:seeds", then="""
SELECT scan_id, blob, node_id, threshold, list_filter([20.0, 30.0, 40.0, 50.0, 60.0], lambda t: t <= threshold)::DOUBLE[] AS threshold_path FROM leaves
"""))
def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return D.threshold_paths(D.tree_leaves(D.threshold_tree(D.threshold_labels(standins.gates(spark, sf))))).select("scan_id", "blob", "node_id", "threshold", "threshold_path")


@query(chain("upto:seeds", then="SELECT scan_id, blob, seed, CAST(threshold AS DOUBLE) AS threshold, label FROM seeds"))
def split_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return D.split_seeds(D.threshold_tree(D.threshold_labels(standins.gates(spark, sf))))


@query(chain("upto:divided", then="SELECT scan_id, blob, seed, az_idx, rng_idx FROM divided"))
def divided_gates(spark: SparkSession, sf: str) -> DataFrame:
    labels = D.threshold_labels(standins.gates(spark, sf))
    return D.divide_gates(labels, D.split_seeds(D.threshold_tree(labels))).select("scan_id", "blob", "seed", "az_idx", "rng_idx")


def _detected(spark: SparkSession, sf: str) -> D.Detection:
    return D.detect_objects(standins.scans(spark, sf), standins.gates(spark, sf))


@query(chain("upto:objects", then="""
SELECT scan_id, object_id, centroid_lat, centroid_lon, distance_km, bearing_deg, peak_dbz, peak_label, area_km2, pixel_count, rank FROM objects
"""))
def objects(spark: SparkSession, sf: str) -> DataFrame:
    return _detected(spark, sf).objects.select("scan_id", "object_id", "centroid_lat", "centroid_lon", "distance_km", "bearing_deg", "peak_dbz", "peak_label", "area_km2", "pixel_count", "rank")


@query(chain("upto:objects", then="""SELECT scan_id, object_id, label, CAST(min_dbz AS DOUBLE) AS min_dbz, round_even(a, 2) AS area_km2 FROM (SELECT scan_id, object_id, unnest([l20, l30, l40, l50, l60]) AS a, unnest(['light rain', 'moderate rain', 'heavy rain', 'intense rain', 'severe core']) AS label, unnest([20, 30, 40, 50, 60]) AS min_dbz FROM objects) WHERE a > 0"""))
def object_layers(spark: SparkSession, sf: str) -> DataFrame:
    return _detected(spark, sf).objects.select("scan_id", "object_id", F.explode("layers").alias("l")).select("scan_id", "object_id", "l.label", "l.min_dbz", "l.area_km2")


@query(chain("upto:objects", then="""SELECT o.scan_id, o.object_id, o.min_row, o.min_col, o.max_row, o.max_col, s.threshold AS threshold_level, s.parent_node_id AS threshold_parent_id, list_filter([20.0, 30.0, 40.0, 50.0, 60.0], lambda t: t <= s.threshold)::DOUBLE[] AS threshold_path FROM objects o JOIN tree s USING (scan_id, blob) QUALIFY row_number() OVER (PARTITION BY o.scan_id, o.object_id ORDER BY s.threshold DESC, s.pixel_count DESC, s.peak_dbz DESC, s.node_id) = 1"""))
def object_segments(spark: SparkSession, sf: str) -> DataFrame:
    found = _detected(spark, sf)
    return D.segmented(found.objects, found.hierarchy).select("scan_id", "object_id", "min_row", "min_col", "max_row", "max_col", "threshold_level", "threshold_parent_id", "threshold_path")


# -- wind -------------------------------------------------------------------------------------------------------------


@query(chain("vgates", "wind", "regions", then="SELECT * FROM regions"))
def sweep_regions(spark: SparkSession, sf: str) -> DataFrame:
    return V.sweep_regions(standins.velocity_sweeps(spark, sf), V.wind_gates(standins.velocity_gates(spark, sf)))


@query(chain("vgates", "wind", then="""
SELECT scan_id, region_type, sweep_a, label_a, sweep_b, label_b, shared, round_even(shared / (na + nb - shared), 6) AS iou
  FROM (SELECT a.scan_id, a.region_type, a.sweep_idx AS sweep_a, a.label AS label_a, b.sweep_idx AS sweep_b, b.label AS label_b, count(*) AS shared, any_value(a.n) AS na,
  any_value(b.n) AS nb
FROM (SELECT *, count(*) OVER (PARTITION BY scan_id, sweep_idx, region_type, label) AS n FROM wind) a
  JOIN (SELECT *, count(*) OVER (PARTITION BY scan_id, sweep_idx, region_type, label) AS n FROM wind) b USING (scan_id, region_type, az_idx, rng_idx)
  WHERE a.sweep_idx < b.sweep_idx GROUP BY ALL)"""))
def region_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return V.region_overlaps(V.wind_gates(standins.velocity_gates(spark, sf))).select("scan_id", "region_type", "sweep_a", "label_a", "sweep_b", "label_b", "shared", r6("iou").alias("iou"))


MERGED_REGIONS = """
SELECT scan_id, region_id, y.kind AS region_type, y.peak AS peak_velocity_ms, y.mean AS mean_velocity_ms, y.area AS area_km2, y.lat AS centroid_lat,
  y.lon AS centroid_lon,
  y.km AS distance_km, y.deg AS bearing_deg, y.n AS sweep_count, y.els AS elevation_angles
FROM merged_regions
"""


@query(chain("vgates", "wind", "regions", "merged_regions", then=MERGED_REGIONS))
def velocity_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Merged across sweeps in order; the SQL folds over them the same way."""
    return V.velocity_regions(standins.velocity_sweeps(spark, sf), standins.velocity_gates(spark, sf))


@query(chain("vgates", "shear", then="""
SELECT scan_id, sweep_idx, az_idx, rng_idx, round_even(shear, 6) AS shear, round_even(inbound, 6) AS inbound, round_even(outbound, 6) AS outbound FROM shear
"""))
def shear_gates(spark: SparkSession, sf: str) -> DataFrame:
    found = V.shear_gates(standins.velocity_sweeps(spark, sf), standins.velocity_gates(spark, sf))
    return found.withColumns({c: r6(c) for c in ("shear", "inbound", "outbound")})


SWEEP_ROTATIONS = """
SELECT scan_id, sweep_idx, label, centroid_lat, centroid_lon, distance_km, bearing_deg, max_shear_ms, max_inbound_ms, max_outbound_ms, diameter_km, elevation, strength
FROM rotations
"""


@query(chain("vgates", "shear", "rotations", then=SWEEP_ROTATIONS))
def sweep_rotations(spark: SparkSession, sf: str) -> DataFrame:
    sweeps = standins.velocity_sweeps(spark, sf)
    return V.sweep_rotations(sweeps, V.shear_gates(sweeps, standins.velocity_gates(spark, sf))).drop("azimuth", "range_m")


MERGED_ROTATIONS = """
SELECT scan_id, rotation_id, y.lat AS centroid_lat, y.lon AS centroid_lon, y.km AS distance_km, y.deg AS bearing_deg, y.shear AS max_shear_ms, y.low AS max_inbound_ms,
  y.high AS max_outbound_ms, y.wide AS diameter_km, y.n AS sweep_count, y.els AS elevation_angles, y.strength AS strength
FROM merged_rotations
"""


@query(chain("vgates", "shear", "rotations", "merged_rotations", then=MERGED_ROTATIONS))
def rotation_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Merged across sweeps in order; the SQL folds over them the same way."""
    return V.rotation_signatures(standins.velocity_sweeps(spark, sf), standins.velocity_gates(spark, sf))


@query(chain("upto:objects", "vgates", "wind", "regions", then=f"""SELECT o.scan_id, o.object_id, min(r.peak_velocity_ms) FILTER (r.region_type = 'inbound') AS max_inbound_ms, max(r.peak_velocity_ms) FILTER (r.region_type = 'outbound') AS max_outbound_ms FROM objects o LEFT JOIN regions r ON r.scan_id = o.scan_id AND {hav("o.centroid_lat", "o.centroid_lon", "r.centroid_lat", "r.centroid_lon")} <= 30 GROUP BY o.scan_id, o.object_id"""))
def objects_with_wind(spark: SparkSession, sf: str) -> DataFrame:
    regions = V.sweep_regions(standins.velocity_sweeps(spark, sf), V.wind_gates(standins.velocity_gates(spark, sf)))
    return V.objects_with_wind(_detected(spark, sf).objects, regions).select("scan_id", "object_id", "max_inbound_ms", "max_outbound_ms")


NEAREST_ROTATION = f"""
SELECT o.scan_id, o.object_id, arg_min(r.max_shear_ms, {{'d': d, 'k': r.sweep_idx * 1000000000 + r.label}}) AS max_shear_ms
FROM objects o LEFT JOIN (SELECT o.scan_id AS s, o.object_id AS i, r.*, {hav("o.centroid_lat", "o.centroid_lon", "r.centroid_lat", "r.centroid_lon")} AS d
  FROM objects o JOIN rotations r ON r.scan_id = o.scan_id) r ON r.s = o.scan_id AND r.i = o.object_id AND r.d <= 30
GROUP BY o.scan_id, o.object_id
"""


@query(chain("upto:objects", "vgates", "shear", "rotations", then=NEAREST_ROTATION))
def objects_with_rotation(spark: SparkSession, sf: str) -> DataFrame:
    sweeps = standins.velocity_sweeps(spark, sf)
    rotations = V.sweep_rotations(sweeps, V.shear_gates(sweeps, standins.velocity_gates(spark, sf))).withColumn("rotation_id", F.col("sweep_idx") * 1_000_000_000 + F.col("label"))
    return V.objects_with_rotation(_detected(spark, sf).objects, rotations).select("scan_id", "object_id", F.col("rotation.max_shear_ms").alias("max_shear_ms"))


# -- association ------------------------------------------------------------------------------------------------------

PAIRS = """og AS (SELECT d.scan_id, o.object_id, d.az_idx, d.rng_idx FROM divided d JOIN objects o ON o.scan_id = d.scan_id AND o.blob = d.blob AND o.seed = d.seed),
sz AS (SELECT scan_id, object_id, count(*) AS n FROM og GROUP BY ALL), moved AS (SELECT scan_id, object_id, az_idx + 2 AS az_idx, rng_idx - 1 AS rng_idx FROM og
  WHERE az_idx + 2 < 50 AND rng_idx >= 1),
msz AS (SELECT scan_id, object_id, count(*) AS n FROM moved GROUP BY ALL),
ov AS (SELECT b.scan_id AS pair_id, a.object_id AS prev_id, b.object_id, count(*) AS shared, count(*) / any_value(s.n) AS overlap,
  count(*) / (any_value(s.n) + any_value(z.n) - count(*)) AS iou
  FROM og a JOIN og b ON b.scan_id = a.scan_id + 1 AND a.az_idx = b.az_idx AND a.rng_idx = b.rng_idx JOIN sz s ON s.scan_id = a.scan_id AND s.object_id = a.object_id
  JOIN sz z ON z.scan_id = b.scan_id AND z.object_id = b.object_id GROUP BY ALL),
adv AS (SELECT b.scan_id AS pair_id, a.object_id AS prev_id, b.object_id, count(*) AS shared, count(*) / any_value(s.n) AS overlap,
  count(*) / (any_value(s.n) + any_value(z.n) - count(*)) AS iou
  FROM moved a JOIN og b ON b.scan_id = a.scan_id + 1 AND a.az_idx = b.az_idx AND a.rng_idx = b.rng_idx JOIN msz s ON s.scan_id = a.scan_id AND s.object_id = a.object_id
  JOIN sz z ON z.scan_id = b.scan_id AND z.object_id = b.object_id GROUP BY ALL)"""

SCORES = PAIRS + f""",
cand AS (SELECT b.scan_id AS pair_id, a.object_id AS track_id, b.object_id, coalesce(v.overlap, 0.0) AS overlap, coalesce(w.iou, 0.0) AS advected,
  {hav("a.centroid_lat", "a.centroid_lon", "b.centroid_lat", "b.centroid_lon")} AS dist, {hav("(a.centroid_lat + 0.01)", "(a.centroid_lon - 0.01)", "b.centroid_lat",
  "b.centroid_lon")} AS off, a.area_km2 AS a1, b.area_km2 AS a2, a.peak_dbz AS p1, b.peak_dbz AS p2
  FROM objects a JOIN objects b ON b.scan_id = a.scan_id + 1 LEFT JOIN ov v ON v.pair_id = b.scan_id AND v.prev_id = a.object_id AND v.object_id = b.object_id LEFT
    JOIN adv w ON w.pair_id = b.scan_id AND w.prev_id = a.object_id AND w.object_id = b.object_id),
scores AS (SELECT pair_id, track_id, object_id, round_even(overlap, 4) AS overlap_score, round_even(advected, 4) AS advected_overlap_score,
  round_even(least(dist / 10.0, 5.0), 4) AS distance_score, round_even(least(off / 10.0, 5.0), 4) AS predicted_position_score, round_even(abs(a2 - a1) / greatest(a1,
  1.0), 4) AS area_change_score, round_even(abs(p2 - p1) / 60, 4) AS intensity_change_score,
  round_even((1 - greatest(overlap, advected)) * 0.65 + least(off / 10.0, 5.0) * 0.18 + least(dist / 10.0, 5.0) * 0.07 + abs(a2 - a1) / greatest(a1,
    1.0) * 0.07 + abs(p2 - p1) / 60 * 0.03, 4) AS total_cost
    FROM cand WHERE NOT (overlap < 0.3 AND advected < 0.15 AND dist > 10.0))"""


def _with(names: str, extra: str, then: str) -> str:
    return chain(names, then="").rstrip() + ",\n" + extra + "\n" + then


def _masks(spark: SparkSession, sf: str) -> tuple[D.Detection, DataFrame, DataFrame]:
    """(detection, masks of each scan under the next one's id, masks under their own)."""
    found = _detected(spark, sf)
    g = found.object_gates
    before = g.select((F.col("scan_id") + 1).alias("pair_id"), "object_id", "az_idx", "rng_idx")
    return found, before, g.select(F.col("scan_id").alias("pair_id"), "object_id", "az_idx", "rng_idx")


def _moved(before: DataFrame, after: DataFrame) -> DataFrame:
    ids = after.select("pair_id").distinct()
    return A.mask_overlaps(before, after, ids.withColumns({"rows": F.lit(2.2), "cols": F.lit(-0.8)}), ids.withColumns({"n_az": F.lit(standins.N_AZ), "n_rng": F.lit(standins.N_RNG)}))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every object of a scan as a track into the next, five minutes on."""
    found, before, after = _masks(spark, sf)
    o = found.objects.select("scan_id", "object_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"), F.col("area_km2").alias("area"), F.col("peak_dbz").alias("peak"))
    tracks = o.select((F.col("scan_id") + 1).alias("pair_id"), F.col("object_id").alias("track_id"), F.col("object_id").alias("prev_id"), "lat", "lon", "area", "peak", (F.col("lat") + 0.01).alias("predicted_lat"), (F.col("lon") - 0.01).alias("predicted_lon"))
    return A.candidate_scores(tracks, o.withColumnRenamed("scan_id", "pair_id"), A.mask_overlaps(before, after), _moved(before, after), F.lit(5 / 60))


@query("""
SELECT 'KTLX' AS site_id, s - 1 AS previous_id, s AS scan_id, round_even(5 / 60.0, 6) AS hours FROM (SELECT DISTINCT vec_id // 50 AS s FROM embeddings) WHERE s > 0
""")
def scan_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return A.scan_pairs(standins.scans(spark, sf)).withColumn("hours", r6("hours"))


@query(_with("upto:objects", PAIRS, "SELECT pair_id, prev_id, object_id, shared, round_even(overlap, 6) AS overlap, round_even(iou, 6) AS iou FROM ov"))
def mask_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    _, before, after = _masks(spark, sf)
    return A.mask_overlaps(before, after).withColumns({c: r6(c) for c in ("overlap", "iou")})


@query(_with("upto:objects", PAIRS, "SELECT pair_id, prev_id, object_id, shared, round_even(overlap, 6) AS overlap, round_even(iou, 6) AS iou FROM adv"))
def advected_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    _, before, after = _masks(spark, sf)
    return _moved(before, after).withColumns({c: r6(c) for c in ("overlap", "iou")})


@query(_with("upto:objects", SCORES, "SELECT * FROM scores"))
def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


IDENTITY = f"""
leads AS (SELECT *, list_sort(list(total_cost) OVER (PARTITION BY pair_id, object_id)) AS of_object,
  list_sort(list(total_cost) OVER (PARTITION BY pair_id, track_id)) AS of_track
  FROM scores),
margins AS (SELECT *, {even("least(of_object[2] - of_object[1], of_track[2] - of_track[1])", 2)} AS margin,
  {even("greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - total_cost / 10))", 2)} AS match_quality FROM leads),
graded AS (SELECT *, match_quality * 0.45::DOUBLE + CASE
  WHEN margin IS NULL THEN 0.7::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, margin / 0.75::DOUBLE)) END * 0.2::DOUBLE
  + 0.8::DOUBLE * 0.15::DOUBLE + (1 - 0.08::DOUBLE) * 0.2::DOUBLE AS score FROM margins)"""


@query(_with("upto:objects", SCORES + "," + IDENTITY, f"""
SELECT pair_id, track_id, object_id, total_cost, margin, match_quality, CASE
  WHEN margin < 0.15 THEN least({even("score", 2)}, 0.4::DOUBLE) ELSE {even("score", 2)} END AS identity_score
FROM graded
"""))
def identity_scores(spark: SparkSession, sf: str) -> DataFrame:
    graded = A.identity_scores(A.ambiguity_margins(_scores(spark, sf)), F.lit(0.8), F.lit(1))
    return graded.select("pair_id", "track_id", "object_id", "total_cost", "margin", "match_quality", "identity_score")


#: The optimal matches by shortest augmenting paths, a step of a path in each turn of the recursion, with whole numbers as
#: costs. The smaller side's members are `row`s 1 to n, the other's `j`s; owner is the row that has j, or 0; trail is the
#: path to j; least is what j would cost; reached tells the j's that the path has taken.
OPTIMAL = """
sides AS (SELECT pair_id, list_sort(list_distinct(list(track_id))) AS ts, list_sort(list_distinct(list(object_id))) AS os FROM scores GROUP BY pair_id),
oriented AS (SELECT pair_id, len(ts) > len(os) AS flipped, CASE WHEN len(ts) > len(os) THEN os ELSE ts END AS few, CASE WHEN len(ts) > len(os) THEN ts ELSE os END AS many FROM sides),
facing_cells AS (SELECT pair_id, flipped, a, r, b, j FROM (SELECT pair_id, flipped, many, unnest(few) AS a, generate_subscripts(few, 1) AS r FROM oriented) x,
  LATERAL (SELECT unnest(x.many) AS b, generate_subscripts(x.many, 1) AS j)),
cost_rows AS MATERIALIZED (SELECT c.pair_id, c.r, list(coalesce(CAST(round(s.total_cost * 10000) AS BIGINT), 100000) ORDER BY c.j) AS costs
  FROM facing_cells c LEFT JOIN scores s ON s.pair_id = c.pair_id AND s.track_id = CASE WHEN flipped THEN b ELSE a END AND s.object_id = CASE WHEN flipped THEN a ELSE b END
  GROUP BY c.pair_id, c.r),
turns AS (
  SELECT pair_id, len(few) AS n, 1 AS beginning, 1 AS "row", 0 AS taken, list_transform(few, lambda x: 0::BIGINT) AS u, list_transform(many, lambda x: 0::BIGINT) AS v,
    list_transform(many, lambda x: 0) AS owner, list_transform(many, lambda x: 1000000000000::BIGINT) AS least,
    list_transform(many, lambda x: []::INTEGER[]) AS trail, list_transform(many, lambda x: false) AS reached
  FROM oriented
  UNION ALL
  SELECT pair_id, n, CASE WHEN ends THEN beginning + 1 ELSE beginning END, CASE WHEN ends THEN beginning + 1 ELSE owner[best] END, CASE WHEN ends THEN 0 ELSE best END,
    list_transform(u, lambda x, i: CASE WHEN i = beginning OR list_contains(list_filter(owner, lambda o, j: reached[j]), i) THEN x + step ELSE x END),
    list_transform(v, lambda x, j: CASE WHEN reached[j] THEN x - step ELSE x END),
    CASE WHEN ends THEN list_transform(owner, lambda x, j: CASE
      WHEN NOT list_contains(path, j) THEN x WHEN path[1] = j THEN beginning ELSE owner[path[list_position(path, j) - 1]] END) ELSE owner END,
    CASE WHEN ends THEN list_transform(v, lambda x: 1000000000000::BIGINT) ELSE list_transform(nearer, lambda x, j: CASE WHEN reached[j] THEN x ELSE x - step END) END,
    CASE WHEN ends THEN list_transform(v, lambda x: []::INTEGER[]) ELSE trails END,
    CASE WHEN ends THEN list_transform(v, lambda x: false) ELSE list_transform(reached, lambda x, j: x OR j = best) END
  FROM (SELECT *, owner[best] = 0 AS ends, trails[best] AS path FROM (
    SELECT *, list_min(list_filter(nearer, lambda x, j: NOT reached[j])) AS step,
      list_position(list_transform(nearer, lambda x, j: CASE WHEN reached[j] THEN NULL ELSE x END), list_min(list_filter(nearer, lambda x, j: NOT reached[j]))) AS best
    FROM (SELECT t.*, list_transform(least, lambda x, j: CASE WHEN NOT reached[j] AND costs[j] - u["row"] - v[j] < x THEN costs[j] - u["row"] - v[j] ELSE x END) AS nearer,
        list_transform(trail, lambda x, j: CASE
          WHEN NOT reached[j] AND costs[j] - u["row"] - v[j] < least[j] THEN list_append(CASE WHEN taken = 0 THEN []::INTEGER[] ELSE trail[taken] END, CAST(j AS INTEGER)) ELSE x END) AS trails
      FROM turns t JOIN cost_rows c ON c.pair_id = t.pair_id AND c.r = t."row" WHERE beginning <= n)))),
assigned AS (SELECT pair_id, unnest(owner) AS r, generate_subscripts(owner, 1) AS j FROM turns WHERE beginning > n),
optimal AS (SELECT s.pair_id, s.track_id, s.object_id, s.total_cost FROM assigned a JOIN facing_cells c ON c.pair_id = a.pair_id AND c.r = a.r AND c.j = a.j
  JOIN scores s ON s.pair_id = c.pair_id AND s.track_id = CASE WHEN flipped THEN b ELSE a END AND s.object_id = CASE WHEN flipped THEN a ELSE b END
  WHERE s.total_cost < 10)"""
MATCHED = SCORES.replace("scores AS (", "scores AS MATERIALIZED (") + "," + OPTIMAL


@query(_with("upto:objects", MATCHED, "SELECT * FROM optimal"))
def matches(spark: SparkSession, sf: str) -> DataFrame:
    """Optimal assignment."""
    return A.match_tracks(_scores(spark, sf))


@query(_with("upto:objects", MATCHED, """
SELECT pair_id, n_matches, cost, cost AS bound, true AS proven FROM (
  SELECT pair_id, count(o.track_id) AS n_matches, round(coalesce(sum(o.total_cost), 0) + 10 * (max(len(few)) - count(o.track_id)), 4) AS cost
  FROM oriented LEFT JOIN optimal o USING (pair_id) GROUP BY pair_id)
"""))
def match_proofs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair's least cost, and the bound on it that its prices give."""
    scores = landed(_scores(spark, sf), "scores")
    proofs = A.match_proofs(scores, landed(A.priced_matches(scores), "priced"))
    proven = (F.abs(F.col("cost") - F.col("bound")) < 1e-6) & (F.col("slack") > -1e-6) & (F.col("room") > -1e-6)
    return proofs.select("pair_id", "n_matches", F.round("cost", 4).alias("cost"), F.round("bound", 4).alias("bound"), proven.alias("proven"))


@query(_with("upto:objects", MATCHED, """
SELECT pair_id, object_id, list_concat([track_id], others) AS track_ids
FROM (SELECT m.pair_id, m.object_id, m.track_id, list(s.track_id ORDER BY s.total_cost, s.track_id) AS others FROM optimal m
  JOIN scores s ON s.pair_id = m.pair_id AND s.object_id = m.object_id AND s.track_id <> m.track_id GROUP BY ALL)
"""))
def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    scores = landed(_scores(spark, sf), "scores")
    return A.merge_candidates(scores, A.match_tracks(scores))


@query(_with("upto:objects", MATCHED + """,
placed_scores AS (SELECT *, row_number() OVER (PARTITION BY pair_id, object_id ORDER BY total_cost, track_id) AS by_object FROM scores)""", """
SELECT pair_id, track_id, list_concat([object_id], others) AS object_ids
FROM (SELECT m.pair_id, m.track_id, m.object_id, list(s.object_id ORDER BY s.total_cost, s.object_id) AS others FROM optimal m
  JOIN placed_scores s ON s.pair_id = m.pair_id AND s.track_id = m.track_id AND s.object_id <> m.object_id AND s.by_object = 1 GROUP BY ALL)
"""))
def split_candidates(spark: SparkSession, sf: str) -> DataFrame:
    scores = landed(_scores(spark, sf), "scores")
    return A.split_candidates(scores, A.match_tracks(scores))


@query("""SELECT o_custkey AS pair_id, 'merge' AS event_type, 'Tracks ' || list_aggregate(others, 'string_agg', ', ') || ' merged into track ' || o_custkey % 7 AS description, list_concat([o_custkey % 7], others) AS involved_track_ids FROM (SELECT o_custkey, list_filter(list_sort(list_distinct(list(o_orderkey % 7))), lambda x: x <> o_custkey % 7) AS others FROM orders GROUP BY o_custkey) WHERE len(others) > 0""")
def merge_events(spark: SparkSession, sf: str) -> DataFrame:
    each = standins.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pair_id")).agg(F.array_sort(F.collect_list(F.col("o_orderkey") % 7)).alias("other_ids"))
    return A.merge_events(each.withColumn("track_id", F.col("pair_id") % 7))


@query("""
SELECT o_custkey AS pair_id, 'split' AS event_type, 'Track ' || o_custkey % 7 || ' split into tracks ' || list_aggregate(others, 'string_agg', ', ') AS description,
  list_concat([o_custkey % 7], others) AS involved_track_ids
FROM (SELECT o_custkey, list_filter(list_sort(list_distinct(list(o_orderkey % 7))), lambda x: x <> o_custkey % 7) AS others FROM orders GROUP BY o_custkey)
  WHERE len(others) > 0
""")
def split_events(spark: SparkSession, sf: str) -> DataFrame:
    each = standins.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pair_id")).agg(F.array_sort(F.collect_list(F.col("o_orderkey") % 7)).alias("other_ids"))
    return A.split_events(each.withColumn("track_id", F.col("pair_id") % 7))


@query(chain("upto:objects", then="""
SELECT a.pair_id, round_even(b.lat - a.lat, 4) AS delta_lat, round_even(b.lon - a.lon, 4) AS delta_lon, round_even(least(a.w, b.w) / greatest(a.w, b.w),
  3) AS quality FROM
(SELECT scan_id + 1 AS pair_id, sum(greatest(area_km2, 0.1) * greatest(peak_dbz, 20.0)) AS w,
  sum(centroid_lat * greatest(area_km2, 0.1) * greatest(peak_dbz, 20.0)) / w AS lat, sum(centroid_lon * greatest(area_km2, 0.1) * greatest(peak_dbz, 20.0)) / w AS lon
  FROM objects GROUP BY 1) a JOIN
(SELECT scan_id AS pair_id, sum(greatest(area_km2, 0.1) * greatest(peak_dbz, 20.0)) AS w,
  sum(centroid_lat * greatest(area_km2, 0.1) * greatest(peak_dbz, 20.0)) / w AS lat, sum(centroid_lon * greatest(area_km2, 0.1) * greatest(peak_dbz, 20.0)) / w AS lon
  FROM objects GROUP BY 1) b USING (pair_id)"""))
def object_shifts(spark: SparkSession, sf: str) -> DataFrame:
    o = _detected(spark, sf).objects.select("scan_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"), F.col("area_km2").alias("area"), F.col("peak_dbz").alias("peak"))
    return A.object_shift(o.withColumn("pair_id", F.col("scan_id") + 1), o.withColumn("pair_id", F.col("scan_id")))


BLEND = """e AS (SELECT event_id, (event_id % 11 - 5) / 400.0::DOUBLE AS gl, (event_id % 7 - 3) / 400.0::DOUBLE AS go, (event_id % 10) / 10.0::DOUBLE AS gq, value / 30000 - 0.006 AS ll, value / 40000 - 0.006 AS lo, (event_id % 13) / 12.0::DOUBLE AS lq FROM events)"""


@query(f"""
WITH {BLEND} SELECT event_id, CASE k WHEN 1 THEN gl WHEN 2 THEN ll ELSE round_even((ll * lq + gl * gq * 0.6) / (lq + gq * 0.6), 4) + 0.0 END AS delta_lat, CASE k
  WHEN 1 THEN go WHEN 2 THEN lo ELSE round_even((lo * lq + go * gq * 0.6) / (lq + gq * 0.6), 4) + 0.0 END AS delta_lon, CASE k WHEN 1 THEN gq
  WHEN 2 THEN lq ELSE round_even(least(1.0, greatest(lq, gq)), 3) END AS quality, CASE k WHEN 1 THEN 'scene' WHEN 2 THEN 'local' ELSE 'blended:scene+local' END AS source
FROM (SELECT *, CASE WHEN lq <= 0 THEN 1 WHEN gq <= 0 THEN 2 WHEN lq < 0.6 OR (gq >= 0.35 AND sqrt(pow(ll - gl, 2) + pow(lo - go, 2)) > 0.03) THEN 1 ELSE 3 END AS k
  FROM e)""")
def blended_shifts(spark: SparkSession, sf: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    scene = F.struct(((k % 11 - 5) / 400.0).alias("delta_lat"), ((k % 7 - 3) / 400.0).alias("delta_lon"), ((k % 10) / 10.0).alias("quality"), F.lit("scene").alias("source"))
    local = F.struct((v / 30000 - 0.006).alias("delta_lat"), (v / 40000 - 0.006).alias("delta_lon"), ((k % 13) / 12.0).alias("quality"), F.lit("local").alias("source"))
    rows = standins.table(spark, sf, "events").select("event_id", scene.alias("scene"), local.alias("local"))
    return rows.select("event_id", A.blended_shift(F.col("scene"), F.col("local")).alias("s")).select("event_id", "s.*")


# -- motion -----------------------------------------------------------------------------------------------------------


@query(chain("positions", "steps_of", then="""
SELECT track_id, position_id, round_even(speed_kmh, 4) AS speed_kmh, round_even(heading_deg, 6) AS heading_deg FROM steps_of
""", positions="positions"))
def track_steps(spark: SparkSession, sf: str) -> DataFrame:
    return M.track_steps(standins.positions(spark, sf)).select("track_id", "position_id", F.bround("speed_kmh", 4).alias("speed_kmh"), r6("heading_deg").alias("heading_deg"))


MOTION = ["speed_kmh", "speed_mph", "heading_deg", "heading_label", "confidence_label", "confidence_score", "confidence_reason"]


@query(chain("positions", "steps_of", "history", then=f"SELECT track_id, {', '.join(MOTION)} FROM history", positions="positions"))
def track_motion(spark: SparkSession, sf: str) -> DataFrame:
    return M.history_motion(standins.positions(spark, sf)).select("track_id", *[f"motion.{c}" for c in MOTION])


@query(chain("hourly", "steps_of", "history", then=f"SELECT track_id, {', '.join(MOTION)} FROM history", positions="hourly"))
def drifting_motion(spark: SparkSession, sf: str) -> DataFrame:
    return M.history_motion(standins.hourly_positions(spark, sf)).select("track_id", *[f"motion.{c}" for c in MOTION])


@query(chain("hourly", "steps_of", "history", "recent", then="SELECT track_id, round_even(recent_heading, 6) AS recent_heading, flips FROM recent", positions="hourly"))
def recent_headings(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("headings")
    return M.history_motion(standins.hourly_positions(spark, sf)).select("track_id", r6(M.recent_heading(h)).alias("recent_heading"), M.heading_flips(h).alias("flips"))


def _field_sql(prefix: str = "") -> str:
    return f"""
field AS (SELECT *, CASE WHEN sp > 160 THEN 0.0 ELSE sp END AS f_speed, CASE WHEN sp > 160 THEN 'uncertain'
  WHEN sp < 2 THEN 'nearly stationary' ELSE {bearing("hd")} END AS f_label, CASE WHEN sp <= 160 AND sp >= 2 THEN hd END AS f_heading, CASE WHEN sp > 160 THEN 'low'
  WHEN sp >= 2 AND q >= 0.75 THEN 'high' WHEN q >= 0.35 THEN 'medium' ELSE 'low' END AS f_conf, CASE WHEN sp > 160 THEN 0.0 ELSE round_even(q, 2) END AS f_score, CASE
  WHEN sp > 160 THEN 'suppressed' ELSE 'motion_field' END AS f_source
  FROM (SELECT *, round_even(sqrt(pow(dla * 111.32, 2) + pow(dlo * 111.32 * cos(radians(35.0)), 2)) / hours, 1) AS sp,
    round_even({pmod("degrees(atan2(dlo * 111.32 * cos(radians(35.0)), dla * 111.32))")}, 1) AS hd FROM {prefix}))"""


@query("WITH src AS (SELECT event_id, (event_id % 21 - 10) / 100.0::DOUBLE AS dla, value / 2000 - 0.12 AS dlo, (event_id % 11) / 10.0::DOUBLE AS q, 0.2::DOUBLE AS hours FROM events), " + _field_sql("src") + " SELECT event_id, f_speed AS speed_kmh, CAST(round_even(f_speed / 1.60934, 0) AS INT) AS speed_mph, f_heading AS heading_deg, f_label AS heading_label, f_conf AS confidence_label, f_score AS confidence_score, f_source AS source FROM field")
def field_motion(spark: SparkSession, sf: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    rows = standins.table(spark, sf, "events").select("event_id", ((k % 21 - 10) / 100.0).alias("dla"), (v / 2000 - 0.12).alias("dlo"), ((k % 11) / 10.0).alias("q"))
    return rows.select("event_id", M.field_motion(F.col("dla"), F.col("dlo"), F.col("q"), F.lit("scene"), F.lit(0.2)).alias("m")).select("event_id", *[f"m.{c}" for c in ("speed_kmh", "speed_mph", "heading_deg", "heading_label", "confidence_label", "confidence_score", "source")])


_DIRECTED = "{} NOT IN ('uncertain', 'stationary', 'nearly stationary')"


def _reported_sql() -> str:
    src = "src AS (SELECT r.*, (track_id % 21 - 10) / 200.0::DOUBLE AS dla, (track_id % 17 - 8) / 200.0::DOUBLE AS dlo, (track_id % 11) / 10.0::DOUBLE AS q, 1.0::DOUBLE AS hours, (track_id % 20) / 20.0::DOUBLE AS ident, ['matched', 'new_track', 'split_child', NULL][track_id % 4 + 1] AS ctx, CASE WHEN track_id % 3 = 0 THEN (track_id % 9) / 10.0::DOUBLE END AS margin, track_id % 8 AS ev FROM recent r)"
    against = f"recent_heading IS NOT NULL AND {_DIRECTED.format('heading_label')} AND {delta('heading_deg', 'recent_heading')} >= 75"
    f_against = f"recent_heading IS NOT NULL AND {_DIRECTED.format('f_label')} AND {delta('f_heading', 'recent_heading')} >= 75"
    doubtful = "((ev >= 6 AND ident < 0.75) OR (coalesce(margin < 0.4, false) AND ident < 0.75) OR (coalesce(ctx IN ('new_track', 'split_child', 'merge_survivor'), false) AND ident < {}))"
    by_field = "CASE WHEN fa THEN 'recent track steps disagree with field heading' ELSE 'field' END"
    return f"""{src}, {_field_sql("src")}, flags AS (SELECT *, {against} AS ha, {f_against} AS fa, {_DIRECTED.format("heading_label")} AS directed FROM field),
picked AS (SELECT *, CASE WHEN directed AND {doubtful.format("0.75")} THEN 'track continuity too ambiguous for publishable motion'
 WHEN ha AND f_heading IS NOT NULL AND {delta("f_heading", "recent_heading")} < 60 THEN 'field' WHEN ha THEN 'recent track steps disagree with fitted heading'
 WHEN f_score >= 0.5 AND directed AND ((abs(speed_kmh - f_speed) >= 30 AND speed_kmh / greatest(f_speed, 5.0) >= 1.8) OR (f_speed >= 5 AND speed_kmh >= 20 AND {delta("heading_deg", "f_heading")} >= 75)) THEN {by_field}
 WHEN (NOT directed OR (confidence_label <> 'low' AND ident >= 0.45 AND NOT {doubtful.format("0.85")})) AND ((ident >= 0.75 AND confidence_label <> 'low') OR (ident >= 0.45 AND confidence_label = 'medium')) THEN 'history'
 WHEN f_score >= 0.35 THEN {by_field}
   WHEN heading_label IN ('stationary', 'nearly stationary') THEN 'history' ELSE 'track identity too weak for publishable motion' END AS pick FROM flags)
SELECT track_id, CASE pick WHEN 'history' THEN speed_kmh WHEN 'field' THEN f_speed ELSE 0.0 END AS speed_kmh, CASE pick WHEN 'history' THEN heading_deg
  WHEN 'field' THEN f_heading END AS heading_deg, CASE pick WHEN 'history' THEN heading_label WHEN 'field' THEN f_label ELSE 'uncertain' END AS heading_label, CASE pick
  WHEN 'history' THEN 'track_history' WHEN 'field' THEN f_source ELSE 'suppressed' END AS source,
 CASE pick WHEN 'history' THEN confidence_reason WHEN 'field' THEN CASE
   WHEN f_source = 'suppressed' THEN 'motion field exceeds plausibility threshold' ELSE 'scene motion field from scene' END ELSE pick END AS confidence_reason FROM picked"""


@query(chain("hourly", "steps_of", "history", "recent", then="", positions="hourly").rstrip() + ",\n" + _reported_sql())
def reported_motion(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("track_id")
    field = M.field_motion((k % 21 - 10) / 200.0, (k % 17 - 8) / 200.0, (k % 11) / 10.0, F.lit("scene"), F.lit(1.0))
    rows = M.history_motion(standins.hourly_positions(spark, sf)).withColumns({"field": field, "identity": (k % 20) / 20.0, "context": F.get(F.array(F.lit("matched"), F.lit("new_track"), F.lit("split_child"), F.lit(None)), (k % 4).cast("int")), "margin": F.when(k % 3 == 0, (k % 9) / 10.0), "events": k % 8})
    return rows.select("track_id", M.reported_motion(*(F.col(c) for c in ("motion", "field", "headings", "identity", "context", "margin", "events"))).alias("m")).select("track_id", *[f"m.{c}" for c in ("speed_kmh", "heading_deg", "heading_label", "source", "confidence_reason")])


@query("""
WITH h AS (SELECT user_id, list(value ORDER BY ts DESC, event_id DESC)[1:4] AS d FROM events GROUP BY user_id), o AS (SELECT user_id, list_reverse(d) AS hs FROM h),
t AS (SELECT user_id, hs, list_transform(generate_series(1, len(hs) - 1), lambda i: (((hs[i + 1] - hs[i] + 540) % 360) + 360) % 360 - 180) AS s
  FROM o), g AS (SELECT *, list_transform(s, lambda x: abs(x)) AS a, list_transform(list_filter(s, lambda x: abs(x) >= 20), lambda x: sign(x)) AS sg FROM t),
c AS (SELECT *, len(list_filter(a, lambda x: x >= 90)) AS rev, len(list_filter(generate_series(1, len(sg) - 1), lambda i: sg[i] <> sg[i + 1])) AS chg,
  list_max(a) AS wide, list_avg(a) AS mean
  FROM g)
SELECT user_id, CASE WHEN len(hs) < 2 THEN 'insufficient' WHEN rev >= 2 OR chg >= 2 OR (rev >= 1 AND chg >= 1) THEN 'unstable' WHEN wide <= 35 THEN 'stable'
  WHEN chg = 0 AND wide <= 75 THEN 'coherent_turn' ELSE 'mixed' END AS label, CAST(CASE WHEN len(hs) < 2 THEN 1.0 WHEN rev >= 2 OR chg >= 2 THEN 0.1
  WHEN rev >= 1 AND chg >= 1 THEN 0.2 WHEN wide <= 35 THEN 0.95 WHEN chg = 0 AND wide <= 75 THEN 0.85 WHEN chg = 0 AND mean <= 60 THEN 0.65
  WHEN rev >= 1 THEN 0.45 ELSE 0.6 END AS DOUBLE) AS score FROM c""")
def heading_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user's last four values, read as headings."""
    e = standins.table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("all"))
    return e.select("user_id", M.heading_stability(F.transform(M.last(F.col("all"), 4), lambda x: x["value"])).alias("s")).select("user_id", "s.label", "s.score")


@query(chain("upto:objects", then="""
SELECT scan_id, focus_track_id, runner_up_track_id, round_even(fs - ss, 2) AS selection_margin
  FROM (SELECT f.scan_id, f.track_id AS focus_track_id, f.score AS fs, s.track_id AS runner_up_track_id, s.score AS ss,
  row_number() OVER (PARTITION BY f.scan_id ORDER BY CASE
  WHEN f.stays THEN s.score END DESC NULLS LAST, CASE WHEN f.stays THEN s.track_id END DESC NULLS LAST, s.place) AS k FROM
(SELECT *, bool_or(stay_row) OVER (PARTITION BY scan_id) AS stays FROM (SELECT *, prior AND top_score < score + 2 AND place > 1 AS stay_row
  FROM (SELECT *, max(score) OVER (PARTITION BY scan_id) AS top_score, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, peak_dbz DESC, area_km2 DESC,
  track_id) AS place
  FROM sc))) f LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, peak_dbz DESC, area_km2 DESC, track_id) AS place
  FROM sc) s ON s.scan_id = f.scan_id AND s.track_id <> f.track_id WHERE CASE WHEN f.stays THEN f.stay_row ELSE f.place = 1 END) WHERE k = 1""").replace("\nSELECT scan_id, focus_track_id", ",\nsc AS (SELECT scan_id, object_id AS track_id, peak_dbz, area_km2, object_id % 9 = 4 AND object_id < 9 AS prior, peak_dbz / 10 + least(area_km2 / 150, 8.0) + least(object_id % 8, 6) * 0.7 + (object_id % 5) / 5.0 * 2 + CASE WHEN object_id % 9 = 4 AND object_id < 9 THEN 2.5 ELSE 0.0 END - least(distance_km / 40, 6.0) AS score FROM objects)\nSELECT scan_id, focus_track_id", 1))
def focus_choice(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("object_id")
    t = _detected(spark, sf).objects.select("scan_id", k.alias("track_id"), F.col("peak_dbz").alias("peak"), F.col("area_km2").alias("area"), (k % 8).alias("n_positions"), ((k % 5) / 5.0).alias("identity"), F.col("distance_km").alias("distance"), ((k % 9 == 4) & (k < 9)).alias("prior"))
    return M.choose_focus(t)


# -- buffer, tracks and reports ---------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT 'S' || user_id % 10 AS site_id, event_id AS scan_id, date_trunc('second', ts) AS scan_ts FROM events)
SELECT site_id, scan_id, count(*) OVER h AS scan_count, lag(scan_id) OVER (PARTITION BY site_id ORDER BY scan_ts, scan_id) AS previous_id, min(scan_ts) OVER h AS first_ts
  FROM s WINDOW h AS (PARTITION BY site_id ORDER BY scan_ts RANGE BETWEEN INTERVAL 120 MINUTES PRECEDING AND CURRENT ROW)""")
def replay_buffer(spark: SparkSession, sf: str) -> DataFrame:
    e = standins.table(spark, sf, "events").select(F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("site_id"), F.col("event_id").alias("scan_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("scan_ts"))
    return buffer.retained(e).select("site_id", "scan_id", "scan_count", "previous_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"))


def _done(spark: SparkSession, sf: str) -> Ingested:
    volume = standins.velocity_sweeps(spark, sf), standins.velocity_gates(spark, sf)
    return ingest(standins.scans(spark, sf), standins.gates(spark, sf), *volume)


def _tracked(spark: SparkSession, sf: str) -> DataFrame:
    scans, g = standins.scans(spark, sf), standins.gates(spark, sf)
    found = D.detect_objects(scans, g)
    return track_scans(scan_rows(scans, g, found.objects, found.object_gates, Q.scan_quality(scans, g, Q.speckle_gates(g))))


@query()
def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The fold's state after each scan; tests hold it against scenarios."""
    what = ["t.track_id", "t.status", F.size("t.positions").alias("n_positions"), F.col("t.motion.heading_label").alias("heading_label"), F.col("t.motion.speed_mph").alias("speed_mph"), "t.identity_confidence", "t.is_primary_focus"]
    return all_tracks(landed(_tracked(spark, sf), "tracked"), *what).drop("scan_ts")


FIRST_TRACKS = """
factor AS (SELECT scan_id, greatest(0.25::DOUBLE,
  least(1.0::DOUBLE, round_even(greatest(0.0, least(1.0, 1 - (1 - n / 3200.0) * 0.7 - least(gone / 3200.0 * 20, 0.3))), 3))) AS f
  FROM (SELECT scan_id, CAST(count(*) AS DOUBLE) AS n, (SELECT count(*) FROM speckle s WHERE s.scan_id = g.scan_id) AS gone FROM gates g GROUP BY scan_id)),
born AS (SELECT o.*, CAST(printf('%.2f', 0.45::DOUBLE + f * 0.35::DOUBLE) AS DOUBLE) AS c FROM objects o JOIN factor USING (scan_id)),
led AS (SELECT *, peak_dbz / 10 + least(area_km2 / 150, 8.0::DOUBLE) + 0.7::DOUBLE + 2 * c - least(distance_km / 40, 6.0::DOUBLE) AS s FROM born),
placed_tracks AS (SELECT *, row_number() OVER w AS place, lead(s) OVER w AS second, lead(rank) OVER w AS runner
  FROM led WINDOW w AS (PARTITION BY scan_id ORDER BY s DESC, peak_dbz DESC, area_km2 DESC, rank))
SELECT scan_id, rank AS track_id, 'active' AS status, 1 AS n_positions, 'stationary' AS heading_label, 0 AS speed_mph, c AS identity_confidence,
  'initial' AS event_context, 'first-scan track initialization' AS reason, 0 AS missed_scans,
  place = 1 AS is_primary_focus, CASE WHEN place = 1 THEN CAST(printf('%.2f', s - second) AS DOUBLE) END AS selection_margin, CASE
    WHEN place = 1 THEN runner END AS runner_up_track_id
FROM placed_tracks
"""


@query(chain("upto:objects", "speckle", then="").rstrip() + "," + FIRST_TRACKS)
def first_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The fold where each scan is the first of a site of its own: every object begins a track, the strongest is the focus."""
    scans, g = standins.scans(spark, sf).withColumn("site_id", F.concat(F.lit("Z"), F.col("scan_id").cast("string"))), standins.gates(spark, sf)
    found = D.detect_objects(scans, g)
    rows = track_scans(scan_rows(scans, g, found.objects, found.object_gates, Q.scan_quality(scans, g, Q.speckle_gates(g))))
    t = rows.select("scan_id", F.explode("tracks").alias("t"))
    return t.select(
        "scan_id", "t.track_id", "t.status", F.size("t.positions").alias("n_positions"), F.col("t.motion.heading_label").alias("heading_label"), F.col("t.motion.speed_mph").alias("speed_mph"), "t.identity_confidence",
        F.col("t.identity.event_context").alias("event_context"), F.col("t.identity.reason").alias("reason"), "t.missed_scans", "t.is_primary_focus", F.col("t.focus.selection_margin").alias("selection_margin"), F.col("t.focus.runner_up_track_id").alias("runner_up_track_id"),
    )


LOST_TRACKS = FIRST_TRACKS[: FIRST_TRACKS.index("led AS")].rstrip() + """
aged AS (SELECT *, CAST(printf('%.2f', greatest(0.0::DOUBLE, CAST(printf('%.2f', c - 0.2::DOUBLE) AS DOUBLE))) AS DOUBLE) AS c1 FROM born)
SELECT scan_id * 10 + k AS scan_id, rank AS track_id, CASE k WHEN 2 THEN 'lost' ELSE 'active' END AS status, CAST(k AS INT) AS missed_scans,
  CASE k WHEN 0 THEN c WHEN 1 THEN c1 ELSE greatest(0.0::DOUBLE, CAST(printf('%.2f', c1 - 0.2::DOUBLE) AS DOUBLE)) END AS identity_confidence, CASE k
    WHEN 0 THEN 'initial' ELSE 'missed_scan' END AS event_context
FROM aged, (VALUES (0), (1), (2)) v(k)
"""


@query(chain("upto:objects", "speckle", then="").rstrip() + "," + LOST_TRACKS)
def lost_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The fold over each scan and two scans without echo after it: a track that is missed twice is lost."""
    scans, g = standins.scans(spark, sf).withColumn("site_id", F.concat(F.lit("Z"), F.col("scan_id").cast("string"))), standins.gates(spark, sf)
    found = D.detect_objects(scans, g)

    def first(df: DataFrame) -> DataFrame:
        return df.withColumn("scan_id", F.col("scan_id") * 10)

    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    three = scans.withColumn("k", k).withColumns({"scan_id": F.col("scan_id") * 10 + F.col("k"), "scan_ts": F.timestamp_seconds(F.unix_timestamp("scan_ts") + F.col("k") * 300)}).drop("k")
    rows = track_scans(scan_rows(three, first(g), first(found.objects), first(found.object_gates), first(Q.scan_quality(scans, g, Q.speckle_gates(g)))))
    t = rows.select("scan_id", F.explode("tracks").alias("t"))
    return t.select("scan_id", "t.track_id", "t.status", "t.missed_scans", "t.identity_confidence", F.col("t.identity.event_context").alias("event_context"))


@query()
def track_events(spark: SparkSession, sf: str) -> DataFrame:
    return _tracked(spark, sf).select("site_id", "scan_id", F.explode("events").alias("e")).select("site_id", "scan_id", "e.*")


@query()
def scan_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return replay.diagnostics(_done(spark, sf))


@query()
def benchmark_results(spark: SparkSession, sf: str) -> DataFrame:
    entries = spark.createDataFrame([("all", "dense", "KTLX", None, standins.scans(spark, sf).count(), True, None), ("last", "quick", "KTLX", "2024-01-01", 3, True, None)], "id string, category string, site_id string, date string, scans int, local_only boolean, end_filename string")
    return replay.run_benchmarks(entries, standins.scans(spark, sf), standins.gates(spark, sf), standins.velocity_sweeps(spark, sf), standins.velocity_gates(spark, sf))[0]


OBJECT_TEXTS = f"""
SELECT scan_id, 'Oklahoma City: ' || n || CASE
  WHEN n = 1 THEN ' rain object' ELSE ' rain objects' END || ' detected. Strongest: ' || peak_label || ', ' || CAST(round_even(distance_km / 1.60934,
  0) AS INT) || ' miles ' || {bearing("bearing_deg")} || ' of the radar. Covering approximately ' || CAST(round_even(total / (1.60934 * 1.60934),
  0) AS INT) || ' square miles.' AS text
FROM (SELECT *, count(*) OVER (PARTITION BY scan_id) AS n, sum(area_km2) OVER (PARTITION BY scan_id) AS total FROM objects
  QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY peak_dbz + least(ln(1 + area_km2), 6.0) DESC, peak_dbz DESC, area_km2 DESC, distance_km, rank) = 1)
UNION ALL SELECT s, 'Oklahoma City: No significant precipitation detected.' FROM (SELECT DISTINCT vec_id // 50 AS s FROM embeddings) WHERE s NOT IN (SELECT scan_id
  FROM objects)"""


@query(chain("upto:objects", then=OBJECT_TEXTS))
def object_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries without tracks."""
    scans = sites.site_name(standins.scans(spark, sf))
    return summary.scan_summaries(scans, _detected(spark, sf).objects).select("scan_id", "text")


ROTATION_TEXTS = f"""
near AS (SELECT o.scan_id, o.object_id, arg_min({{'strength': r.strength, 'deg': r.bearing_deg, 'km': r.distance_km}}, {{'d': d, 'k': r.k}}) AS rot
  FROM (SELECT o.scan_id, o.object_id, r.strength, r.bearing_deg, r.distance_km, r.sweep_idx * 1000000000 + r.label AS k,
    {hav("o.centroid_lat", "o.centroid_lon", "r.centroid_lat", "r.centroid_lon")} AS d
    FROM objects o JOIN rotations r ON r.scan_id = o.scan_id) r JOIN objects o ON o.scan_id = r.scan_id AND o.object_id = r.object_id WHERE d <= 30 GROUP BY ALL),
ranked AS (SELECT o.*, n.rot, count(*) OVER s AS n, sum(area_km2) OVER s AS total,
  row_number() OVER (PARTITION BY o.scan_id ORDER BY peak_dbz + least(ln(1 + area_km2), 6.0) DESC, peak_dbz DESC, area_km2 DESC, distance_km, rank) AS place
  FROM objects o LEFT JOIN near n ON n.scan_id = o.scan_id AND n.object_id = o.object_id WINDOW s AS (PARTITION BY o.scan_id)),
told AS (SELECT scan_id, string_agg(' Rotation signature ' || CAST(round_even(rot.km / 1.60934, 0) AS INT) || ' miles ' || {bearing("rot.deg")} || ' of the radar, ' || rot.strength || ' shear.', '' ORDER BY rank) AS others
  FROM (SELECT * FROM ranked WHERE place > 1 AND rot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY rank) <= 2) GROUP BY scan_id)
SELECT scan_id, 'Oklahoma City: ' || n || CASE
  WHEN n = 1 THEN ' rain object' ELSE ' rain objects' END || ' detected. Strongest: ' || peak_label || ', ' || CAST(round_even(distance_km / 1.60934,
  0) AS INT) || ' miles ' || {bearing("bearing_deg")} || ' of the radar.'
  || CASE
    WHEN rot IS NULL THEN '' ELSE ' ' || upper(rot.strength[1]) || rot.strength[2:] || ' rotation detected.' END || coalesce(others,
    '') || ' Covering approximately ' || CAST(round_even(total / (1.60934 * 1.60934), 0) AS INT) || ' square miles.' AS text
FROM ranked LEFT JOIN told USING (scan_id) WHERE place = 1
"""


@query(chain("upto:objects", "vgates", "shear", "rotations", then="").rstrip() + "," + ROTATION_TEXTS)
def rotation_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries with rotation, without tracks, of the scans that have objects."""
    sweeps = standins.velocity_sweeps(spark, sf)
    rotations = V.sweep_rotations(sweeps, V.shear_gates(sweeps, standins.velocity_gates(spark, sf))).withColumn("rotation_id", F.col("sweep_idx") * 1_000_000_000 + F.col("label"))
    objects = V.objects_with_rotation(_detected(spark, sf).objects, rotations)
    told = summary.scan_summaries(sites.site_name(standins.scans(spark, sf)), objects)
    return told.join(objects.select("scan_id").distinct(), "scan_id", "left_semi").select("scan_id", "text")


@query("""
WITH e AS (SELECT event_id, ['weak', 'moderate', 'strong', NULL][event_id % 4 + 1] AS strength, CASE
  WHEN event_id % 7 <> 3 THEN list_transform(generate_series(1, event_id % 5 + 1), lambda i: CASE WHEN (event_id // i) % 3 <> 0 THEN 'weak' END) END AS hs FROM events),
r AS (SELECT *, coalesce(list_position(list_transform(list_reverse(hs), lambda x: x IS NULL), true) - 1, len(hs)) AS run,
  len(list_filter(hs[-3:], lambda x: x IS NOT NULL)) > 0 AND hs[-1] IS NULL AS weaker
  FROM e)
SELECT event_id, CASE WHEN strength IS NULL THEN CASE WHEN weaker THEN ' Rotation weakening.' ELSE '' END
  WHEN hs IS NOT NULL AND run >= 3 THEN ' Persistent ' || strength || ' rotation.'
  WHEN hs IS NOT NULL AND run <= 1 THEN ' New ' || strength || ' rotation detected.' ELSE ' ' || upper(strength[1]) || strength[2:] || ' rotation detected.' END AS phrase
FROM r
""")
def rotation_phrases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    strength = F.get(F.array(F.lit("weak"), F.lit("moderate"), F.lit("strong"), F.lit(None)), (k % 4).cast("int"))
    each = F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: F.struct(F.when(F.floor(k / i) % 3 != 0, "weak").alias("strength")))
    rows = standins.table(spark, sf, "events").select("event_id", strength.alias("strength"), F.when(k % 7 != 3, each).alias("history"))
    return rows.select("event_id", summary.rotation_phrase(F.col("strength"), F.col("history")).alias("phrase"))


@query("""
WITH e AS (SELECT event_id, ['N', 'uncertain', 'stationary', 'nearly stationary', 'SSW'][event_id % 5 + 1] AS label, CAST(event_id % 70 AS INT) AS mph,
  event_id % 3 <> 0 AS has_focus, (event_id % 11) / 10.0::DOUBLE AS fs, event_id % 4 AS flips, event_id % 6 AS fe,
  coalesce(CASE
    WHEN event_id % 17 <> 0 THEN (event_id % 13) / 12.0::DOUBLE END, (event_id % 8) / 8.0::DOUBLE) AS ident, ['matched', 'new_track', 'split_child', 'merge_survivor',
    NULL][(event_id // 5) % 5 + 1] AS ctx, event_id % 2 = 0 AS is_focus, event_id % 9 AS ev
    FROM events),
d AS (SELECT *, label IN ('N', 'SSW') AND is_focus AND CASE
  WHEN has_focus THEN fs <= 0.6 OR (flips >= 2 AND fe >= 4) ELSE ident < 0.45 OR (ev >= 6 AND ident < 0.75) OR (coalesce(ctx IN ('new_track', 'split_child', 'merge_survivor'), false) AND ident < 0.75) END AS doubtful
  FROM e)
SELECT event_id, CASE WHEN doubtful OR label = 'uncertain' THEN ', tracking uncertain'
  WHEN label LIKE '%stationary' THEN ', ' || label ELSE ', moving ' || label || ' at ' || mph || ' mph' END AS phrase
FROM d
""")
def motion_phrases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    label = F.get(F.array(*map(F.lit, ("N", "uncertain", "stationary", "nearly stationary", "SSW"))), (k % 5).cast("int"))
    context = F.get(F.array(*map(F.lit, ("matched", "new_track", "split_child", "merge_survivor", None))), (F.floor(k / 5) % 5).cast("int"))
    focus = F.when(k % 3 != 0, F.struct(((k % 11) / 10.0).alias("score"), (k % 4).alias("recent_heading_flip_count"), (k % 6).alias("recent_structural_event_count")))
    track = F.struct(
        F.struct(label.alias("heading_label"), (k % 70).cast("int").alias("speed_mph")).alias("motion"), focus.alias("focus"), ((k % 8) / 8.0).alias("identity_confidence"),
        F.struct(F.when(k % 17 != 0, (k % 13) / 12.0).alias("score"), context.alias("event_context")).alias("identity"), (k % 2 == 0).alias("is_primary_focus"),
    )
    rows = standins.table(spark, sf, "events").select("event_id", track.alias("t"), (k % 9).alias("n"))
    return rows.select("event_id", summary.motion_phrase(F.col("t"), F.col("n")).alias("phrase"))


@query("""
WITH s AS (SELECT user_id, CAST(event_id AS BIGINT) AS scan_id, ts, CAST(event_id % 5 AS BIGINT) AS o, CAST(event_id % 4 AS BIGINT) AS a,
  CAST(event_id % 90 AS INT) AS sp, event_id % 3 = 0 AS m, CASE
  WHEN event_id % 6 <> 1 THEN event_id % 3 END AS f, CASE WHEN event_id % 5 <> 2 THEN value % 360 END AS h, CASE
  WHEN event_id % 7 <> 3 THEN (event_id % 10) / 10.0::DOUBLE END AS c, ['moving N at 3 mph', 'tracking uncertain', 'nearly stationary'][event_id % 3 + 1] AS summary
  FROM events),
l AS (SELECT *, lag(f) OVER w AS pf, lag(h) OVER w AS ph, row_number() OVER w AS k
  FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, scan_id)), d AS (SELECT *, ph IS NOT NULL AND h IS NOT NULL AND least(abs(ph - h) % 360,
  360 - abs(ph - h) % 360) >= 90 AS flip
  FROM l)
SELECT user_id AS benchmark_id, count(*) AS scan_count, round_even(avg(o), 2) AS mean_objects, max(sp) AS max_speed_mph, CAST(sum(CASE
  WHEN m THEN 1 ELSE 0 END) AS BIGINT) AS total_merges, round_even(coalesce(avg(c), 0.0), 2) AS mean_focus_identity_confidence,
  count(*) FILTER (c < 0.45) AS focus_low_identity_scans, count(*) FILTER (pf <> f) AS focus_switches, count(*) FILTER (flip) AS focus_heading_flips_ge_90,
  count(*) FILTER (flip AND c < 0.45) AS focus_flips_with_low_motion_confidence,
count(*) FILTER (summary LIKE '%tracking uncertain%') AS summary_tracking_uncertain_count, count(*) FILTER (summary LIKE '%moving %') AS summary_motion_published_count,
  count(*) FILTER (summary LIKE '%stationary%') AS summary_stationaryish_count, CAST(sum(CASE
  WHEN k > 1 THEN a ELSE 0 END) AS BIGINT) AS total_new_tracks_after_first_scan, round_even(sum(CASE
  WHEN k > 1 THEN a ELSE 0 END) / greatest(sum(o), 1), 3) AS fragmentation_proxy FROM d GROUP BY user_id""")
def benchmark_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    """Of snapshots made up from events, a benchmark per user."""
    k = F.col("event_id")
    c = F.when(k % 7 != 3, (k % 10) / 10.0)
    shots = standins.table(spark, sf, "events").select(
        F.col("user_id").alias("benchmark_id"), k.alias("scan_id"), F.col("ts").alias("scan_ts"), (k % 5).alias("object_count"), (k % 4).alias("active_count"), (k % 90).cast("int").alias("max_speed_mph"), (k % 3 == 0).cast("int").alias("merge_count"), F.lit(0).alias("split_count"), F.lit(0).alias("uncertain_tracks"),
        F.when(k % 6 != 1, k % 3).alias("focus_track_id"), F.when(k % 5 != 2, F.col("value") % 360).alias("focus_heading_deg"), c.alias("focus_identity_score"), c.alias("focus_continuity_score"), c.alias("focus_selection_margin"), c.alias("focus_motion_confidence_score"), F.lit(0).alias("focus_reported_heading_flip_count"), F.lit("suppressed").alias("focus_motion_source"), (k % 4).alias("new_tracks"),
        F.get(F.array(F.lit("moving N at 3 mph"), F.lit("tracking uncertain"), F.lit("nearly stationary")), (k % 3).cast("int")).alias("summary"),
    )
    return replay.roll_up(shots).select("benchmark_id", "scan_count", "mean_objects", "max_speed_mph", "total_merges", "mean_focus_identity_confidence", "focus_low_identity_scans", "focus_switches", "focus_heading_flips_ge_90", "focus_flips_with_low_motion_confidence", "summary_tracking_uncertain_count", "summary_motion_published_count", "summary_stationaryish_count", "total_new_tracks_after_first_scan", "fragmentation_proxy")


@query(chain("upto:objects", then="SELECT 'KTLX' AS site_id, strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(5 * m AS INT)), '%Y-%m-%dT%H:%M:%S') AS \"timestamp\", CAST((SELECT count(*) FROM objects WHERE scan_id = m) AS INT) AS object_count FROM (SELECT max(vec_id // 50) AS m FROM embeddings)"))
def api_objects(spark: SparkSession, sf: str) -> DataFrame:
    scans, g = standins.scans(spark, sf), standins.gates(spark, sf)
    o = D.detect_objects(scans, g).objects.withColumns({"max_inbound_ms": F.lit(None).cast("double"), "max_outbound_ms": F.lit(None).cast("double"), "rotation": F.lit(None).cast("struct<strength:string>")})
    done = Ingested(scans, g, *[o] * 7)
    return api.get_objects(done, "ktlx").select("site_id", "timestamp", "object_count")


@query(chain("sites", "stations", then=f"""
SELECT station_id, site_id, name, latitude, longitude, round_even(d, 6) AS distance_km, CAST(row_number() OVER (PARTITION BY station_id ORDER BY b,
  ord) AS INT) AS site_rank
FROM (SELECT *, d * 1000 * tan(radians(0.5)) + pow(d * 1000, 2) / (2 * 6371000.0) + elevation_m AS b
  FROM (SELECT s.*, t.*, {hav("t.lat", "t.lon", "s.latitude", "s.longitude")} AS d FROM stations t, sites s)) WHERE b <= 10000
"""))
def api_sites(spark: SparkSession, sf: str) -> DataFrame:
    return api.get_sites(standins.stations(spark, sf)).select("station_id", "site_id", "name", "latitude", "longitude", r6("distance_km").alias("distance_km"), "site_rank")


#: A time after most scans of the stand-in site, nearer to the one before it.
ASKED = "2024-01-01T00:17:00"


def _nearest_sql(then: str) -> str:
    return f"""
WITH s AS (SELECT DISTINCT vec_id // 50 AS m, TIMESTAMP '2024-01-01' + to_minutes(CAST(5 * (vec_id // 50) AS INT)) AS ts FROM embeddings),
one AS (SELECT m, ts FROM s WHERE CAST(ts AS DATE) = DATE '2024-01-01' ORDER BY abs(epoch(ts) - epoch(TIMESTAMP '{ASKED.replace("T", " ")}')), ts LIMIT 1)
{then}"""


def _only_objects(spark: SparkSession, sf: str) -> Ingested:
    scans, g = standins.scans(spark, sf), standins.gates(spark, sf)
    o = D.detect_objects(scans, g).objects.withColumns({"max_inbound_ms": F.lit(None).cast("double"), "max_outbound_ms": F.lit(None).cast("double"), "rotation": F.lit(None).cast("struct<strength:string>")})
    return Ingested(scans, g, *[o] * 7)


@query(_nearest_sql("SELECT 'KTLX' AS site_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS \"timestamp\", [0.5::DOUBLE] AS elevation_angles FROM one"))
def api_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Of the scan nearest to a time."""
    scans = standins.scans(spark, sf)
    return api.get_scan(Ingested(scans, *[scans] * 8), "ktlx", ASKED)


@query(chain("upto:objects", then="").rstrip() + "," + _nearest_sql("""
SELECT 'KTLX' AS site_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", object_id, centroid_lat, centroid_lon, distance_km, bearing_deg, peak_dbz, peak_label,
  area_km2
FROM one JOIN objects ON scan_id = m
""").replace("\nWITH s AS", "\ns AS"))
def api_objects_at(spark: SparkSession, sf: str) -> DataFrame:
    """The objects of the scan nearest to a time, with all their measures."""
    rows = api.get_objects(_only_objects(spark, sf), "KTLX", ASKED)
    fields = ["object_id", "centroid_lat", "centroid_lon", "distance_km", "bearing_deg", "peak_dbz", "peak_label", "area_km2"]
    return rows.select("site_id", "timestamp", F.explode("objects").alias("o")).select("site_id", "timestamp", *[f"o.{c}" for c in fields])


@query(chain("vgates", "wind", "regions", "merged_regions", then="").rstrip() + "," + _nearest_sql("""
SELECT 'KTLX' AS site_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", region_id, y.kind AS region_type, y.peak AS peak_velocity_ms, y.mean AS mean_velocity_ms,
  y.area AS area_km2, y.lat AS centroid_lat, y.lon AS centroid_lon,
  y.km AS distance_km, y.deg AS bearing_deg, y.n AS sweep_count, y.els AS elevation_angles FROM one JOIN merged_regions ON scan_id = m
""").replace("\nWITH s AS", "\ns AS"))
def api_regions_at(spark: SparkSession, sf: str) -> DataFrame:
    """The wind regions of the scan nearest to a time, as the velocity endpoint gives them."""
    scans, sweeps, gates = standins.scans(spark, sf), standins.velocity_sweeps(spark, sf), standins.velocity_gates(spark, sf)
    none = spark.createDataFrame([], V.ROTATION)
    done = Ingested(scans, *[scans] * 5, V.velocity_regions(sweeps, gates), none, scans)
    rows = api.get_velocity(done, "KTLX", ASKED)
    return rows.select("site_id", "timestamp", F.explode("regions").alias("r")).select("site_id", "timestamp", "r.*")


@query(chain("upto:objects", then="").rstrip() + ",\ntexts AS (" + OBJECT_TEXTS + ")," + _nearest_sql("""
SELECT 'KTLX' AS site_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", text FROM one JOIN texts ON scan_id = m
""").replace("\nWITH s AS", "\ns AS"))
def api_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The summary endpoint's answer for the scan nearest to a time, of objects that aren't followed."""
    scans, g = standins.scans(spark, sf), standins.gates(spark, sf)
    return api.get_summary(Ingested(scans, g, *[D.detect_objects(scans, g).objects] * 6, None), "KTLX", ASKED)


@query()
def api_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return api.as_json(api.get_tracks(_done(spark, sf), "KTLX"))


@query()
def api_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return api.as_json(api.get_velocity(_done(spark, sf), "KTLX"))


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
