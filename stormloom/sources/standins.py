"""Radar tables derived from the driver's tables, since no archive files are at hand."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_AZ, N_RNG = 50, 64
RADAR = (35.3331, -97.2778)
SITE = "KTLX"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, rng_idx, v): one row per place of an embedding, which is one ray."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("rng_idx", "v")).withColumn("v", F.col("v").cast("double"))


#: Three scans in four have a storm with two cores: its box, one row or column wider a moat without echo, and around.
BOX, MOAT = (6, 22, 8, 38), (5, 23, 7, 39)


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays of 50 vectors make a scan: dbz = 20 + 160 v, but for the storm: 28 + 10 v and two cones of six gates around
    cores that move from scan to scan, 30 high, or the second 44 high in even scans."""
    k, az, rng, v = (F.col(c) for c in ("scan_id", "az_idx", "rng_idx", "v"))

    def within(box: tuple[int, int, int, int]) -> Column:
        return az.between(*box[:2]) & rng.between(*box[2:])

    def cone(row: Column, column: Column, height: Column) -> Column:
        return height * F.greatest(F.lit(0.0), 1 - F.sqrt((az - row) * (az - row) + (rng - column) * (rng - column)) / 6)

    cores = F.greatest(cone(k % 3 + 12, k % 4 + 16, F.lit(30.0)), cone(k % 2 + 15, k % 3 + 30, F.when(k % 2 == 0, 44.0).otherwise(30.0)))
    dbz = F.when((k % 4 == 3) | ~within(MOAT), v * 160 + 20).when(within(BOX), cores + 28 + v * 10).otherwise(F.lit(10.0))
    rows = _values(spark, sf_dir).select(F.floor(F.col("vec_id") / N_AZ).alias("scan_id"), (F.col("vec_id") % N_AZ).cast("int").alias("az_idx"), "rng_idx", "v")
    return rows.select("scan_id", "az_idx", "rng_idx", dbz.alias("dbz"))


def velocity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sweeps of 50 vectors make a volume: vel = 80 v."""
    scan, sweep = F.floor(F.col("vec_id") / (2 * N_AZ)), (F.floor(F.col("vec_id") / N_AZ) % 2).cast("int")
    return _values(spark, sf_dir).select(scan.alias("scan_id"), sweep.alias("sweep_idx"), (F.col("vec_id") % N_AZ).cast("int").alias("az_idx"), "rng_idx", (F.col("v") * 80).alias("vel"))


def _axes() -> list:
    return [F.sequence(F.lit(0), F.lit(N_AZ - 1)).cast("array<double>").alias("azimuths"), F.transform(F.sequence(F.lit(0), F.lit(N_RNG - 1)), lambda k: k * 1000.0 + 2000.0).alias("ranges_m"), F.lit(RADAR[0]).alias("radar_lat"), F.lit(RADAR[1]).alias("radar_lon")]


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, five minutes apart, of one site."""
    ids = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / N_AZ).alias("scan_id")).distinct()
    return ids.select("scan_id", F.lit(SITE).alias("site_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("scan_id") * 300).alias("scan_ts"), *_axes(), F.lit(0.5).alias("elevation"), F.array(F.lit(0.5)).alias("elevations"))


def velocity_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = velocity_gates(spark, sf_dir).select("scan_id", "sweep_idx").distinct()
    return ids.select("scan_id", "sweep_idx", *_axes(), (F.col("sweep_idx") + 0.5).alias("elevation"), F.lit(26.2).alias("nyquist"))


def folded_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """velocity_gates' places with a smooth wind, 40 sin(az) + scan_id % 3 + 5 v, as a radar with a Nyquist velocity of 26.2
    tells it; places with v of -0.2 or less have no gate."""
    wind = F.sin(F.col("az_idx") * (2 * math.pi / N_AZ)) * 40 + F.col("scan_id") % 3 + F.col("vel") / 16
    found = velocity_gates(spark, sf_dir).filter("vel > -16").withColumn("wind", wind)
    return found.select("scan_id", "sweep_idx", "az_idx", "rng_idx", (F.col("wind") - 52.4 * F.rint(F.col("wind") / 52.4)).alias("vel"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of the users' events: (track_id, ts, lat, lon, position_id)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 1000 + 35).alias("lat"), ((F.col("event_id") % 100) / 1000.0 - 97).alias("lon"), F.col("event_id").alias("position_id"))


def hourly_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of a dozen places an hour apart that drift: (track_id, ts, lat, lon, position_id)."""
    e = table(spark, sf_dir, "events")
    k, track = F.col("event_id") % 12, F.floor(F.col("event_id") / 12)
    drift = (track % 7 - 3) * 0.01
    return e.select(track.alias("track_id"), F.timestamp_seconds(F.lit(1704067200) + k * 3600).alias("ts"), (F.lit(35.0) + k * drift + F.col("value") / 100_000).alias("lat"), (F.lit(-97.0) + k * (track % 5 - 2) * 0.02 + F.col("value") / 50_000).alias("lon"), F.col("event_id").alias("position_id"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("station_id"), (F.col("s_suppkey") % 25 + 25.0).alias("lat"), (F.col("s_suppkey") % 55 - 125.0).alias("lon"), F.abs("s_acctbal").alias("elev"))


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing: a file per event, a metadata file per seventh."""
    e = table(spark, sf_dir, "events")
    site = F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string"))
    name = F.concat(site, F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_V06"), F.when(F.col("event_id") % 7 == 0, "_MDM").otherwise(""))
    return e.select(site.alias("site_id"), name.alias("filename")).distinct()


def scan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the scan nearest to a time, one per click."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("S"), ((F.col("user_id") + 3) % 10).cast("string")).alias("site_id"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 7 MINUTES")).alias("dt"))


def volumes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sweeps, gates) of volumes with three sweeps of each moment."""
    v = _values(spark, sf_dir)
    sweep = (F.floor(F.col("vec_id") / 10) % 5).cast("int")
    moment = F.when(F.floor(F.col("vec_id") / N_AZ) % 2 == 0, "reflectivity").otherwise("velocity")
    scan = F.floor(F.col("vec_id") / (2 * N_AZ))
    g = v.select(scan.alias("scan_id"), moment.alias("moment"), sweep.alias("sweep_idx"), (F.col("vec_id") % 10).cast("int").alias("az_idx"), "rng_idx", F.when(F.col("v") > -0.2, F.col("v")).alias("value"))
    heads = g.select("scan_id", "moment", "sweep_idx").distinct()
    units = F.concat(F.lit("seconds since "), F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("scan_id") * 300), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return heads.select("scan_id", F.lit(SITE).alias("site_id"), "moment", "sweep_idx", units.alias("time_units"), *_axes(), (F.col("sweep_idx") * 0.97 + 0.48).alias("elevation"), F.lit(26.2).alias("nyquist")), g
