"""What the service's endpoints return, as DataFrames with their schemas. Queries only read; ingesting is apart. `at` is
the endpoints' `datetime` argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sites import rank_sites, site_name
from .ingest import Ingested
from .summary import scan_summaries

ROOT = {"name": "stormloom", "version": "0.1.0"}


class NotFound(LookupError):
    """No such track: status 404."""


def parse_datetime(text: str | None) -> datetime | None:
    """The endpoints' `datetime` argument: ISO 8601, or None. ValueError for anything else."""
    return None if text is None else datetime.fromisoformat(text)


def _newest(df: DataFrame, site_id: str, at: str | None = None) -> DataFrame:
    """The site's newest scan; or, given a time, that of the same day which is nearest to it, the earlier on a tie."""
    mine = df.filter(F.col("site_id") == site_id.upper())
    if (asked := parse_datetime(at)) is not None:
        off = F.abs(F.unix_timestamp("scan_ts") - F.unix_timestamp(F.lit(asked.isoformat(sep=" ")).cast("timestamp")))
        near = mine.filter(F.to_date("scan_ts") == F.lit(asked.date())).agg(F.min(F.struct(off.alias("off"), "scan_ts", "scan_id")).alias("__n"))
        near = near.select(F.struct("__n.scan_ts", "__n.scan_id").alias("__n"))
        return mine.join(F.broadcast(near), F.struct("scan_ts", "scan_id") == F.col("__n")).drop("__n")
    return mine.join(F.broadcast(mine.agg(F.max(F.struct("scan_ts", "scan_id")).alias("__n"))), F.struct("scan_ts", "scan_id") == F.col("__n")).drop("__n")


def _iso(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def get_sites(places: DataFrame) -> DataFrame:
    """The sites in reach of each place (lat, lon, and what else names it), by beam height."""
    named = [c for c in places.columns if c not in ("lat", "lon")]
    return rank_sites(places).select(*named, "site_id", "name", "latitude", "longitude", "elevation_m", "distance_km", "beam_height_m", "site_rank")


def get_scan(done: Ingested, site_id: str, at: str | None = None) -> DataFrame:
    return _newest(done.scans, site_id, at).select("site_id", _iso("scan_ts").alias("timestamp"), F.col("elevations").alias("elevation_angles"))


def get_objects(done: Ingested, site_id: str, at: str | None = None) -> DataFrame:
    newest = _newest(done.scans, site_id, at).select("scan_id", "site_id", "scan_ts")
    fields = ["object_id", "centroid_lat", "centroid_lon", "distance_km", "bearing_deg", "peak_dbz", "peak_label", "area_km2", "layers", "max_inbound_ms", "max_outbound_ms"]
    each = F.struct("rank", *fields, F.col("rotation.strength").alias("rotation_strength"))
    rows = newest.join(done.objects, "scan_id", "left").groupBy("site_id", "scan_ts").agg(F.array_sort(F.collect_list(F.when(F.col("object_id").isNotNull(), each))).alias("objects"))
    return rows.select("site_id", _iso("scan_ts").alias("timestamp"), F.size("objects").alias("object_count"), F.transform("objects", lambda o: o.dropFields("rank")).alias("objects"))


def get_summary(done: Ingested, site_id: str, at: str | None = None) -> DataFrame:
    newest = _newest(done.scans, site_id, at)
    return scan_summaries(site_name(newest), done.objects, done.tracked).select("site_id", _iso("scan_ts").alias("timestamp"), "text")


def _track(t: F.Column) -> F.Column:
    now = F.element_at(t["positions"], -1)
    first = F.get(t["positions"], F.lit(0))
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return t.dropFields("diagnostic_motion").withField("peak_dbz", F.coalesce(now["peak_dbz"], F.lit(0.0))).withField("peak_label", F.coalesce(now["peak_label"], F.lit("unknown"))).withField("first_seen", F.coalesce(F.date_format(first["ts"], iso), F.lit(""))).withField("last_seen", F.coalesce(F.date_format(now["ts"], iso), F.lit("")))


def get_tracks(done: Ingested, site_id: str, at: str | None = None) -> DataFrame:
    active = F.filter("tracks", lambda t: t["status"] == "active")
    return _newest(done.tracked, site_id, at).select("site_id", _iso("scan_ts").alias("timestamp"), F.size(active).alias("active_count"), F.transform(active, _track).alias("tracks"), F.col("events").alias("recent_events"))


def get_velocity(done: Ingested, site_id: str, at: str | None = None) -> DataFrame:
    newest = _newest(done.scans, site_id, at).select("scan_id", "site_id", "scan_ts")
    for name, df in (("regions", done.regions), ("rotation_signatures", done.rotations)):
        key = df.columns[1]
        found = df.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in df.columns if c not in ("scan_id", key)]))).alias(name))
        newest = newest.join(found, "scan_id", "left")
    return newest.select("site_id", _iso("scan_ts").alias("timestamp"), "regions", "rotation_signatures")


def get_motion(done: Ingested, site_id: str, track_id: int) -> DataFrame:
    """One row of the track; NotFound if the site never had it."""
    mine = done.tracked.select("site_id", "scan_ts", "scan_id", F.explode("tracks").alias("t")).filter(F.col("t.track_id") == track_id)
    tracks = _newest(mine, site_id).select(_track(F.col("t")).alias("t")).select("t.*")
    if not tracks.limit(1).count():
        raise NotFound(f"Track {track_id} not found")
    return tracks


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
