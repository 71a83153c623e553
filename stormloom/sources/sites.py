"""The radar sites, and ranking them for a place."""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import beam_height_m, haversine_km
from .schemas import SITES

MAX_BEAM_HEIGHT_M = 10_000.0


@cache
def site_rows() -> list[tuple[str, str, float, float, int]]:
    lines = files(__package__).joinpath("sites.csv").read_text("utf-8").splitlines()
    rows = [x.split(",") for x in lines if x and not x.startswith("#")]
    return [(i, name, float(lat), float(lon), int(up)) for i, name, lat, lon, up in rows]


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(site_rows(), SITES)


def rank_sites(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points joined with every site whose lowest beam is at most 10 km high there, with distance_km, beam_height_m and
    site_rank (1: lowest beam). The fixed table of sites is laid against each point row, without a shuffle."""
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("site_id", "name", "latitude", "longitude", "elevation_m", "__order"), (*row, k), strict=True)]) for k, row in enumerate(site_rows())])
    point = points.withColumn("__point", F.struct(*points.columns))
    near = F.transform(table, lambda s: s.withField("distance_km", haversine_km(F.col(lat), F.col(lon), s["latitude"], s["longitude"])))
    near = F.transform(near, lambda s: s.withField("beam_height_m", beam_height_m(s["distance_km"], s["elevation_m"])))
    seen = F.filter(near, lambda s: s["beam_height_m"] <= MAX_BEAM_HEIGHT_M)
    by_height = F.array_sort(F.transform(seen, lambda s: F.struct(s["beam_height_m"].alias("h"), s["__order"].alias("k"), s.alias("s"))))
    return point.select(*points.columns, F.posexplode(by_height).alias("k", "at")).select(*points.columns, "at.s.site_id", "at.s.name", "at.s.latitude", "at.s.longitude", "at.s.elevation_m", "at.s.distance_km", "at.s.beam_height_m", (F.col("k") + 1).alias("site_rank"))


def site_name(df: DataFrame, site_col: str = "site_id", default: Column | None = None) -> DataFrame:
    """df with site_name: that of the upper-cased id, or the default (the id itself) for an unknown one."""
    names = F.broadcast(sites(df.sparkSession).select(F.col("site_id").alias("__id"), F.col("name").alias("__name")))
    other = F.col(site_col) if default is None else default
    return df.join(names, F.upper(site_col) == F.col("__id"), "left").withColumn("site_name", F.coalesce("__name", other)).drop("__id", "__name")


def places(points: DataFrame, known: DataFrame) -> DataFrame:
    """points (city, state) with lat and lon from a table of known places; a place that isn't there fails."""
    found = points.join(known.select("city", "state", "lat", "lon"), ["city", "state"], "left")
    return found.withColumn("lat", F.coalesce("lat", F.raise_error(F.concat(F.lit("unknown place: "), "city", F.lit(", "), "state")).cast("double")))
