"""Wind regions and rotation from velocity sweeps, and their join to rain objects."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import gate_area_km2, haversine_km, interpolated, polar_to_lat_lon, rotation_strength, spacing
from ..sources.landing import landed
from .labels import label_gates

MIN_SPEED, MIN_REGION_KM2, MIN_SWEEP_IOU = 10.0, 4.0, 0.3
MIN_SHEAR, MAX_COUPLET_KM, MIN_SHEAR_GATES = 15.0, 5.0, 2
MERGE_KM, NEAR_KM = 10.0, 30.0
#: Degrees of latitude that any two places within NEAR_KM differ by at most.
NEAR_DEG = 0.28

REGION = "scan_id long, region_id int, region_type string, peak_velocity_ms double, mean_velocity_ms double, area_km2 double, centroid_lat double, centroid_lon double, distance_km double, bearing_deg double, sweep_count int, elevation_angles array<double>"
ROTATION = "scan_id long, rotation_id int, centroid_lat double, centroid_lon double, distance_km double, bearing_deg double, max_shear_ms double, max_inbound_ms double, max_outbound_ms double, diameter_km double, sweep_count int, elevation_angles array<double>, strength string"


@dataclass
class VelocityAnalysis:
    regions: DataFrame
    rotations: DataFrame
    objects: DataFrame


def wind_gates(gates: DataFrame) -> DataFrame:
    """Gates of 10 m/s or more, with region_type and the label of their region (diagonals joined)."""
    kind = F.when(F.col("vel") <= -MIN_SPEED, "inbound").when(F.col("vel") >= MIN_SPEED, "outbound")
    fast = gates.filter(~F.isnan("vel")).withColumn("region_type", kind).filter("region_type IS NOT NULL")
    return label_gates(fast.select("scan_id", "sweep_idx", "region_type", "az_idx", "rng_idx", "vel"), ["scan_id", "sweep_idx", "region_type"], diagonal=True)


def _placed(df: DataFrame) -> DataFrame:
    """df with azimuth, range_m and rounded place columns from the fractional indices row and col."""
    df = df.withColumns({"azimuth": interpolated("azimuths", "row"), "range_m": interpolated("ranges_m", "col")})
    lat, lon = polar_to_lat_lon("radar_lat", "radar_lon", "azimuth", "range_m")
    return df.withColumns({"centroid_lat": F.bround(lat, 4), "centroid_lon": F.bround(lon, 4), "distance_km": F.bround(F.col("range_m") / 1000, 1), "bearing_deg": F.bround(F.pmod("azimuth", F.lit(360.0)), 1)})


def sweep_regions(sweeps: DataFrame, labelled: DataFrame) -> DataFrame:
    """Regions of single sweeps of 4 km2 or more: scan_id, sweep_idx, region_type, label, measures, elevation."""
    key = ["scan_id", "sweep_idx"]
    area = labelled.join(sweeps.select(*key, "azimuths", "ranges_m"), key).withColumn("area", gate_area_km2("azimuths", "ranges_m", "rng_idx")).drop("azimuths", "ranges_m")
    weight = F.abs("vel")
    sums = area.groupBy(*key, "region_type", "label").agg(
        F.sum("area").alias("area"), F.min("vel").alias("low"), F.max("vel").alias("high"), F.avg("vel").alias("mean"),
        (F.sum(F.col("az_idx") * weight) / F.sum(weight)).alias("row"), (F.sum(F.col("rng_idx") * weight) / F.sum(weight)).alias("col"),
    ).filter(F.col("area") >= MIN_REGION_KM2)
    placed = _placed(sums.join(sweeps, key))
    peak = F.when(F.col("region_type") == "inbound", F.col("low")).otherwise(F.col("high"))
    return placed.select(*key, "region_type", "label", F.bround(peak, 1).alias("peak_velocity_ms"), F.bround("mean", 1).alias("mean_velocity_ms"), F.bround("area", 2).alias("area_km2"), "centroid_lat", "centroid_lon", "distance_km", "bearing_deg", "elevation")


def region_overlaps(labelled: DataFrame) -> DataFrame:
    """IoU of every two regions of one type in different sweeps of a scan that share gates."""
    key = ["scan_id", "region_type"]
    sizes = labelled.groupBy(*key, "sweep_idx", "label").agg(F.count(F.lit(1)).alias("n"))
    a = labelled.select(*key, "az_idx", "rng_idx", F.col("sweep_idx").alias("sweep_a"), F.col("label").alias("label_a"))
    b = labelled.select(*key, "az_idx", "rng_idx", F.col("sweep_idx").alias("sweep_b"), F.col("label").alias("label_b"))
    both = a.join(b, [*key, "az_idx", "rng_idx"]).filter("sweep_a < sweep_b").groupBy(*key, "sweep_a", "label_a", "sweep_b", "label_b").agg(F.count(F.lit(1)).alias("shared"))
    for s in "ab":
        both = both.join(sizes.select(*key, F.col("sweep_idx").alias(f"sweep_{s}"), F.col("label").alias(f"label_{s}"), F.col("n").alias(f"n_{s}")), [*key, f"sweep_{s}", f"label_{s}"])
    return both.withColumn("iou", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))


def first_fit(rows: list[dict], fits: Callable[[dict, dict], bool], join: Callable[[dict, dict], dict]) -> list[dict]:
    """Rows in order; each joins the first earlier result that it fits, or becomes one."""
    out: list[dict] = []
    for row in rows:
        k = next((k for k, other in enumerate(out) if fits(other, row)), None)
        if k is None:
            out.append(row)
        else:
            out[k] = join(out[k], row)
    return out


def merge_regions(regions: DataFrame, labelled: DataFrame) -> DataFrame:
    """Regions across a scan's sweeps: one joins the first of its type that it overlaps with IoU of 0.3 or more, inbound
    ones and lower sweeps first. The order matters, so it is one task per scan, over the regions' own gates."""
    cells = labelled.groupBy("scan_id", "sweep_idx", "region_type", "label").agg(F.collect_list(F.col("az_idx").cast("long") * 1_000_000 + F.col("rng_idx")).alias("cells"))
    rows = regions.join(cells, ["scan_id", "sweep_idx", "region_type", "label"])
    names = [x.split()[0] for x in REGION.split(", ")]

    def fits(a: dict, b: dict) -> bool:
        if a["region_type"] != b["region_type"]:
            return False
        shared = len(np.intersect1d(a["cells"], b["cells"], assume_unique=True))
        return shared >= MIN_SWEEP_IOU * (len(a["cells"]) + len(b["cells"]) - shared)

    def join(a: dict, b: dict) -> dict:
        peak = min if a["region_type"] == "inbound" else max
        return a | {"peak_velocity_ms": peak(a["peak_velocity_ms"], b["peak_velocity_ms"]), "mean_velocity_ms": round((a["mean_velocity_ms"] + b["mean_velocity_ms"]) / 2, 1), "area_km2": max(a["area_km2"], b["area_km2"]), "sweep_count": a["sweep_count"] + 1, "elevation_angles": a["elevation_angles"] + b["elevation_angles"], "cells": np.union1d(a["cells"], b["cells"])}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sweep_idx", "region_type", "label"])
        each = [r | {"cells": np.unique(r["cells"]), "sweep_count": 1, "elevation_angles": [r["elevation"]]} for r in pdf.to_dict("records")]
        merged = first_fit(each, fits, join)
        return pd.DataFrame([r | {"region_id": k} for k, r in enumerate(merged, 1)], columns=names)

    return rows.groupBy("scan_id").applyInPandas(run, REGION)


def shear_gates(sweeps: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates with a neighbour of the other sign: scan_id, sweep_idx, az_idx, rng_idx, shear, inbound, outbound of the
    neighbour of greatest shear, the first in order on a tie. The grid wraps around on both axes; neighbours further
    than 5 km, at the sweep's mean range, don't count. One task per sweep, on its whole grid."""
    key = ["scan_id", "sweep_idx"]
    offsets = [(a, r) for a in (-1, 0, 1) for r in (-1, 0, 1) if a or r]
    schema = "scan_id long, sweep_idx int, az_idx int, rng_idx int, shear double, inbound double, outbound double"

    def run(head: pa.Table, sweep: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in schema.split(", ")]
        az, rng, found = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((3, 0))
        if head.num_rows and sweep.num_rows:
            azimuths, ranges = head.column("azimuths")[0].as_py(), head.column("ranges_m")[0].as_py()
            d_az = math.radians(azimuths[1] - azimuths[0] if len(azimuths) > 1 else 1.0)
            d_rng, mean = ranges[1] - ranges[0] if len(ranges) > 1 else 250.0, sum(ranges) / len(ranges)
            grid = np.full((len(azimuths), len(ranges)), np.nan)
            grid[sweep.column("az_idx").to_numpy(), sweep.column("rng_idx").to_numpy()] = sweep.column("vel").to_numpy()
            best, other = np.zeros_like(grid), np.zeros_like(grid)
            for a, r in offsets:
                if math.sqrt((a * d_az * mean) ** 2 + (r * d_rng) ** 2) / 1000 <= MAX_COUPLET_KM:
                    there = np.roll(grid, (a, r), (0, 1))
                    shear = np.abs(grid - there)
                    better = ((grid < 0) != (there < 0)) & (shear >= MIN_SHEAR) & (shear > best)  # false where either is missing
                    best[better], other[better] = shear[better], there[better]
            az, rng = np.nonzero(best)
            here, there = grid[az, rng], other[az, rng]
            found = np.array([best[az, rng], np.minimum(here, there), np.maximum(here, there)])
        n = len(az)
        keys = [pa.array(np.full(n, head.column(k)[0].as_py() if n else 0), t) for k, t in zip(key, (pa.int64(), pa.int32()), strict=True)]
        return pa.table([*keys, pa.array(az.astype(np.int32)), pa.array(rng.astype(np.int32)), *map(pa.array, found)], names=names)

    heads = sweeps.select(F.col("scan_id").cast("long"), F.col("sweep_idx").cast("int"), "azimuths", "ranges_m")
    valid = gates.filter(~F.isnan("vel")).select(F.col("scan_id").cast("long"), F.col("sweep_idx").cast("int"), F.col("az_idx").cast("int"), F.col("rng_idx").cast("int"), "vel")
    return heads.groupBy(*key).cogroup(valid.groupBy(*key)).applyInArrow(run, schema)


def sweep_rotations(sweeps: DataFrame, shear: DataFrame) -> DataFrame:
    """Rotation on single sweeps: components of two shear gates or more, measured; azimuth and range_m aren't rounded."""
    key = ["scan_id", "sweep_idx"]
    labelled = label_gates(shear, key, diagonal=True)
    w = F.col("shear")
    sums = labelled.groupBy(*key, "label").agg(
        F.count(F.lit(1)).alias("n"), F.max("shear").alias("max_shear"), F.min("inbound").alias("low"), F.max("outbound").alias("high"),
        (F.sum(F.col("az_idx") * w) / F.sum(w)).alias("row"), (F.sum(F.col("rng_idx") * w) / F.sum(w)).alias("col"),
        (F.max("az_idx") - F.min("az_idx")).alias("az_extent"), (F.max("rng_idx") - F.min("rng_idx")).alias("rng_extent"),
    ).filter(F.col("n") >= MIN_SHEAR_GATES)
    placed = _placed(sums.join(sweeps, key))
    across, along = F.radians(F.col("az_extent") * spacing("azimuths", 1.0)) * F.col("range_m"), F.col("rng_extent") * spacing("ranges_m", 250.0)
    diameter = F.sqrt(across * across + along * along) / 1000
    return placed.select(*key, "label", "centroid_lat", "centroid_lon", "distance_km", "bearing_deg", F.bround("max_shear", 1).alias("max_shear_ms"), F.bround("low", 1).alias("max_inbound_ms"), F.bround("high", 1).alias("max_outbound_ms"), F.bround(diameter, 1).alias("diameter_km"), "elevation", rotation_strength("max_shear").alias("strength"), "azimuth", "range_m")


def merge_rotations(rotations: DataFrame) -> DataFrame:
    """Rotation across a scan's sweeps: one joins the first within 10 km, lower sweeps first; one task per scan."""
    names = [x.split()[0] for x in ROTATION.split(", ")]

    def fits(a: dict, b: dict) -> bool:
        turn = abs(b["azimuth"] - a["azimuth"])
        turn = 360 - turn if turn > 180 else turn
        return ((turn * 0.017453292519943295 * b["range_m"]) ** 2 + (b["range_m"] - a["range_m"]) ** 2) ** 0.5 / 1000 <= MERGE_KM

    def join(a: dict, b: dict) -> dict:
        shear = max(a["max_shear_ms"], b["max_shear_ms"])
        strength = "strong" if shear >= 35 else "moderate" if shear >= 25 else "weak"
        return a | {"max_shear_ms": shear, "max_inbound_ms": min(a["max_inbound_ms"], b["max_inbound_ms"]), "max_outbound_ms": max(a["max_outbound_ms"], b["max_outbound_ms"]), "diameter_km": max(a["diameter_km"], b["diameter_km"]), "sweep_count": a["sweep_count"] + 1, "elevation_angles": a["elevation_angles"] + b["elevation_angles"], "strength": strength}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sweep_idx", "label"])
        each = [r | {"sweep_count": 1, "elevation_angles": [r["elevation"]]} for r in pdf.to_dict("records")]
        return pd.DataFrame([r | {"rotation_id": k} for k, r in enumerate(first_fit(each, fits, join), 1)], columns=names)

    return rotations.groupBy("scan_id").applyInPandas(run, ROTATION)


def _near(objects: DataFrame, others: DataFrame) -> tuple[DataFrame, Column]:
    """objects left-joined with the others of their scan within 30 km (columns prefixed o_), and the distance."""
    o = others.select(*[F.col(c).alias(f"o_{c}") for c in others.columns])
    distance = haversine_km("centroid_lat", "centroid_lon", "o_centroid_lat", "o_centroid_lon")
    band = F.abs(F.col("centroid_lat") - F.col("o_centroid_lat")) <= NEAR_DEG
    return objects.join(o, (F.col("scan_id") == F.col("o_scan_id")) & band & (distance <= NEAR_KM), "left"), distance


def objects_with_wind(objects: DataFrame, regions: DataFrame) -> DataFrame:
    """objects with max_inbound_ms and max_outbound_ms of the regions within 30 km."""
    keys = objects.select("scan_id", "object_id", "centroid_lat", "centroid_lon")
    near, _ = _near(keys, regions.select("scan_id", "region_type", "peak_velocity_ms", "centroid_lat", "centroid_lon"))
    found = near.groupBy("scan_id", "object_id").agg(F.min(F.when(F.col("o_region_type") == "inbound", F.col("o_peak_velocity_ms"))).alias("max_inbound_ms"), F.max(F.when(F.col("o_region_type") == "outbound", F.col("o_peak_velocity_ms"))).alias("max_outbound_ms"))
    return objects.join(found, ["scan_id", "object_id"])


def objects_with_rotation(objects: DataFrame, rotations: DataFrame) -> DataFrame:
    """objects with the nearest rotation within 30 km, the first on a tie, as struct rotation; null if there is none."""
    keys = objects.select("scan_id", "object_id", "centroid_lat", "centroid_lon")
    near, distance = _near(keys, rotations)
    fields = [c for c in rotations.columns if c != "scan_id"]
    best = F.min_by(F.struct(*[F.col(f"o_{c}").alias(c) for c in fields]), F.struct(distance, "o_rotation_id"))
    found = near.groupBy("scan_id", "object_id").agg(F.max(F.col("o_rotation_id").isNotNull()).alias("any"), best.alias("rotation"))
    return objects.join(found.select("scan_id", "object_id", F.when(F.col("any"), F.col("rotation")).alias("rotation")), ["scan_id", "object_id"])


def velocity_regions(sweeps: DataFrame, gates: DataFrame) -> DataFrame:
    labelled = wind_gates(gates)
    return merge_regions(sweep_regions(sweeps, labelled), labelled)


def rotation_signatures(sweeps: DataFrame, gates: DataFrame) -> DataFrame:
    return merge_rotations(sweep_rotations(sweeps, shear_gates(sweeps, gates)))


def analyze_velocity(sweeps: DataFrame, gates: DataFrame, objects: DataFrame) -> VelocityAnalysis:
    """Regions, rotations, and objects with both. Scans without velocities keep their objects, with nulls."""
    regions, rotations = landed(velocity_regions(sweeps, gates), "regions"), landed(rotation_signatures(sweeps, gates), "rotations")
    return VelocityAnalysis(regions, rotations, objects_with_rotation(objects_with_wind(objects, regions), rotations))
