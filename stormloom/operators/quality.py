"""Cleaning of reflectivity: weak speckle goes, and each scan gets a quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from .labels import label_gates

MIN_DBZ = 20.0
MAX_SPECKLE_GATES, MIN_SPECKLE_PEAK = 3, 35.0
HIGH_MISSING = 0.35


def echo_gates(gates: DataFrame) -> DataFrame:
    """Finite gates of at least 20 dBZ."""
    return gates.filter((F.col("dbz") >= MIN_DBZ) & ~F.isnan("dbz"))


def speckle_gates(gates: DataFrame) -> DataFrame:
    """(scan_id, az_idx, rng_idx) of weak speckle: components, diagonals joined, of at most 3 gates and under 35 dBZ."""
    labelled = label_gates(echo_gates(gates).select("scan_id", "az_idx", "rng_idx", "dbz"), ["scan_id"], diagonal=True)
    weak = labelled.groupBy("scan_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("dbz").alias("peak"), F.collect_list(F.struct("az_idx", "rng_idx")).alias("cells"))
    return weak.filter((F.col("n") <= MAX_SPECKLE_GATES) & (F.col("peak") < MIN_SPECKLE_PEAK)).select("scan_id", F.explode("cells").alias("c")).select("scan_id", "c.az_idx", "c.rng_idx")


def remove_speckle(gates: DataFrame, speckle: DataFrame) -> DataFrame:
    return gates.join(speckle, ["scan_id", "az_idx", "rng_idx"], "left_anti")


def scan_quality(scans: DataFrame, gates: DataFrame, speckle: DataFrame) -> DataFrame:
    """(scan_id, score, finite_fraction, removed_speckle_pixels, removed_speckle_fraction, flags) of each scan.

    gates: the finite ones before cleaning. The number of cells comes from the header's axes."""
    finite = gates.filter(~F.isnan("dbz")).groupBy("scan_id").agg(F.count(F.lit(1)).alias("finite"), F.count_if(F.col("dbz") >= MIN_DBZ).alias("echo"))
    gone = speckle.groupBy("scan_id").agg(F.count(F.lit(1)).alias("removed"))
    rows = scans.select("scan_id", (F.size("azimuths") * F.size("ranges_m")).alias("cells")).join(finite, "scan_id", "left").join(gone, "scan_id", "left").na.fill(0)
    missing, removed = 1 - F.col("finite") / F.col("cells"), F.col("removed") / F.col("cells")
    score = clamp(1 - missing * 0.7 - F.least(removed * 20, F.lit(0.3)))
    flags = F.array_compact(F.array(F.when(missing >= HIGH_MISSING, "high_missing_fraction"), F.when(F.col("removed") > 0, "speckle_filtered"), F.when(F.col("echo") <= F.col("removed"), "no_object_scale_echo")))
    return rows.select("scan_id", F.bround(score, 3).alias("score"), F.bround(1 - missing, 3).alias("finite_fraction"), F.col("removed").alias("removed_speckle_pixels"), F.bround(removed, 5).alias("removed_speckle_fraction"), flags.alias("flags"))
