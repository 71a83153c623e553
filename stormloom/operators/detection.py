"""Rain objects: components of the reflectivity, split where strong cores stand apart, and measured.

Only the labelling of components is a kernel (one task per scan, for all thresholds). The tree of thresholds, the choice of
cores, the division of gates among them and all measures are joins, windows and aggregates over labelled gates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import FOUR
from ..functions.scalar import INTENSITY, gate_area_km2, intensity_label, interpolated, polar_to_lat_lon
from ..sources.landing import landed
from .labels import LABEL_ROW, component_labels
from .quality import echo_gates

THRESHOLDS = [20.0, 30.0, 40.0, 50.0, 60.0]
MIN_AREA_KM2, MIN_WEAK_AREA_KM2, MIN_SMALL_PEAK = 4.0, 8.0, 40.0
MIN_SEED_GATES, SEED_DBZ, BRANCH_DBZ = 6, 50.0, 40.0


@dataclass
class Detection:
    """objects; object_gates (scan_id, object_id, az_idx, rng_idx, dbz); hierarchy (nodes of the threshold trees)."""

    objects: DataFrame
    object_gates: DataFrame
    hierarchy: DataFrame


def threshold_labels(gates: DataFrame) -> DataFrame:
    """One row per gate and threshold that it reaches: scan_id, az_idx, rng_idx, dbz, threshold, label, parent_label
    (its component at the threshold below), blob (its component at the lowest)."""
    out = T.StructType([T.StructField(n, t) for n, t in (("scan_id", T.LongType()), ("az_idx", T.IntegerType()), ("rng_idx", T.IntegerType()), ("dbz", T.DoubleType()), ("threshold", T.DoubleType()), ("label", T.LongType()), ("parent_label", T.LongType()), ("blob", T.LongType()))])

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("az_idx").to_numpy().astype(np.int64) * LABEL_ROW + table.column("rng_idx").to_numpy()
        dbz = table.column("dbz").to_numpy()
        parts, parent, blob = [], None, None
        for threshold in THRESHOLDS:
            at = np.flatnonzero(dbz >= threshold)
            label = np.zeros(len(cell), np.int64)
            label[at] = component_labels(cell[at], FOUR)
            blob = label if blob is None else blob
            above = pa.nulls(len(at), pa.int64()) if parent is None else pa.array(parent[at])
            part = table.take(pa.array(at)).append_column("threshold", pa.array(np.full(len(at), threshold)))
            parts.append(part.append_column("label", pa.array(label[at])).append_column("parent_label", above).append_column("blob", pa.array(blob[at])))
            parent = label
        return pa.concat_tables(parts)

    return echo_gates(gates).select(F.col("scan_id").cast("long"), F.col("az_idx").cast("int"), F.col("rng_idx").cast("int"), F.col("dbz").cast("double")).groupBy("scan_id").applyInArrow(run, out)


def threshold_tree(labels: DataFrame) -> DataFrame:
    """Nodes: scan_id, blob, node_id (from 1 in each blob, by threshold and first gate), threshold, label,
    parent_node_id (null for a root), pixel_count, peak_dbz, branch (label of the 40 dBZ component that a node at or
    above 40 dBZ is in).

    A node's parent is the component of the threshold below that has most of its gates; nested components have all of
    them, so any gate's will do."""
    nodes = labels.groupBy("scan_id", "blob", "threshold", "label").agg(F.min("parent_label").alias("parent_label"), F.count(F.lit(1)).alias("pixel_count"), F.max("dbz").alias("peak_dbz"))
    nodes = nodes.withColumn("node_id", F.row_number().over(Window.partitionBy("scan_id", "blob").orderBy("threshold", "label")))
    nodes = nodes.withColumn("level", F.array_position(F.array(*map(F.lit, THRESHOLDS)), F.col("threshold")))
    up = nodes.select("scan_id", "blob", (F.col("level") + 1).alias("level"), F.col("label").alias("parent_label"), F.col("node_id").alias("parent_node_id"))
    nodes = nodes.join(up, ["scan_id", "blob", "level", "parent_label"], "left")
    # three levels from 60 down to 40 dBZ: a node's branch is its own, its parent's or its grandparent's label
    parents = nodes.select("scan_id", "blob", (F.col("level") + 1).alias("level"), F.col("label").alias("parent_label"), F.col("parent_label").alias("grand_label"))
    nodes = nodes.join(parents, ["scan_id", "blob", "level", "parent_label"], "left")
    branch = F.when(F.col("threshold") == 40, F.col("label")).when(F.col("threshold") == 50, F.col("parent_label")).when(F.col("threshold") == 60, F.col("grand_label"))
    return nodes.select("scan_id", "blob", "node_id", "threshold", "label", "parent_node_id", "pixel_count", "peak_dbz", branch.alias("branch"))


def threshold_paths(tree: DataFrame) -> DataFrame:
    """tree with threshold_path, the ascending thresholds from the root to the node. Components are nested, so a node
    at a threshold has an ancestor at every lower one."""
    below = F.filter(F.array(*map(F.lit, THRESHOLDS)), lambda t: t <= F.col("threshold"))
    return tree.withColumn("threshold_path", below)


def tree_leaves(tree: DataFrame) -> DataFrame:
    """Nodes that no node names as parent."""
    named = tree.filter("parent_node_id IS NOT NULL").select("scan_id", "blob", F.col("parent_node_id").alias("node_id")).distinct()
    return tree.join(named, ["scan_id", "blob", "node_id"], "left_anti")


def split_seeds(tree: DataFrame) -> DataFrame:
    """(scan_id, blob, seed, threshold, label): the cores that a blob is split around, seed 0 the strongest.

    Candidates are leaves of 6 gates or more at 50 dBZ or above; of each 40 dBZ branch the best one counts, and a blob
    splits if two branches have one."""
    strong = tree_leaves(tree).filter((F.col("pixel_count") >= MIN_SEED_GATES) & (F.col("threshold") >= SEED_DBZ))
    rank = [F.col("threshold").desc(), F.col("pixel_count").desc(), F.col("peak_dbz").desc()]
    branch = Window.partitionBy("scan_id", "blob", "branch")
    best = strong.withColumns({"first_leaf": F.min("node_id").over(branch), "place": F.row_number().over(branch.orderBy(*rank, "node_id"))}).filter("place = 1")
    blob = Window.partitionBy("scan_id", "blob")
    best = best.withColumns({"n": F.count(F.lit(1)).over(blob), "seed": F.row_number().over(blob.orderBy(*rank, "first_leaf")) - 1}).filter("n > 1")
    return best.select("scan_id", "blob", "seed", "threshold", "label")


def seed_centroids(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds with row and col: the reflectivity-weighted mean place of their gates, plain if the weights sum to 0."""
    gates = labels.join(seeds, ["scan_id", "blob", "threshold", "label"])
    total = F.sum("dbz")
    mean = {n: F.when(total > 0, F.sum(F.col(c) * F.col("dbz")) / total).otherwise(F.avg(c)) for n, c in (("row", "az_idx"), ("col", "rng_idx"))}
    return gates.groupBy("scan_id", "blob", "seed").agg(*[v.alias(n) for n, v in mean.items()])


def divide_gates(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(scan_id, blob, seed, az_idx, rng_idx, dbz) of all echo gates: a seed's own gates are its, the others of its blob
    go to the seed whose centroid is nearest in indices, the stronger on a tie. An unsplit blob is seed 0."""
    base = labels.filter(F.col("threshold") == THRESHOLDS[0]).select("scan_id", "blob", "az_idx", "rng_idx", "dbz")
    own = labels.join(seeds, ["scan_id", "blob", "threshold", "label"]).select("scan_id", "az_idx", "rng_idx", F.col("seed").alias("own"))
    centres = seed_centroids(labels, seeds).groupBy("scan_id", "blob").agg(F.array_sort(F.collect_list(F.struct("seed", "row", "col"))).alias("centres"))
    placed = base.join(centres, ["scan_id", "blob"], "left").join(own, ["scan_id", "az_idx", "rng_idx"], "left")

    def squared(c: Column) -> Column:
        return F.pow(F.col("az_idx") - c["row"], 2) + F.pow(F.col("rng_idx") - c["col"], 2)

    nearest = F.array_min(F.transform("centres", lambda c: F.struct(squared(c).alias("d"), c["seed"].alias("seed"))))["seed"]
    return placed.select("scan_id", "blob", F.coalesce("own", nearest, F.lit(0)).alias("seed"), "az_idx", "rng_idx", "dbz")


def measured(gates: DataFrame, scans: DataFrame, keys: list[str]) -> DataFrame:
    """Measures of the gates of each key (scan_id among them): place, distance, bearing, peak, area, intensity layers,
    bounding box, gate count. Values aren't rounded."""
    axes = scans.select("scan_id", "azimuths", "ranges_m", "radar_lat", "radar_lon")
    per_gate = gates.join(F.broadcast(axes) if _few(scans) else axes, "scan_id").withColumn("area", gate_area_km2("azimuths", "ranges_m", "rng_idx")).drop("azimuths", "ranges_m", "radar_lat", "radar_lon")
    layer = {f"layer_{int(low)}": F.sum(F.when((F.col("dbz") >= low) & (F.col("dbz") < high), F.col("area"))) for low, high, _ in INTENSITY}
    sums = per_gate.groupBy(*keys).agg(
        F.sum("area").alias("area"), F.sum("dbz").alias("weight"), F.max("dbz").alias("peak"), F.count(F.lit(1)).alias("pixel_count"),
        (F.sum(F.col("az_idx") * F.col("dbz")) / F.sum("dbz")).alias("row"), (F.sum(F.col("rng_idx") * F.col("dbz")) / F.sum("dbz")).alias("col"),
        F.min("az_idx").alias("min_row"), F.min("rng_idx").alias("min_col"), F.max("az_idx").alias("max_row"), F.max("rng_idx").alias("max_col"),
        *[v.alias(n) for n, v in layer.items()],
    )
    placed = sums.join(axes, "scan_id").withColumns({"azimuth": interpolated("azimuths", "row"), "range_m": interpolated("ranges_m", "col")})
    lat, lon = polar_to_lat_lon("radar_lat", "radar_lon", "azimuth", "range_m")
    layers = F.array_compact(F.array(*[F.when(F.col(f"layer_{int(low)}") > 0, F.struct(F.lit(label).alias("label"), F.lit(low).alias("min_dbz"), F.lit(high).alias("max_dbz"), F.bround(f"layer_{int(low)}", 2).alias("area_km2"))) for low, high, label in INTENSITY]))
    return placed.withColumns({"lat": lat, "lon": lon, "layers": layers}).drop("azimuths", "ranges_m", "radar_lat", "radar_lon", *layer)


def _few(scans: DataFrame) -> bool:
    """Axes are broadcast only for a small number of scans, counted here; joins find their own way beyond it."""
    return scans.limit(201).count() <= 200


def detect_objects(scans: DataFrame, gates: DataFrame) -> Detection:
    """Objects of every scan: at least 4 km2, and 8 km2 or a peak of 40 dBZ. object_id numbers a scan's kept objects in
    the order of their blob's first gate, then seed; `rank` orders them by rounded peak and area, strongest first."""
    labels = landed(threshold_labels(gates), "threshold-labels")
    tree = landed(threshold_tree(labels), "threshold-tree")
    divided = landed(divide_gates(labels, split_seeds(tree)), "divided-gates")
    all_ = measured(divided, scans, ["scan_id", "blob", "seed"])
    kept = all_.filter((F.col("area") >= MIN_AREA_KM2) & (F.col("weight") != 0) & ((F.col("area") >= MIN_WEAK_AREA_KM2) | (F.col("peak") >= MIN_SMALL_PEAK)))
    kept = kept.withColumn("object_id", F.row_number().over(Window.partitionBy("scan_id").orderBy("blob", "seed")))
    rounded = kept.select(
        "scan_id", "object_id", "blob", "seed",
        F.bround("lat", 4).alias("centroid_lat"), F.bround("lon", 4).alias("centroid_lon"), F.bround(F.col("range_m") / 1000, 1).alias("distance_km"),
        F.bround(F.pmod("azimuth", F.lit(360.0)), 1).alias("bearing_deg"), F.bround("peak", 1).alias("peak_dbz"), intensity_label("peak").alias("peak_label"),
        F.bround("area", 2).alias("area_km2"), "layers", "min_row", "min_col", "max_row", "max_col", "pixel_count",
    )
    objects = landed(rounded.withColumn("rank", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.col("peak_dbz").desc(), F.col("area_km2").desc(), "object_id"))), "objects")
    object_gates = divided.join(objects.select("scan_id", "blob", "seed", "object_id"), ["scan_id", "blob", "seed"]).select("scan_id", "object_id", "az_idx", "rng_idx", "dbz")
    return Detection(objects, object_gates, tree)


def segmented(objects: DataFrame, tree: DataFrame) -> DataFrame:
    """objects with their blob's strongest node: threshold_level, threshold_parent_id, threshold_path."""
    best = threshold_paths(tree).groupBy("scan_id", "blob").agg(F.max_by(F.struct("threshold", "parent_node_id", "threshold_path"), F.struct("threshold", "pixel_count", "peak_dbz", -F.col("node_id"))).alias("s"))
    return objects.join(best, ["scan_id", "blob"], "left").select(objects["*"], F.col("s.threshold").alias("threshold_level"), F.col("s.parent_node_id").alias("threshold_parent_id"), F.col("s.threshold_path").alias("threshold_path"))
