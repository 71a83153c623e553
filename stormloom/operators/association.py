"""Scoring of tracks against the objects of the next scan, over tables: overlaps by joining gates, costs by expressions,
matching one scan pair to a task. The tracker's fold does the same on its state."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import priced_assignment
from ..functions.scalar import clamp, haversine_km, match_quality, round_even, scan_quality_factor

MIN_OVERLAP, MIN_IOU = 0.30, 0.15
REACH_KMH, STILL_REACH_KM, LEAST_REACH_KM, UNMATCHED, COST_UNIT = 120.0, 50.0, 5.0, 10.0, 1e-4
MATCHES = "pair_id long, track_id int, object_id int, total_cost double"


def scan_pairs(scans: DataFrame) -> DataFrame:
    """(site_id, previous_id, scan_id, hours) of consecutive scans of a site; the first has none."""
    site = Window.partitionBy("site_id").orderBy("scan_ts", "scan_id")
    hours = (F.unix_timestamp("scan_ts") - F.unix_timestamp(F.lag("scan_ts").over(site))) / 3600
    return scans.select("site_id", F.lag("scan_id").over(site).alias("previous_id"), "scan_id", hours.alias("hours")).filter("previous_id IS NOT NULL")


def mask_overlaps(before: DataFrame, after: DataFrame, shifts: DataFrame | None = None, shape: DataFrame | None = None) -> DataFrame:
    """Per pair_id and pair of masks that share gates: overlap (share of the first covered) and iou.

    before, after: (pair_id, object_id, az_idx, rng_idx). shifts: (pair_id, rows, cols), cells by which the first masks
    are moved, rounded; with shape (pair_id, n_az, n_rng), gates moved off the grid are lost."""
    if shifts is not None:
        moved = before.join(shifts, "pair_id").join(shape, "pair_id")
        moved = moved.withColumns({"az_idx": F.col("az_idx") + F.rint("rows").cast("int"), "rng_idx": F.col("rng_idx") + F.rint("cols").cast("int")})
        before = moved.filter("az_idx >= 0 AND az_idx < n_az AND rng_idx >= 0 AND rng_idx < n_rng").select("pair_id", "object_id", "az_idx", "rng_idx")
    sizes = [d.groupBy("pair_id", F.col("object_id").alias(n)).agg(F.count(F.lit(1)).alias(f"n_{n}")) for d, n in ((before, "prev_id"), (after, "object_id"))]
    shared = before.withColumnRenamed("object_id", "prev_id").join(after, ["pair_id", "az_idx", "rng_idx"]).groupBy("pair_id", "prev_id", "object_id").agg(F.count(F.lit(1)).alias("shared"))
    both = shared.join(sizes[0], ["pair_id", "prev_id"]).join(sizes[1], ["pair_id", "object_id"])
    return both.select("pair_id", "prev_id", "object_id", "shared", (F.col("shared") / F.col("n_prev_id")).alias("overlap"), (F.col("shared") / (F.col("n_prev_id") + F.col("n_object_id") - F.col("shared"))).alias("iou"))


def candidate_scores(tracks: DataFrame, objects: DataFrame, overlaps: DataFrame, advected: DataFrame, hours: Column) -> DataFrame:
    """Scores of every track against every object of its pair that isn't implausible in all respects.

    tracks: pair_id, track_id, prev_id, lat, lon, area, peak, predicted_lat, predicted_lon (and what hours needs).
    objects: pair_id, object_id, lat, lon, area, peak. A pair is one scan's objects against the last one's, so its
    all-against-all stays within it; it is an equi-join on pair_id."""
    o = objects.select("pair_id", "object_id", *[F.col(c).alias(f"o_{c}") for c in ("lat", "lon", "area", "peak")])
    pairs = tracks.join(o, "pair_id").join(overlaps.select("pair_id", "prev_id", "object_id", "overlap"), ["pair_id", "prev_id", "object_id"], "left").join(advected.select("pair_id", "prev_id", "object_id", F.col("iou").alias("advected")), ["pair_id", "prev_id", "object_id"], "left").na.fill(0.0, ["overlap", "advected"])
    reach = F.greatest(F.when(hours > 0, hours * REACH_KMH).otherwise(F.lit(STILL_REACH_KM)), F.lit(LEAST_REACH_KM))
    pairs = pairs.withColumns({"reach": reach, "distance": haversine_km("lat", "lon", "o_lat", "o_lon"), "off": haversine_km("predicted_lat", "predicted_lon", "o_lat", "o_lon")})
    pairs = pairs.filter(~((F.col("overlap") < MIN_OVERLAP) & (F.col("advected") < MIN_IOU) & (F.col("distance") > F.col("reach"))))
    far, off = (F.least(F.col(c) / F.col("reach"), F.lit(5.0)) for c in ("distance", "off"))
    area = F.abs(F.col("o_area") - F.col("area")) / F.greatest("area", F.lit(1.0))
    intensity = F.abs(F.col("o_peak") - F.col("peak")) / 60
    total = (1 - F.greatest("overlap", "advected")) * 0.65 + off * 0.18 + far * 0.07 + area * 0.07 + intensity * 0.03
    named = {"overlap_score": F.col("overlap"), "advected_overlap_score": F.col("advected"), "distance_score": far, "predicted_position_score": off, "area_change_score": area, "intensity_change_score": intensity, "total_cost": total}
    return pairs.select("pair_id", "track_id", "object_id", *[round_even(v, 4).alias(n) for n, v in named.items()])


def ambiguity_margins(scores: DataFrame) -> DataFrame:
    """scores with margin: the lesser of the object's and the track's lead of the best over the second cost; null if
    neither has two candidates."""

    def lead(key: str) -> Column:
        costs = F.array_sort(F.collect_list("total_cost").over(Window.partitionBy("pair_id", key)))
        return F.when(F.size(costs) > 1, F.get(costs, F.lit(1)) - F.get(costs, F.lit(0)))

    return scores.withColumn("margin", F.bround(F.least(lead("object_id"), lead("track_id")), 2))


def identity_scores(scores: DataFrame, quality: Column, lineage: Column) -> DataFrame:
    """scores (with margin) with match_quality and identity_score of the track if it takes the object."""
    clear = F.when(F.col("margin").isNull(), 0.7).otherwise(clamp(F.col("margin") / 0.75))
    line = F.greatest(F.lit(0.55), 1 - lineage * 0.08)
    graded = scores.withColumn("match_quality", match_quality("total_cost"))
    score = F.bround(F.col("match_quality") * 0.45 + clear * 0.2 + scan_quality_factor(quality) * 0.15 + line * 0.2, 2)
    return graded.withColumn("identity_score", F.when(F.col("margin") < 0.15, F.least(score, F.lit(0.4))).otherwise(score))


def priced_matches(scores: DataFrame) -> DataFrame:
    """One-to-one matches of least total cost per pair, an absent candidate costing 10, with the prices that prove them: one
    task per scan pair. A row per track and per object: a matched track's has its object and total_cost; those that a
    candidate doesn't match have null there. An object's row has null as track_id. Costs count in whole units of COST_UNIT,
    to which candidate_scores rounds them: sums of whole numbers are exact, so that of several cheapest matchings the same
    one is found everywhere.

    A pair isn't divided into components of its candidates: one that costs more than 10 may be worse than none, and then
    what is best in a component depends on the others."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracks, row = np.unique(pdf["track_id"], return_inverse=True)
        objects, col = np.unique(pdf["object_id"], return_inverse=True)
        cost = np.full((len(tracks), len(objects)), UNMATCHED)
        cost[row, col] = pdf["total_cost"]
        pairs, *prices = priced_assignment(np.rint(cost / COST_UNIT))
        of_track, of_object = (p * COST_UNIT for p in prices)
        won = {r: c for r, c in pairs if cost[r, c] < UNMATCHED}
        pair = int(pdf["pair_id"].iloc[0])
        rows = [(pair, int(t), int(objects[won[r]]) if r in won else None, float(cost[r, won[r]]) if r in won else None, float(of_track[r])) for r, t in enumerate(tracks)]
        rows += [(pair, None, int(o), None, float(of_object[c])) for c, o in enumerate(objects)]
        found = pd.DataFrame(rows, columns=["pair_id", "track_id", "object_id", "total_cost", "price"])
        return found.astype({"track_id": "Int32", "object_id": "Int32", "total_cost": "Float64"})

    return scores.groupBy("pair_id").applyInPandas(run, f"{MATCHES}, price double")


def match_tracks(scores: DataFrame) -> DataFrame:
    """The matches of priced_matches."""
    return priced_matches(scores).filter("track_id IS NOT NULL AND object_id IS NOT NULL").select("pair_id", "track_id", "object_id", "total_cost")


def match_proofs(scores: DataFrame, priced: DataFrame) -> DataFrame:
    """Per pair what shows its matches to be the cheapest: n_matches; cost, 10 for each track or object that the smaller
    side leaves without a match; bound, which no matching is below, as long as slack (how much more than its prices the
    cheapest cell costs) and room (how far prices of the larger side stay below 0) aren't negative. The matches are optimal
    if cost equals bound."""
    track, of_object = F.col("track_id").isNotNull(), F.col("track_id").isNull()
    sizes = priced.groupBy("pair_id").agg(F.count_if(track).alias("n_t"), F.count_if(of_object).alias("n_o"), F.count("total_cost").alias("n_matches"), F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("paid"), F.sum("price").alias("bound"), F.max(F.when(track, F.col("price"))).alias("top_t"), F.max(F.when(of_object, F.col("price"))).alias("top_o"))
    prices = [priced.filter(side).select("pair_id", n, F.col("price").alias(f"price_{n}")) for side, n in ((track, "track_id"), (of_object, "object_id"))]
    cells = prices[0].join(prices[1], "pair_id").join(scores.select("pair_id", "track_id", "object_id", "total_cost"), ["pair_id", "track_id", "object_id"], "left")
    slack = cells.groupBy("pair_id").agg(F.min(F.coalesce("total_cost", F.lit(UNMATCHED)) - F.col("price_track_id") - F.col("price_object_id")).alias("slack"))
    room = F.when(F.col("n_t") < F.col("n_o"), -F.col("top_o")).when(F.col("n_t") > F.col("n_o"), -F.col("top_t")).otherwise(F.lit(0.0))
    return sizes.join(slack, "pair_id").select("pair_id", "n_matches", (F.col("paid") + UNMATCHED * (F.least("n_t", "n_o") - F.col("n_matches"))).alias("cost"), "bound", "slack", room.alias("room"))


def merge_candidates(scores: DataFrame, matches: DataFrame) -> DataFrame:
    """(pair_id, object_id, track_ids): the matched track first, then the object's other candidates by cost."""
    ranked = scores.groupBy("pair_id", "object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("total_cost", "track_id"))), lambda x: x["track_id"]).alias("all"))
    won = ranked.join(matches.select("pair_id", "object_id", "track_id"), ["pair_id", "object_id"]).withColumn("others", F.array_remove("all", F.col("track_id")))
    return won.filter(F.size("others") > 0).select("pair_id", "object_id", F.concat(F.array("track_id"), "others").alias("track_ids"))


def split_candidates(scores: DataFrame, matches: DataFrame) -> DataFrame:
    """(pair_id, track_id, object_ids): the matched object first, then those whose cheapest track this one is."""
    cheapest = scores.groupBy("pair_id", "object_id").agg(F.min_by("track_id", F.struct("total_cost", "track_id")).alias("best"))
    mine = scores.join(cheapest, ["pair_id", "object_id"]).filter("best = track_id").groupBy("pair_id", "track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("total_cost", "object_id"))), lambda x: x["object_id"]).alias("all"))
    won = mine.join(matches.select("pair_id", "track_id", "object_id"), ["pair_id", "track_id"]).withColumn("others", F.array_remove("all", F.col("object_id")))
    return won.filter(F.size("others") > 0).select("pair_id", "track_id", F.concat(F.array("object_id"), "others").alias("object_ids"))


def _events(candidates: DataFrame, kind: str, text: Callable[[Column, Column], Column]) -> DataFrame:
    """(pair_id, event_type, description, involved_track_ids) of (pair_id, track_id, other_ids); repeats and the track
    itself are taken out of the others, and a row without others is no event."""
    others = F.array_except(F.array_distinct("other_ids"), F.array("track_id"))
    listed = candidates.withColumn("others", others).filter(F.size("others") > 0)
    told = text(F.array_join(F.col("others").cast("array<string>"), ", "), F.col("track_id").cast("string"))
    return listed.select("pair_id", F.lit(kind).alias("event_type"), told.alias("description"), F.concat(F.array("track_id"), "others").alias("involved_track_ids"))


def merge_events(candidates: DataFrame) -> DataFrame:
    """The merges into each track_id of its other_ids, as events."""
    return _events(candidates, "merge", lambda others, track: F.concat(F.lit("Tracks "), others, F.lit(" merged into track "), track))


def split_events(candidates: DataFrame) -> DataFrame:
    """The splits of each track_id into its other_ids, as events."""
    return _events(candidates, "split", lambda others, track: F.concat(F.lit("Track "), track, F.lit(" split into tracks "), others))


def object_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, delta_lat, delta_lon, quality): shift of the objects' weighted centre; weights are area times peak."""
    w = F.greatest("area", F.lit(0.1)) * F.greatest("peak", F.lit(20.0))

    def centre(objects: DataFrame, n: str) -> DataFrame:
        return objects.groupBy("pair_id").agg((F.sum(F.col("lat") * w) / F.sum(w)).alias(f"lat_{n}"), (F.sum(F.col("lon") * w) / F.sum(w)).alias(f"lon_{n}"), F.sum(w).alias(f"w_{n}"))

    both = centre(before, "a").join(centre(after, "b"), "pair_id")
    return both.select("pair_id", F.bround(F.col("lat_b") - F.col("lat_a"), 4).alias("delta_lat"), F.bround(F.col("lon_b") - F.col("lon_a"), 4).alias("delta_lon"), F.bround(F.least("w_a", "w_b") / F.greatest("w_a", "w_b"), 3).alias("quality"))


def blended_shift(scene: Column, local: Column) -> Column:
    """Structs (delta_lat, delta_lon, quality, source), either may be null: the scene's, corrected by the local one where
    that is good and not far off."""
    none = F.struct(F.lit(0.0).alias("delta_lat"), F.lit(0.0).alias("delta_lon"), F.lit(0.0).alias("quality"), F.lit("blended_motion").alias("source"))
    no_local, no_scene = local.isNull() | (local["quality"] <= 0), scene.isNull() | (scene["quality"] <= 0)
    far = F.hypot(local["delta_lat"] - scene["delta_lat"], local["delta_lon"] - scene["delta_lon"]) > 0.03
    a, b = local["quality"], scene["quality"] * 0.6

    def mix(c: str) -> Column:
        return F.bround((local[c] * a + scene[c] * b) / (a + b), 4).alias(c)

    both = F.struct(mix("delta_lat"), mix("delta_lon"), F.bround(F.least(F.lit(1.0), F.greatest(a, scene["quality"])), 3).alias("quality"), F.concat(F.lit("blended:"), scene["source"], F.lit("+"), local["source"]).alias("source"))
    return F.when(no_local, F.coalesce(scene, none)).when(no_scene, local).when((a < 0.6) | ((scene["quality"] >= 0.35) & far), scene).otherwise(both)
