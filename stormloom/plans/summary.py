"""One-paragraph summaries of scans, as expressions over one row per scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bearing_label, clamp, miles, square_miles
from ..operators.motion import UNDIRECTED, YOUNG

NOTHING = "No significant precipitation detected."


def _first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def strength_score(peak: Column, area: Column, n_positions: Column, identity: Column, is_focus: Column) -> Column:
    """How much an object stands for its scene; the last three are null for an object without a track."""
    track = F.least(n_positions, F.lit(6)) * 0.5 + clamp(identity) + F.when(is_focus, 3.0).otherwise(0.0)
    return peak + F.least(F.log1p(F.greatest(area, F.lit(0.0))), F.lit(6.0)) + F.coalesce(track, F.lit(0.0))


def motion_phrase(track: Column, merges_and_splits: Column) -> Column:
    """How a track moves; a focus that is followed with doubt counts as uncertain. Null without a track."""
    label, focus, identity = track["motion"]["heading_label"], track["focus"], F.coalesce(track["identity"]["score"], track["identity_confidence"])
    events = F.coalesce(focus["recent_structural_event_count"], merges_and_splits)
    with_focus = (focus["score"] <= 0.6) | ((focus["recent_heading_flip_count"] >= 2) & (events >= 4))
    without = (identity < 0.45) | ((events >= 6) & (identity < 0.75)) | (F.coalesce(track["identity"]["event_context"].isin(*YOUNG), F.lit(False)) & (identity < 0.75))
    doubtful = ~label.isin(*UNDIRECTED) & track["is_primary_focus"] & F.when(focus.isNotNull(), with_focus).otherwise(without)
    told = F.when(doubtful | (label == "uncertain"), ", tracking uncertain").when(label.isin("stationary", "nearly stationary"), F.concat(F.lit(", "), label))
    told = told.otherwise(F.format_string(", moving %s at %d mph", label, track["motion"]["speed_mph"]))
    return F.when(label.isNotNull(), told)


def rotation_phrase(strength: Column, history: Column) -> Column:
    """strength: of the object's rotation, null for none. history: its track's rotation entries, null without a track."""
    run = F.aggregate(F.reverse(history), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e["strength"].isNotNull(), 1).otherwise(0)).alias("n"), (s["on"] & e["strength"].isNotNull()).alias("on")))["n"]
    recent = F.slice(history, F.greatest(F.size(history) - 2, F.lit(1)), F.lit(3))
    weaker = F.exists(recent, lambda e: e["strength"].isNotNull()) & F.element_at(history, -1)["strength"].isNull()
    plain = F.concat(F.lit(" "), F.initcap(strength), F.lit(" rotation detected."))
    told = F.when(run >= 3, F.concat(F.lit(" Persistent "), strength, F.lit(" rotation."))).when(run <= 1, F.concat(F.lit(" New "), strength, F.lit(" rotation detected."))).otherwise(plain)
    return F.when(strength.isNull(), F.when(F.coalesce(weaker, F.lit(False)), " Rotation weakening.").otherwise("")).otherwise(F.when(history.isNull(), plain).otherwise(told))


def _note(n: Column, verb: str) -> Column:
    return F.when(n > 0, F.concat(F.lit(" Note: "), n.cast("string"), F.when(n == 1, " storm ").otherwise(" storms "), F.lit(f"{verb} in the last scan."))).otherwise("")


def scan_summaries(scans: DataFrame, objects: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """(scan_id, site_id, scan_ts, text). scans has site_name. Without tracked, or for a scan that isn't in it, the text
    tells of objects only. The focus storm leads; else the object of the greatest strength score."""
    has_rotation = "rotation" in objects.columns
    rotation = F.when(F.col("rotation").isNotNull(), F.struct(F.col("rotation.strength").alias("strength"), F.col("rotation.bearing_deg").alias("bearing_deg"), F.col("rotation.distance_km").alias("distance_km"))) if has_rotation else F.lit(None).cast("struct<strength:string,bearing_deg:double,distance_km:double>")
    of_scan = objects.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("rank", "object_id", "peak_dbz", "area_km2", "distance_km", "bearing_deg", "peak_label", rotation.alias("rotation")))).alias("objects"))
    rows = scans.select("scan_id", "site_id", "scan_ts", "site_name").join(of_scan, "scan_id", "left")
    if tracked is None:
        from ..streaming.tracker import EVENT, TRACK

        rows = rows.withColumns({"tracks": F.lit(None).cast(f"array<{TRACK}>"), "events": F.lit(None).cast(f"array<{EVENT}>")})
    else:
        rows = rows.join(tracked.select("scan_id", "tracks", "events"), "scan_id", "left")
    rows = rows.withColumn("active", F.filter("tracks", lambda t: t["status"] == "active"))

    def track_of(object_id: Column) -> Column:
        return _first(F.filter("active", lambda t: t["object_id"] == object_id))

    rows = rows.withColumn("focus", _first(F.filter("active", lambda t: t["is_primary_focus"])))

    def entry(o: Column) -> Column:
        t = track_of(o["object_id"])
        score = strength_score(o["peak_dbz"], o["area_km2"], F.size(t["positions"]), t["identity_confidence"], t["is_primary_focus"])
        return F.struct(score.alias("score"), o["peak_dbz"].alias("p"), o["area_km2"].alias("a"), (-o["distance_km"]).alias("d"), (-o["rank"]).alias("r"), o.alias("o"))

    rows = rows.withColumn("strongest", F.array_max(F.transform("objects", entry))["o"])
    now = F.element_at(F.col("focus.positions"), -1)
    led, s = F.col("focus").isNotNull(), F.col("strongest")
    rows = rows.withColumns({
        "lead_id": F.when(led, F.col("focus.object_id")).otherwise(s["object_id"]),
        "lead_label": F.when(led, now["peak_label"]).otherwise(s["peak_label"]),
        "lead_km": F.when(led, now["distance_km"]).otherwise(s["distance_km"]),
        "lead_bearing": F.when(led, now["bearing_deg"]).otherwise(s["bearing_deg"]),
        "lead_rotation": F.when(led, F.element_at(F.col("focus.rotation_history"), -1)["strength"]).otherwise(s["rotation"]["strength"]),
    })
    rows = rows.withColumn("lead_track", track_of(F.col("lead_id")))

    def happened(kind: str) -> Column:
        return F.greatest(F.coalesce(F.size(F.filter("events", lambda e: e["event_type"] == kind)), F.lit(0)), F.lit(0))

    merges, splits = happened("merge"), happened("split")
    n = F.size("objects")
    others = F.slice(F.filter("objects", lambda o: (o["object_id"] != F.col("lead_id")) & o["rotation"].isNotNull()), 1, 2)
    standing = F.array_join(F.transform(others, lambda o: F.format_string(" Rotation signature %d miles %s of the radar, %s shear.", miles(o["rotation"]["distance_km"]), bearing_label(o["rotation"]["bearing_deg"]), o["rotation"]["strength"])), "")
    area = F.aggregate("objects", F.lit(0.0), lambda t, o: t + o["area_km2"])
    text = F.concat(
        F.col("site_name"), F.lit(": "), n.cast("string"), F.when(n == 1, " rain object").otherwise(" rain objects"), F.lit(" detected. Strongest: "), F.col("lead_label"), F.lit(", "),
        miles("lead_km").cast("string"), F.lit(" miles "), bearing_label("lead_bearing"), F.lit(" of the radar"), F.coalesce(motion_phrase(F.col("lead_track"), merges + splits), F.lit("")), F.lit("."),
        rotation_phrase(F.col("lead_rotation"), F.col("lead_track.rotation_history")), _note(merges, "merged"), _note(splits, "split"), F.coalesce(standing, F.lit("")),
        F.lit(" Covering approximately "), square_miles(area).cast("string"), F.lit(" square miles."),
    )
    return rows.select("scan_id", "site_id", "scan_ts", F.when(F.col("objects").isNull(), F.concat("site_name", F.lit(f": {NOTHING}"))).otherwise(text).alias("text"))
