"""Motion of many tracks over tables of positions, by windows, regression aggregates and ordered conditions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.motion import FIELD_LAT, FIELD_QUALITY, KM_PER_DEG, MIN_HEADING_KMH, STEP_RATIO, STEP_TURN, STILL_KMH, STRONG_FIELD, TOO_FAST_KMH, UNDIRECTED, YOUNG
from ..functions.scalar import HIGH, MEDIUM, bearing_label, circular_mean, heading_delta, miles, signed_heading_delta


def micros(ts: str) -> Column:
    """Whole microseconds: their differences are exact, those of seconds since 1970 in doubles are off by up to 0.2 microseconds."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def track_steps(positions: DataFrame) -> DataFrame:
    """(track_id, ts, speed_kmh, heading_deg) of each step to a later position; the heading is null under 5 km/h.
    positions: track_id, ts, lat, lon, position_id (which orders equal times)."""
    path = Window.partitionBy("track_id").orderBy("ts", "position_id")
    hours = (micros("ts") - F.lag(micros("ts")).over(path)) / 1e6 / 3600
    lat0, lon0 = F.lag("lat").over(path), F.lag("lon").over(path)
    moved = positions.select("track_id", "ts", "position_id", hours.alias("hours"), ((F.col("lat") - lat0) * KM_PER_DEG).alias("north"), ((F.col("lon") - lon0) * KM_PER_DEG * F.cos(F.radians((F.col("lat") + lat0) / 2))).alias("east"))
    speed = F.sqrt(F.col("north") * F.col("north") + F.col("east") * F.col("east")) / F.col("hours")
    return moved.filter("hours > 0").withColumn("speed_kmh", speed).select("track_id", "ts", "position_id", "speed_kmh", F.when(F.col("speed_kmh") >= MIN_HEADING_KMH, F.pmod(F.degrees(F.atan2("east", "north")), F.lit(360.0))).alias("heading_deg"))


def step_headings(steps: DataFrame) -> DataFrame:
    """(track_id, headings): the step headings in order."""
    each = F.array_sort(F.collect_list(F.when(F.col("heading_deg").isNotNull(), F.struct("ts", "position_id", "heading_deg"))))
    return steps.groupBy("track_id").agg(F.transform(each, lambda x: x["heading_deg"]).alias("headings"))


def turns(headings: Column) -> Column:
    """Degrees between neighbours of an array of headings."""
    return F.zip_with(F.slice(headings, 1, F.greatest(F.size(headings) - 1, F.lit(0))), F.slice(headings, 2, F.greatest(F.size(headings) - 1, F.lit(0))), heading_delta)


def last(xs: Column, n: int) -> Column:
    return F.slice(xs, F.greatest(F.size(xs) - n + 1, F.lit(1)), F.lit(n))


def heading_flips(headings: Column, n: int = 4) -> Column:
    return F.size(F.filter(turns(last(headings, n)), lambda d: d >= STEP_TURN))


def recent_heading(headings: Column, n: int = 3) -> Column:
    """Mean of the last n headings if there are two at least and all are within 60 degrees of the newest."""
    recent = last(headings, n)
    steady = F.forall(recent, lambda h: heading_delta(F.element_at(recent, -1), h) <= 60.0)
    return F.when((F.size(headings) >= 2) & steady, circular_mean(recent))


def _confidence(label: str, score: float, reason: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))


def history_motion(positions: DataFrame) -> DataFrame:
    """Motion of each track by a straight line through its positions: speed, heading and how far to trust it; with
    headings (its step headings). All aggregates are algebraic, so they combine before the shuffle."""
    steps = track_steps(positions)
    of_steps = steps.groupBy("track_id").agg(F.min("speed_kmh").alias("slowest"), F.max("speed_kmh").alias("fastest"))
    start = positions.groupBy("track_id").agg(F.min(micros("ts")).alias("t0"))
    timed = positions.join(start, "track_id").withColumn("t", (micros("ts") - F.col("t0")) / 1e6)
    y = {c: (F.regr_slope(c, "t").alias(f"slope_{c}"), F.sqrt(F.greatest(F.regr_syy(c, "t") - F.regr_sxy(c, "t") * F.regr_sxy(c, "t") / F.regr_sxx(c, "t"), F.lit(0.0)) / F.count(F.lit(1))).alias(f"off_{c}")) for c in ("lat", "lon")}
    fit = timed.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("elapsed"), F.avg("lat").alias("mean_lat"), *y["lat"], *y["lon"])
    rows = fit.join(of_steps, "track_id", "left").join(step_headings(steps), "track_id", "left").withColumn("headings", F.coalesce("headings", F.array().cast("array<double>")))
    north, east = F.col("slope_lat") * 3600 * KM_PER_DEG, F.col("slope_lon") * 3600 * KM_PER_DEG * F.cos(F.radians("mean_lat"))
    moving = (F.col("n") >= 2) & (F.col("elapsed") > 0)
    rows = rows.withColumns({"speed_kmh": F.when(moving, F.bround(F.sqrt(north * north + east * east), 1)).otherwise(0.0), "raw_heading": F.bround(F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), 1), "residual": F.col("off_lat") + F.col("off_lon")})
    trust = (
        F.when(F.col("n") < 2, _confidence("high", 1.0, "insufficient movement history"))
        .when(F.col("elapsed") == 0, _confidence("low", 0.0, "zero elapsed time"))
        .when(F.col("speed_kmh") > TOO_FAST_KMH, _confidence("low", 0.0, "speed exceeds plausibility threshold"))
        .when((F.col("slowest") > 0) & (F.col("fastest") / F.col("slowest") > STEP_RATIO), _confidence("low", 0.2, "step speeds are inconsistent"))
        .when(F.col("fastest") > TOO_FAST_KMH, _confidence("low", 0.0, "step speed exceeds plausibility threshold"))
        .when(F.exists(turns(F.col("headings")), lambda d: d >= STEP_TURN), _confidence("low", 0.2, "step headings are inconsistent"))
        .when(F.col("n") == 2, _confidence("medium", 0.6, "two-point estimate"))
        .when(F.col("residual") > 0.05, _confidence("low", 0.25, "high regression residual"))
        .when(F.col("residual") > 0.01, _confidence("medium", 0.55, "moderate regression residual"))
        .otherwise(_confidence("high", 0.9, "stable multi-point history"))
    )
    rows = rows.withColumn("confidence", trust)
    directed = moving & (F.col("speed_kmh") >= STILL_KMH) & (F.col("confidence.label") != "low")
    label = F.when(~moving, "stationary").when(F.col("speed_kmh") < STILL_KMH, "nearly stationary").when(~directed, "uncertain").otherwise(bearing_label("raw_heading"))
    return rows.select("track_id", motion("speed_kmh", F.when(directed, F.col("raw_heading")), label, "confidence.label", "confidence.score", "confidence.reason", F.lit("track_history")).alias("motion"), "headings")


def motion(speed: Column | str, heading: Column, label: Column, grade: Column | str, score: Column | str, reason: Column | str, source: Column) -> Column:
    speed, grade, score, reason = (F.col(c) if isinstance(c, str) else c for c in (speed, grade, score, reason))
    return F.struct(speed.alias("speed_kmh"), miles(speed).alias("speed_mph"), heading.alias("heading_deg"), label.alias("heading_label"), grade.alias("confidence_label"), score.alias("confidence_score"), reason.alias("confidence_reason"), source.alias("source"))


def suppressed(reason: str) -> Column:
    return motion(F.lit(0.0), F.lit(None).cast("double"), F.lit("uncertain"), F.lit("low"), F.lit(0.0), F.lit(reason), F.lit("suppressed"))


def field_motion(delta_lat: Column, delta_lon: Column, quality: Column, source: Column, hours: Column) -> Column:
    """Motion struct by the scene's shift over so many hours; null without a shift or a positive time."""
    north, east = delta_lat * KM_PER_DEG, delta_lon * KM_PER_DEG * math.cos(math.radians(FIELD_LAT))
    speed, q = F.bround(F.sqrt(north * north + east * east) / hours, 1), F.greatest(F.least(quality, F.lit(1.0)), F.lit(0.0))
    heading = F.bround(F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), 1)
    still = speed < STILL_KMH
    grade = F.when(~still & (q >= HIGH), "high").when(q >= FIELD_QUALITY, "medium").otherwise("low")
    found = motion(speed, F.when(~still, heading), F.when(still, "nearly stationary").otherwise(bearing_label(heading)), grade, F.bround(q, 2), F.concat(F.lit("scene motion field from "), source), F.lit("motion_field"))
    return F.when(delta_lat.isNotNull() & (hours > 0), F.when(speed > TOO_FAST_KMH, suppressed("motion field exceeds plausibility threshold")).otherwise(found))


def reported_motion(history: Column, field: Column, headings: Column, identity: Column, context: Column, margin: Column, events: Column) -> Column:
    """What is reported of a track: the first rule that applies decides. history and field are motion structs."""

    def directed(m: Column) -> Column:
        return ~m["heading_label"].isin(*UNDIRECTED)

    def doubtful(young_below: float) -> Column:
        weak = identity < HIGH
        return ((events >= 6) & weak) | (F.coalesce(margin < 0.4, F.lit(False)) & weak) | (F.coalesce(context.isin(*YOUNG), F.lit(False)) & (identity < young_below))

    recent = recent_heading(headings)

    def against_steps(m: Column) -> Column:
        return F.coalesce(directed(m) & recent.isNotNull() & (heading_delta(m["heading_deg"], recent) >= 75.0), F.lit(False))

    has = field.isNotNull()
    faster = (F.abs(history["speed_kmh"] - field["speed_kmh"]) >= 30.0) & (history["speed_kmh"] / F.greatest(field["speed_kmh"], F.lit(5.0)) >= 1.8)
    elsewhere = (field["speed_kmh"] >= 5.0) & (history["speed_kmh"] >= 20.0) & (heading_delta(history["heading_deg"], field["heading_deg"]) >= 75.0)
    against_field = F.coalesce(has & (field["confidence_score"] >= STRONG_FIELD) & directed(history) & (faster | elsewhere), F.lit(False))
    publishable = ~directed(history) | ((history["confidence_label"] != "low") & (identity >= MEDIUM) & ~doubtful(0.85))
    by_field = F.when(against_steps(field), suppressed("recent track steps disagree with field heading")).otherwise(field)
    own = publishable & (((identity >= HIGH) & (history["confidence_label"] != "low")) | ((identity >= MEDIUM) & (history["confidence_label"] == "medium")))
    return (
        F.when(directed(history) & doubtful(HIGH), suppressed("track continuity too ambiguous for publishable motion"))
        .when(against_steps(history) & F.coalesce(has & field["heading_deg"].isNotNull() & (heading_delta(field["heading_deg"], recent) < 60.0), F.lit(False)), field)
        .when(against_steps(history), suppressed("recent track steps disagree with fitted heading"))
        .when(against_field, by_field)
        .when(own, history)
        .when(has & (field["confidence_score"] >= FIELD_QUALITY), by_field)
        .when(history["heading_label"].isin("stationary", "nearly stationary"), history)
        .otherwise(suppressed("track identity too weak for publishable motion"))
    )


def heading_stability(headings: Column) -> Column:
    """Struct (label, score, reason): how steady the last reported headings (an array) are."""
    signed = F.zip_with(F.slice(headings, 1, F.greatest(F.size(headings) - 1, F.lit(0))), F.slice(headings, 2, F.greatest(F.size(headings) - 1, F.lit(0))), signed_heading_delta)
    sizes = F.transform(signed, F.abs)
    reversals = F.size(F.filter(sizes, lambda d: d >= 90.0))
    signs = F.transform(F.filter(signed, lambda d: F.abs(d) >= 20.0), F.signum)
    changes = F.size(F.filter(F.zip_with(signs, F.slice(signs, 2, F.greatest(F.size(signs), F.lit(1))), lambda a, b: a != b), lambda x: F.coalesce(x, F.lit(False))))
    widest, mean = F.array_max(sizes), F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x) / F.size(sizes)
    return (
        F.when(F.size(headings) < 2, _confidence("insufficient", 1.0, "insufficient directional heading history"))
        .when((reversals >= 2) | (changes >= 2), _confidence("unstable", 0.1, "oscillating reported heading sequence"))
        .when((reversals >= 1) & (changes >= 1), _confidence("unstable", 0.2, "reversal-prone reported heading sequence"))
        .when(widest <= 35.0, _confidence("stable", 0.95, "consistent reported heading sequence"))
        .when((changes == 0) & (widest <= 75.0), _confidence("coherent_turn", 0.85, "coherent turning reported heading sequence"))
        .when((changes == 0) & (mean <= 60.0), _confidence("mixed", 0.65, "broad but one-directional reported heading changes"))
        .when(reversals >= 1, _confidence("mixed", 0.45, "single abrupt reported heading reversal"))
        .otherwise(_confidence("mixed", 0.6, "mixed reported heading sequence"))
    )


def focus_score(peak: Column, area: Column, n_positions: Column, identity: Column, prior: Column, distance: Column) -> Column:
    return peak / 10 + F.least(area / 150, F.lit(8.0)) + F.least(n_positions, F.lit(6)) * 0.7 + identity * 2 + F.when(prior, 2.5).otherwise(0.0) - F.least(distance / 40, F.lit(6.0))


def choose_focus(tracks: DataFrame) -> DataFrame:
    """One row per scan_id: focus_track_id, runner_up_track_id, selection_margin.

    tracks: scan_id, track_id, peak, area, n_positions, identity, distance, prior (was the focus before). A new track
    must lead the prior focus by 2, which already has a bonus."""
    scored = tracks.withColumn("score", focus_score(*(F.col(c) for c in ("peak", "area", "n_positions", "identity", "prior", "distance"))))
    entry = F.struct("score", "peak", "area", (-F.col("track_id")).alias("order"), "track_id", "prior")
    ranked = scored.groupBy("scan_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("r"))
    prior = F.get(F.filter("r", lambda x: x["prior"]), F.lit(0))
    first = F.get("r", F.lit(0))
    ranked = ranked.withColumn("stays", F.coalesce(prior.isNotNull() & ~first["prior"] & (first["score"] < prior["score"] + 2.0), F.lit(False)))
    others = F.transform(F.filter("r", lambda x: ~x["prior"]), lambda x: F.struct(x["score"].alias("score"), x["track_id"].alias("track_id")))
    ranked = ranked.withColumns({"focus": F.when(F.col("stays"), prior).otherwise(first), "second": F.when(F.col("stays"), F.array_max(others)).otherwise(F.get(F.transform("r", lambda x: F.struct(x["score"].alias("score"), x["track_id"].alias("track_id"))), F.lit(1)))})
    return ranked.select("scan_id", F.col("focus.track_id").alias("focus_track_id"), F.col("second.track_id").alias("runner_up_track_id"), F.bround(F.col("focus.score") - F.col("second.score"), 2).alias("selection_margin"))
