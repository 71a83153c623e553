"""Replays: diagnostics of each scan, snapshots, benchmark results and their report."""

from __future__ import annotations

import argparse
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import heading_delta
from ..sources.landing import landed
from ..sources.sites import site_name
from .ingest import Ingested, ingest
from .summary import scan_summaries

QUICK_SCANS, DEFAULT_SCANS = 3, 5


def diagnostics(done: Ingested) -> DataFrame:
    """One row per scan: counts, the focus storm's state, quality and the summary."""
    scans = site_name(done.scans, "site_id", F.upper("site_id"))
    texts = scan_summaries(scans, done.objects, done.tracked).select("scan_id", F.col("text").alias("summary"))
    counts = done.objects.groupBy("scan_id").agg(F.count(F.lit(1)).alias("object_count"))
    rows = done.tracked.join(counts, "scan_id", "left").join(done.quality, "scan_id", "left").join(texts, "scan_id", "left").na.fill(0, ["object_count"])
    active = F.filter("tracks", lambda t: t["status"] == "active")
    rows = rows.withColumn("active", active).withColumn("f", F.get(F.filter("active", lambda t: t["is_primary_focus"]), F.lit(0)))
    path = Window.partitionBy("site_id").orderBy("scan_ts", "scan_id")
    seen = F.coalesce(F.lag("n_tracks").over(path), F.lit(0))
    return rows.select(
        "site_id", "scan_id", "scan_ts", "object_count", F.size("active").alias("active_count"),
        F.size(F.filter("active", lambda t: t["motion"]["heading_label"] == "uncertain")).alias("uncertain_tracks"),
        F.greatest(F.coalesce(F.array_max(F.transform("active", lambda t: t["motion"]["speed_mph"])), F.lit(0)), F.lit(0)).alias("max_speed_mph"),
        F.size(F.filter("events", lambda e: e["event_type"] == "merge")).alias("merge_count"), F.size(F.filter("events", lambda e: e["event_type"] == "split")).alias("split_count"),
        F.col("f.track_id").alias("focus_track_id"), F.col("f.identity.label").alias("focus_identity_label"), F.bround("f.identity.score", 2).alias("focus_identity_score"),
        F.col("f.focus.label").alias("focus_continuity_label"), F.bround("f.focus.score", 2).alias("focus_continuity_score"), F.bround("f.focus.selection_margin", 2).alias("focus_selection_margin"),
        F.col("f.focus.runner_up_track_id").alias("focus_runner_up_track_id"), F.col("f.focus.recent_reported_heading_flip_count").alias("focus_reported_heading_flip_count"),
        F.coalesce(F.col("f.focus.recent_reported_heading_sequence"), F.array().cast("array<string>")).alias("focus_reported_heading_sequence"),
        F.col("f.focus.reported_heading_stability_label").alias("focus_reported_heading_stability_label"), F.bround("f.focus.reported_heading_stability_score", 2).alias("focus_reported_heading_stability_score"),
        F.col("f.focus.reported_heading_stability_reason").alias("focus_reported_heading_stability_reason"),
        F.col("f.motion.heading_deg").alias("focus_heading_deg"), F.col("f.motion.heading_label").alias("focus_heading_label"), F.col("f.motion.speed_mph").alias("focus_speed_mph"),
        F.col("f.motion.source").alias("focus_motion_source"), F.col("f.motion.confidence_label").alias("focus_motion_confidence_label"), F.bround("f.motion.confidence_score", 2).alias("focus_motion_confidence_score"),
        F.coalesce("score", F.lit(1.0)).alias("scan_quality_score"), F.coalesce("flags", F.array().cast("array<string>")).alias("scan_quality_flags"),
        (F.col("n_tracks") - seen).alias("new_tracks"), F.col("n_tracks").alias("total_tracks_seen"), "summary",
    )


def roll_up(snapshots: DataFrame) -> DataFrame:
    """One row per benchmark_id over its snapshots in the order of scan_ts: means (0 of nothing), maxima and counts.

    A focus switch or heading flip is between neighbours that both have a value; a null in between breaks the link."""
    path = Window.partitionBy("benchmark_id").orderBy("scan_ts", "scan_id")
    rows = snapshots.withColumns({"before_focus": F.lag("focus_track_id").over(path), "before_heading": F.lag("focus_heading_deg").over(path), "place": F.row_number().over(path)})
    flip = F.col("before_heading").isNotNull() & F.col("focus_heading_deg").isNotNull() & (heading_delta("before_heading", "focus_heading_deg") >= 90.0)

    def mean(c: str) -> F.Column:
        return F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 2)

    uncertain, moving = F.col("summary").contains("tracking uncertain"), F.col("summary").contains("moving ")
    low_motion = F.coalesce(F.col("focus_motion_confidence_score") < 0.45, F.lit(False))
    fresh = F.sum(F.when(F.col("place") > 1, F.col("new_tracks")).otherwise(0))
    return rows.groupBy("benchmark_id").agg(
        F.count(F.lit(1)).alias("scan_count"), mean("object_count").alias("mean_objects"), mean("active_count").alias("mean_active_tracks"), F.max("max_speed_mph").alias("max_speed_mph"),
        F.sum("merge_count").alias("total_merges"), F.sum("split_count").alias("total_splits"), mean("uncertain_tracks").alias("mean_uncertain_tracks"),
        mean("focus_identity_score").alias("mean_focus_identity_confidence"), mean("focus_continuity_score").alias("mean_focus_continuity"), mean("focus_selection_margin").alias("mean_focus_selection_margin"), mean("focus_motion_confidence_score").alias("mean_focus_motion_confidence"),
        F.count_if(F.col("focus_identity_score") < 0.45).alias("focus_low_identity_scans"), F.count_if(F.col("focus_continuity_score") <= 0.6).alias("focus_low_continuity_scans"), F.count_if(low_motion).alias("focus_low_motion_scans"),
        F.count_if(F.col("focus_reported_heading_flip_count") >= 1).alias("focus_reported_heading_reversal_scans"), F.count_if(F.col("focus_motion_source") == "motion_field").alias("focus_motion_field_source_scans"), F.count_if(F.col("focus_motion_source") == "suppressed").alias("focus_motion_suppressed_source_scans"),
        F.count_if(F.col("before_focus") != F.col("focus_track_id")).alias("focus_switches"), F.count_if(flip).alias("focus_heading_flips_ge_90"), F.count_if(flip & low_motion).alias("focus_flips_with_low_motion_confidence"), F.count_if(flip).alias("focus_track_distance_changes"),
        F.count_if(uncertain).alias("summary_tracking_uncertain_count"), F.count_if(moving & ~uncertain).alias("summary_motion_published_count"), F.count_if(F.col("summary").contains("stationary")).alias("summary_stationaryish_count"),
        fresh.alias("total_new_tracks_after_first_scan"), F.bround(fresh / F.greatest(F.sum("object_count"), F.lit(1)), 3).alias("fragmentation_proxy"),
    )


def lineage_totals(tracked: DataFrame) -> DataFrame:
    """Per site, of the tracks as they are in the end: merged, lost, children and absorbed."""
    each = tracked.select("site_id", F.struct("scan_ts", "scan_id").alias("at"), F.explode_outer("tracks").alias("t")).select("site_id", F.col("t.track_id").alias("track_id"), "at", F.struct("t.status", F.size("t.child_track_ids").alias("children"), F.size("t.absorbed_track_ids").alias("absorbed")).alias("t"))
    last = each.groupBy("site_id", "track_id").agg(F.max_by("t", "at").alias("t"))

    def total(c: str) -> F.Column:
        return F.coalesce(F.sum(F.when(F.col("track_id").isNotNull(), F.col(c))), F.lit(0)).cast("int")

    return last.groupBy("site_id").agg(F.count_if(F.col("t.status") == "merged").cast("int").alias("merged_tracks_total"), F.count_if(F.col("t.status") == "lost").cast("int").alias("lost_tracks_total"), total("t.children").alias("split_children_total"), total("t.absorbed").alias("absorbed_links_total"))


def run_benchmarks(manifest: DataFrame, scans: DataFrame, gates: DataFrame, velocity_sweeps: DataFrame, velocity_gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, snapshots) of all entries of a manifest in one plan: each entry's last scans, up to and with the one
    named in end_filename (here its scan_id as text), are followed apart, as a site of its own."""
    day = manifest.select(F.col("id").alias("benchmark_id"), "category", F.col("site_id").alias("m_site"), F.to_date("date").alias("m_day"), F.col("scans").alias("n"), "local_only", "end_filename")
    mine = scans.join(F.broadcast(day), (F.col("site_id") == F.col("m_site")) & (F.col("m_day").isNull() | (F.to_date("scan_ts") == F.col("m_day"))))
    path = Window.partitionBy("benchmark_id").orderBy("scan_ts", "scan_id")
    mine = mine.withColumn("k", F.row_number().over(path))
    end = F.max(F.when(F.col("end_filename").isNull() | (F.col("end_filename") == F.col("scan_id").cast("string")), F.col("k"))).over(Window.partitionBy("benchmark_id"))
    mine = mine.withColumn("last", end).filter((F.col("k") <= F.col("last")) & (F.col("k") > F.col("last") - F.col("n")))
    key = F.xxhash64("benchmark_id", "scan_id")
    ids = mine.select("benchmark_id", "category", "m_site", "local_only", F.col("scan_id").alias("old_id"), key.alias("new_id"))
    ids = landed(ids, "benchmark-scans")

    def copied(df: DataFrame) -> DataFrame:
        return df.join(ids.select("old_id", "new_id"), df["scan_id"] == F.col("old_id")).withColumn("scan_id", F.col("new_id")).drop("old_id", "new_id")

    own = landed(mine.withColumn("site_id", F.concat_ws("|", "benchmark_id", "site_id")).withColumn("scan_id", key).select(scans.columns), "benchmark-headers")
    done = ingest(own, copied(gates), copied(velocity_sweeps), copied(velocity_gates))
    shots = landed(diagnostics(done), "diagnostics").withColumn("benchmark_id", F.regexp_extract("site_id", r"(?s)^(.*)\|", 1))
    totals = lineage_totals(done.tracked).withColumn("benchmark_id", F.regexp_extract("site_id", r"(?s)^(.*)\|", 1)).drop("site_id")
    about = ids.select("benchmark_id", "category", F.col("m_site").alias("site_id"), "local_only").distinct()
    return about.join(roll_up(shots), "benchmark_id").join(totals, "benchmark_id"), shots


REPORTED = {
    "scans": "scan_count", "mean objects": "mean_objects", "mean active tracks": "mean_active_tracks", "max speed mph": "max_speed_mph", "total merges": "total_merges", "total splits": "total_splits",
    "mean uncertain tracks": "mean_uncertain_tracks", "mean focus identity confidence": "mean_focus_identity_confidence", "mean focus continuity": "mean_focus_continuity", "mean focus selection margin": "mean_focus_selection_margin",
    "mean focus motion confidence": "mean_focus_motion_confidence", "focus low-identity scans": "focus_low_identity_scans", "focus low-continuity scans": "focus_low_continuity_scans", "focus low-motion scans": "focus_low_motion_scans",
    "focus reported-heading-reversal scans": "focus_reported_heading_reversal_scans", "focus motion-field source scans": "focus_motion_field_source_scans", "focus suppressed-motion source scans": "focus_motion_suppressed_source_scans",
    "focus switches": "focus_switches", "focus heading flips >=90 deg": "focus_heading_flips_ge_90", "focus flips with low motion confidence": "focus_flips_with_low_motion_confidence",
    "summary tracking-uncertain count": "summary_tracking_uncertain_count", "summary moving-motion count": "summary_motion_published_count", "summary stationary/nearly-stationary count": "summary_stationaryish_count",
    "total new tracks after first scan": "total_new_tracks_after_first_scan", "merged tracks total": "merged_tracks_total", "lost tracks total": "lost_tracks_total", "split children total": "split_children_total", "absorbed links total": "absorbed_links_total", "fragmentation proxy": "fragmentation_proxy",
}


def snapshot_line(s: dict) -> str:
    """A scan's diagnostics on one line."""
    sequence = "|".join(s["focus_reported_heading_sequence"]) or "none"
    parts = {
        "objects": s["object_count"], "active": s["active_count"], "uncertain": s["uncertain_tracks"], "max_speed_mph": s["max_speed_mph"], "merges": s["merge_count"], "splits": s["split_count"], "focus_track": s["focus_track_id"],
        "focus_identity": f"{s['focus_identity_label']}:{s['focus_identity_score']}", "focus_continuity": f"{s['focus_continuity_label']}:{s['focus_continuity_score']}", "focus_margin": s["focus_selection_margin"], "runner_up": s["focus_runner_up_track_id"],
        "focus_reported_flips": s["focus_reported_heading_flip_count"], "focus_reported_sequence": sequence, "focus_reported_stability": f"{s['focus_reported_heading_stability_label']}:{s['focus_reported_heading_stability_score']}",
        "focus_heading": s["focus_heading_label"], "focus_motion_source": s["focus_motion_source"], "focus_motion_conf": f"{s['focus_motion_confidence_label']}:{s['focus_motion_confidence_score']}",
    }
    return f"{s['scan_ts'].isoformat()} " + " ".join(f"{k}={v}" for k, v in parts.items())


def render_markdown(results: Iterable[dict], snapshots: Iterable[dict], today: date | None = None) -> str:
    """The report of benchmark results, a small table by its nature: one row per entry of a manifest."""
    shots: dict[str, list[dict]] = {}
    for s in snapshots:
        shots.setdefault(s["benchmark_id"], []).append(s)
    out = ["# Tracking Evaluation Report", "", f"Date: {(today or date.today()).isoformat()}", "", "## Benchmarks", ""]
    for r in results:
        out += [f"### {r['benchmark_id']}", "", f"- category: `{r['category']}`", f"- site: `{r['site_id']}`", *(f"- {label}: `{r[c]}`" for label, c in REPORTED.items()), "", "Representative snapshots:", ""]
        out += [f"- `{snapshot_line(s)}`" for s in sorted(shots.get(r["benchmark_id"], []), key=lambda s: s["scan_ts"])] + [""]
    return "\n".join(out)


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Replay scans of a site from gate tables and print what is followed.")
    parser.add_argument("site_id")
    parser.add_argument("--tables", default=".", help="folder with scans, gates, velocity_sweeps and velocity_gates as Parquet")
    parser.add_argument("--date", help="day, YYYY-MM-DD")
    parser.add_argument("--scans", type=int, help=f"number of scans; {DEFAULT_SCANS}, or {QUICK_SCANS} with --quick")
    parser.add_argument("--quick", action="store_true")
    parser.add_argument("--local-only", action="store_true", help="only scans that the tables hold; always so here")
    parser.add_argument("--end-filename", help="the last scan's id")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    spark = SparkSession.builder.getOrCreate()
    n = args.scans if args.scans is not None else QUICK_SCANS if args.quick else DEFAULT_SCANS
    entry = spark.createDataFrame([("replay", "replay", args.site_id.upper(), args.date, n, True, args.end_filename)], "id string, category string, site_id string, date string, scans int, local_only boolean, end_filename string")
    tables = [spark.read.parquet(f"{args.tables}/{t}") for t in ("scans", "gates", "velocity_sweeps", "velocity_gates")]
    _, shots = run_benchmarks(entry, *tables)
    for row in shots.orderBy("scan_ts").toLocalIterator():
        print(snapshot_line(row.asDict(True)))
        print(f"  {row['summary']}")


if __name__ == "__main__":
    main()
