from __future__ import annotations

import itertools
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormloom.functions import scalar
from stormloom.operators import association as A
from stormloom.plans import api, replay, summary
from stormloom.plans.ingest import ingest
from stormloom.sources import catalog, manifest, sites
from stormloom.streaming import buffer, tracker

from .conftest import AZ, RADAR, RNG, T0, Scenes, grid


def obj(k: int, lat=35.5, lon=-97.3, peak=45.0, area=100.0) -> dict:
    return {"object_id": k, "centroid_lat": lat, "centroid_lon": lon, "distance_km": 40.0, "bearing_deg": 270.0, "peak_dbz": peak, "peak_label": "heavy rain", "area_km2": area, "rotation": None}


def scan(n: int, masks: dict[int, tuple], site="KTLX", quality=1.0, objects=None) -> tracker.Scan:
    g = grid(*[(*m, 45.0) for m in masks.values()])
    cells = {k: tuple(x.ravel() for x in np.mgrid[m[0] : m[1], m[2] : m[3]]) for k, m in masks.items()}
    return tracker.Scan(n, site, T0 + timedelta(minutes=5 * n), np.array(AZ), np.array(RNG), *RADAR, g, quality, objects or [obj(k) for k in masks], cells)


def follow(*scans: tracker.Scan) -> tracker.Tracker:
    t = tracker.Tracker()
    for s in scans:
        t.advance(s)
    return t


def test_a_storm_that_stays_is_one_track():
    t = follow(scan(0, {1: (10, 20, 10, 20)}), scan(1, {1: (11, 21, 11, 21)}))
    assert len(t.tracks) == 1 and len(t.tracks[0].positions) == 2 and t.tracks[0].is_focus and t.tracks[0].confidence > 0.75


def test_two_misses_lose_a_track():
    t = follow(scan(0, {1: (10, 20, 10, 20)}), scan(1, {}), scan(2, {}))
    assert t.tracks[0].status == "lost" and t.tracks[0].missed == 2


def test_merge():
    t = follow(scan(0, {1: (10, 20, 10, 20), 2: (10, 20, 20, 30)}), scan(1, {1: (10, 20, 10, 30)}))
    assert sorted(x.status for x in t.tracks) == ["active", "merged"] and [e["event_type"] for e in t.events] == ["merge"]
    winner = next(x for x in t.tracks if x.status == "active")
    assert len(winner.absorbed) == 1 and t.find(winner.absorbed[0]).merged_into == winner.track_id


def test_split():
    t = follow(scan(0, {1: (10, 20, 10, 30)}), scan(1, {1: (10, 20, 10, 20), 2: (10, 20, 20, 30)}))
    assert len(t.tracks) == 2 and [e["event_type"] for e in t.events] == ["split"]
    assert t.tracks[1].split_from == 1 and t.tracks[0].children == [2] and t.tracks[1].identity.context == "split_child"


def test_another_site_starts_anew():
    t = follow(scan(0, {1: (10, 20, 10, 20)}), scan(1, {1: (10, 20, 10, 20), 2: (50, 60, 50, 60)}, site="KABR"))
    assert [x.track_id for x in t.tracks] == [1, 2] and all(len(x.positions) == 1 for x in t.tracks)


def test_poor_scans_lower_confidence():
    good, poor = (follow(scan(0, {1: (10, 20, 10, 20)}, quality=q)).tracks[0].confidence for q in (1.0, 0.5))
    assert (good, poor) == (0.8, 0.62)


def test_focus_is_kept_unless_another_leads_clearly():
    two = {1: (10, 20, 10, 20), 2: (100, 110, 100, 110)}
    near = [obj(1, peak=50.0), obj(2, lat=36.5, peak=48.0)]
    t = follow(scan(0, two, objects=near), scan(1, two, objects=[obj(2, lat=36.5, peak=52.0), obj(1, peak=50.0)]))
    assert next(x for x in t.tracks if x.is_focus).track_id == 1
    t.advance(scan(2, two, objects=[obj(2, lat=36.5, peak=70.0, area=2000.0), obj(1, peak=30.0)]))
    winner = next(x for x in t.tracks if x.is_focus)
    assert winner.track_id == 2 and winner.focus.switches == 1 and winner.focus.runner_up == 1


def test_events_are_normalised():
    assert tracker.event("merge", T0, 3, [3, 4, 4, 5])["involved_track_ids"] == [3, 4, 5]
    assert tracker.event("split", T0, 3, [3]) is None


def test_stability():
    of = lambda *h: [{"heading_deg": x, "heading_label": "N", "source": "s"} for x in h]
    assert [tracker.stability(of(*h))[0] for h in ((10.0,), (10.0, 20.0, 30.0), (0.0, 60.0), (0.0, 170.0, 10.0), (0.0, 100.0))] == ["insufficient", "stable", "coherent_turn", "unstable", "mixed"]
    assert tracker.heading_sequence(of(10.4)) == ["N@10:s"]


def elsewhere(n: int) -> tracker.Scan:
    """A storm of another shape and far from the one before."""
    return scan(n, {1: (300, 302, 200, 400) if n % 2 else (10 + 20 * n, 20 + 20 * n, 10, 20)}, objects=[obj(1, lat=30.0 + n)])


def test_gone_tracks_leave_the_fold():
    """A storm elsewhere in every scan: the state and a scan's row hold the tracks of the last three scans only."""
    t, rows = tracker.Tracker(), []
    for n in range(12):
        t.advance(elsewhere(n))
        rows.append(tracker.tracked_row(t, t.last))
    assert max(len(r["tracks"]) for r in rows) == 3 and [r["n_tracks"] for r in rows] == list(range(1, 13))
    assert [x["status"] for x in rows[-1]["tracks"]] == ["lost", "active", "active"]


def test_all_tracks_gives_the_gone_ones_to_later_scans(spark):
    t, rows = tracker.Tracker(), []
    for n in range(6):
        t.advance(elsewhere(n))
        rows.append(tracker.tracked_row(t, t.last))
    found = tracker.all_tracks(spark.createDataFrame(rows, tracker.TRACKED), "t.track_id", "t.status", "t.missed_scans")
    want = [(n, k, "lost" if n - k > 1 else "active", min(n - k, 1) + (n - k > 1)) for n in range(6) for k in range(n + 1)]
    assert sorted((r.scan_id, r.track_id - 1, r.status, r.missed_scans) for r in found.collect()) == want
    totals = replay.lineage_totals(spark.createDataFrame(rows, tracker.TRACKED)).first()
    assert (totals.lost_tracks_total, totals.merged_tracks_total, totals.split_children_total) == (4, 0, 0)


@pytest.fixture(scope="module")
def done(scenes):
    grids = {1: grid((85, 95, 195, 205, 45)), 2: grid((86, 96, 196, 206, 45)), 3: grid((86, 96, 196, 206, 45), (200, 210, 300, 310, 55)), 4: grid(fill=np.nan, shape=(360, 500))}
    grids[4][0, 0] = 5.0
    v = grid((80, 90, 195, 205, -20), (90, 100, 195, 205, 20))
    return ingest(scenes.scans([1, 2, 3, 4]), scenes.gates(grids), *scenes.volume({(k, 0): v for k in (1, 2, 3)}))


def test_batch_pipeline(done):
    rows = replay.diagnostics(done).orderBy("scan_id").collect()
    assert [(r.object_count, r.active_count, r.new_tracks) for r in rows] == [(1, 1, 1), (1, 1, 0), (2, 2, 1), (0, 2, 0)]
    assert rows[0].summary.startswith("Oklahoma City: 1 rain object detected. Strongest: heavy rain, 63 miles E of the radar, stationary. New strong rotation detected.")
    assert "2 rain objects" in rows[2].summary and rows[3].summary == "Oklahoma City: No significant precipitation detected."
    assert "site" not in replay.snapshot_line(rows[0].asDict(True)) and "focus_track=1" in replay.snapshot_line(rows[0].asDict(True))


def test_stream_is_the_batch(spark, done, scenes, tmp_path):
    rows = tracker.scan_rows(done.scans, done.gates, done.objects, done.object_gates, done.quality)
    source = str(tmp_path / "rows")
    rows.orderBy("scan_ts").coalesce(1).write.parquet(source)
    stream = tracker.track_stream(spark.readStream.schema(rows.schema).parquet(source))
    q = stream.writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
        first = spark.table("tracked").count()
        rows.orderBy("scan_ts").limit(1).write.mode("append").parquet(source)  # comes once more, too late
        q.processAllAvailable()
    finally:
        q.stop()
    late = spark.table("tracked").filter("exists(events, e -> e.event_type = 'late_scan')")
    assert (spark.table("tracked").count(), late.count(), late.selectExpr("sum(size(tracks))").first()[0]) == (first + 1, 1, 0)
    key = ["scan_id", "tracks.track_id", "tracks.status", "tracks.identity_confidence", "tracks.motion.heading_label"]
    assert sorted(map(str, spark.table("tracked").filter("NOT exists(events, e -> e.event_type = 'late_scan')").select(key).collect())) == sorted(map(str, done.tracked.select(key).collect()))


def test_api(done):
    assert api.get_objects(done, "ktlx").first().object_count == 0
    assert api.get_tracks(done, "KTLX").first().active_count == 2
    assert api.get_motion(done, "KTLX", 2).first().peak_dbz == 55.0
    with pytest.raises(api.NotFound):
        api.get_motion(done, "KTLX", 99)
    assert api.get_scan(done, "KTLX").first().elevation_angles == [0.5, 1.5, 2.4]
    assert api.as_json(api.get_velocity(done, "KTLX")).count() == 1
    assert api.get_summary(done, "KTLX").first().text.endswith("No significant precipitation detected.")


def test_benchmarks(spark, done, scenes):
    entries = spark.createDataFrame([("a", "dense", "KTLX", "2026-04-08", 9, True, None), ("b|2", "quick", "KTLX", None, 2, True, "3")], "id string, category string, site_id string, date string, scans int, local_only boolean, end_filename string")
    sweeps, gates = scenes.volume({(1, 0): grid((1, 2, 1, 2, 3.0))})
    results, shots = replay.run_benchmarks(entries, done.scans, done.gates, sweeps, gates)
    rows = {r.benchmark_id: r.asDict() for r in results.collect()}
    assert (rows["a"]["scan_count"], rows["a"]["mean_objects"], rows["a"]["total_new_tracks_after_first_scan"]) == (4, 1.0, 1)
    assert (rows["b|2"]["scan_count"], rows["b|2"]["mean_objects"], rows["b|2"]["fragmentation_proxy"]) == (2, 1.5, 0.333)
    text = replay.render_markdown(rows.values(), [s.asDict(True) for s in shots.collect()])
    assert "### a" in text and "- scans: `4`" in text and text.count("focus_track=") == 6


def test_matching_relationally(spark):
    rng = np.random.default_rng(1)
    rows = [(p, t, o, float(rng.integers(1, 90)) / 10) for p in (1, 2) for t in range(4) for o in range(4) if rng.random() < 0.8]
    scores = spark.createDataFrame(rows, "pair_id long, track_id int, object_id int, total_cost double")
    found = A.match_tracks(scores).collect()
    for p in (1, 2):
        cost = np.full((4, 4), 10.0)
        for q, t, o, c in rows:
            if q == p:
                cost[t, o] = c
        best = min(sum(cost[t, o] for t, o in enumerate(x)) for x in itertools.permutations(range(4)))
        mine = [r for r in found if r.pair_id == p]
        assert abs(sum(r.total_cost for r in mine) + 10.0 * (4 - len(mine)) - best) < 1e-9
    merges = A.merge_candidates(scores, A.match_tracks(scores)).collect()
    won = {(r.pair_id, r.object_id): r.track_id for r in found}
    assert all(r.track_ids[0] == won[r.pair_id, r.object_id] and len(set(r.track_ids)) == len(r.track_ids) > 1 for r in merges)
    margins = A.ambiguity_margins(scores).collect()
    for r in margins:
        leads = [sorted(c for q, t, o, c in rows if q == r.pair_id and (o == r.object_id if k else t == r.track_id)) for k in (0, 1)]
        leads = [x[1] - x[0] for x in leads if len(x) > 1]
        assert r.margin == (round(min(leads), 2) if leads else None)


def test_matches_are_proven(spark):
    """Pairs of unlike sides; costs above 10, which are worse than none, change what is best elsewhere in their pair."""
    rng = np.random.default_rng(2)
    rows = [(p, t, o, float(rng.integers(1, 140)) / 10) for p, (n, m) in enumerate([(3, 5), (5, 3), (4, 4), (1, 1)]) for t in range(n) for o in range(m) if rng.random() < 0.7 or t == o == 0]
    rows += [(9, 0, 0, 1.0), (9, 0, 1, 6.0), (9, 1, 0, 6.0), (9, 1, 1, 12.0)]
    scores = spark.createDataFrame(rows, "pair_id long, track_id int, object_id int, total_cost double")
    priced = A.priced_matches(scores)
    proofs = {r.pair_id: r for r in A.match_proofs(scores, priced).collect()}
    assert set(proofs) == {r[0] for r in rows}
    for p, proof in proofs.items():
        tracks, objects = (sorted({r[k] for r in rows if r[0] == p}) for k in (1, 2))
        cost = {(t, o): c for q, t, o, c in rows if q == p}
        few, many = sorted([tracks, objects], key=len)
        ways = [list(zip(few, x, strict=True)) for x in itertools.permutations(many, len(few))]
        best = min(sum(cost.get(x if few is tracks else x[::-1], 10.0) for x in way) for way in ways)
        assert abs(proof.bound - best) < 1e-9 and proof.slack > -1e-9 and proof.room > -1e-9
        if all(c < 10 for c in cost.values()) or p == 9:
            assert abs(proof.cost - best) < 1e-9
    assert {(r.track_id, r.object_id) for r in A.match_tracks(scores).filter("pair_id = 9").collect()} == {(0, 1), (1, 0)}
    assert A.match_proofs(scores.limit(0), A.priced_matches(scores.limit(0))).count() == 0
    wrong = priced.withColumn("price", F.col("price") + F.when(F.col("track_id") == 0, 0.5).otherwise(0.0))
    assert all(min(r.slack, r.room) < 0 for r in A.match_proofs(scores, wrong).collect())


def test_equal_matchings(spark):
    """Of several cheapest matchings, the one that whole numbers give, not one that the doubles' last bits prefer."""
    cost = [[0.6, 0.5, 0.4], [0.2, 0.3, 0.1], [0.1, 0.1, 0.2]]
    scores = spark.createDataFrame([(1, t, o, c) for t, row in enumerate(cost) for o, c in enumerate(row)], "pair_id long, track_id int, object_id int, total_cost double")
    assert sorted((r.track_id, r.object_id) for r in A.match_tracks(scores).collect()) == [(0, 2), (1, 0), (2, 1)]


def test_costs_next_to_a_tie(spark):
    """30.481250000000003 times 10,000 is a tie in doubles, which goes to the even neighbour as in SQL."""
    one = spark.range(1).select(F.lit(30.481250000000003).alias("x"))
    assert one.select(scalar.round_even(F.col("x"), 4).alias("r")).first().r == 30.4812


def test_catalog(spark, tmp_path):
    names = ["KTLX20260410_170556_V06", "KTLX20260410_171000_V06", "KTLX20260410_171000_V06_MDM", "KTLX20260409_235900_V06", "odd"]
    files = spark.createDataFrame([("KTLX", n) for n in names], "site_id string, filename string")
    assert catalog.scans_of_day(files, "KTLX", "2026-04-10").count() == 2
    assert [r.filename for r in catalog.latest_scans(files.filter("filename LIKE '%20260409%'"), "KTLX", "2026-04-10").collect()] == [names[3]]
    assert catalog.fetch_scan(files, "KTLX", "2026-04-10 17:07:00") == names[0] and catalog.fetch_scan(files, "KTLX", today="2026-04-10") == names[1]
    with pytest.raises(RuntimeError):
        catalog.fetch_scan(files, "KTLX", "2026-04-12 00:00:00")
    asked = spark.createDataFrame([(1, "KTLX", 2, "absent")], "request_id int, site_id string, n int, end_filename string")
    with pytest.raises(RuntimeError):
        catalog.require_end(catalog.scan_windows(files, asked), 1)
    (tmp_path / "KTLX").mkdir()
    (tmp_path / "KTLX" / names[0]).write_bytes(b"x")
    assert [(r.site_id, r.filename) for r in catalog.read_listing(spark, str(tmp_path)).collect()] == [("KTLX", names[0])]


def test_sites_and_manifest(spark, tmp_path):
    ranked = sites.rank_sites(spark.createDataFrame([(35.0, -97.0)], "lat double, lon double")).collect()
    assert ranked[0].site_id == "KTLX" and [r.site_rank for r in ranked] == list(range(1, len(ranked) + 1)) and all(r.beam_height_m <= 10_000 for r in ranked)
    assert len({r[0] for r in sites.site_rows()}) == 155
    (tmp_path / "m.json").write_text('[{"id": "a", "category": "c", "site_id": "ktlx"}]')
    row = manifest.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (row.site_id, row.scans, row.local_only) == ("KTLX", 5, False)
    manifest.write_json(manifest.read_manifest(spark, str(tmp_path / "m.json")), str(tmp_path / "out"))
    known = spark.createDataFrame([("Norman", "OK", 35.2, -97.4)], "city string, state string, lat double, lon double")
    assert sites.places(spark.createDataFrame([("Norman", "OK")], "city string, state string"), known).first().lat == 35.2
    assert replay.arguments(["KTLX", "--quick"]).quick


def test_buffer(spark):
    rows = [(k, "A", T0 + timedelta(minutes=m)) for k, m in enumerate((0, 60, 120, 121, 300))] + [(9, "B", T0)]
    scans = spark.createDataFrame(rows, "scan_id long, site_id string, scan_ts timestamp")
    got = {r.scan_id: (r.scan_count, r.previous_id) for r in buffer.retained(scans).collect()}
    assert got == {0: (1, None), 1: (2, 0), 2: (3, 1), 3: (3, 2), 4: (1, 3), 9: (1, None)}
    assert sorted(r.scan_id for r in buffer.held_scans(scans).collect()) == [4, 9]


def test_buffer_stream_is_the_batch(spark, tmp_path):
    """Scans of three sites in shuffled order over several files and a restart, equal times and a repeated scan among them."""
    rng = np.random.default_rng(3)
    minutes = sorted(rng.integers(0, 600, 90).tolist())
    rows = [(k, "ABC"[int(rng.integers(3))], T0 + timedelta(minutes=m)) for k, m in enumerate(minutes)]
    rows += [rows[5], (90, rows[7][1], rows[7][2])]
    rows.sort(key=lambda r: (r[2] - T0) // timedelta(minutes=60) + rng.random() / 2)
    schema = "scan_id long, site_id string, scan_ts timestamp"
    source, check = str(tmp_path / "scans"), str(tmp_path / "check")

    def arrive(batch: list[tuple]) -> None:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = buffer.buffer_stream(spark.readStream.schema(schema).parquet(source), late="90 minutes")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for batch in (rows[:31], rows[31:64], rows[64:], [(900, "A", T0 + timedelta(days=2))], [(901, "B", T0), (902, "A", T0 + timedelta(days=4))]):
            arrive(batch)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.parquet(str(tmp_path / "out"))
    columns = ["site_id", "scan_id", "scan_ts", "scan_count", "previous_id", "first_ts", "last_ts"]
    want = buffer.retained(spark.createDataFrame([*rows, (900, "A", T0 + timedelta(days=2))], schema)).select(columns)
    assert sorted(map(str, out.filter("NOT late").select(columns).collect())) == sorted(map(str, want.collect()))
    assert [(r.site_id, r.scan_id, r.scan_count) for r in out.filter("late").collect()] == [("B", 901, None)]


def test_rotation_phrases(spark):
    entry = lambda *s: [(T0, x, 30.0 if x else None) for x in s]
    cases = [("strong", entry("strong"), " New strong rotation detected."), ("weak", entry("weak", "weak", "weak"), " Persistent weak rotation."), ("weak", entry(None, "weak", "weak"), " Weak rotation detected."), (None, entry("weak", None), " Rotation weakening."), (None, entry(None, None), ""), ("strong", None, " Strong rotation detected."), (None, None, "")]
    df = spark.createDataFrame([(s, h, w) for s, h, w in cases], "s string, h array<struct<ts:timestamp,strength:string,max_shear_ms:double>>, w string")
    assert all(r.got == r.w for r in df.select("w", summary.rotation_phrase(F.col("s"), F.col("h")).alias("got")).collect())


assert Scenes
