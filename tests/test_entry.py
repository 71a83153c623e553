from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stormloom.plans import queries as radar

SF = "/root/testdata/sf0.001"
#: A query of each kind; all of them are run at another scale.
SOME = ["nearest_scans", "velocity_regions", "identity_scores", "matches", "match_proofs", "merge_candidates", "split_candidates", "lost_tracks", "motion_phrases", "api_objects_at", "api_summary", "scan_windows", "rank_sites", "labels_and_units", "scan_quality", "objects", "object_segments", "sweep_regions", "mask_overlaps", "drifting_motion", "reported_motion", "focus_choice", "replay_buffer", "benchmark_roll_up", "object_summaries"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(x: object) -> object:
    if isinstance(x, float):
        return f"{x:.5g}"
    return [same(v) for v in x] if isinstance(x, (list, tuple)) else x


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(radar.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SOME)
def test_sql_agrees(spark, con, name):
    got = radar.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({radar.oracle_sql()[name]})").fetchall()
    assert sorted(str(same(tuple(r))) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == sorted(str(same(r)) for r in want)
