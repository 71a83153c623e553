"""Scan listings and the endpoints' time argument."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormloom.operators import velocity
from stormloom.operators.detection import threshold_labels
from stormloom.plans import api
from stormloom.sources import catalog

DAY = datetime(2024, 1, 15)


def name(site: str, ts: datetime, end: str = "_V06") -> str:
    return f"{site}{ts:%Y%m%d_%H%M%S}{end}"


def test_nearest_by_comparing_all(spark):
    rng = random.Random(1)
    times = [DAY + timedelta(seconds=rng.choice([0, 60, 120, 121, 3000, 86_399, 90_000])) for _ in range(12)]
    files = sorted({(s, name(s, t, e)) for s in ("KAAA", "KBBB") for t in times for e in ("_V06", "_V08", "_V06_MDM")} | {("KAAA", "KAAA_none_V06")})
    asked = [(i, rng.choice(["KAAA", "KBBB", "KCCC"]), DAY + timedelta(seconds=rng.choice([30, 60, 90, 1000, 40_000, 86_399, 90_100, 200_000]))) for i in range(40)]
    got = {r.request_id: (r.filename, r.seconds_off) for r in catalog.nearest_scans(spark.createDataFrame(asked, "request_id int, site_id string, dt timestamp"), spark.createDataFrame(files, "site_id string, filename string")).collect()}
    assert len(got) == len(asked)
    for i, site, dt in asked:
        fit = []
        for s, f in files:
            if s == site and not f.endswith("_MDM") and f != "KAAA_none_V06":
                ts = datetime.strptime(f[4:19], "%Y%m%d_%H%M%S")
                if ts.date() == dt.date():
                    fit.append((abs(int((ts - dt).total_seconds())), f))
        assert got[i] == ((min(fit)[1], min(fit)[0]) if fit else (None, None))


def test_fetch_looks_at_today(spark):
    now = datetime.now(UTC).replace(tzinfo=None)
    files = spark.createDataFrame([("KAAA", name("KAAA", now - timedelta(seconds=1))), ("KAAA", name("KAAA", now - timedelta(days=9)))], "site_id string, filename string")
    assert catalog.fetch_scan(files, "KAAA") == name("KAAA", now - timedelta(seconds=1))
    with pytest.raises(RuntimeError):
        catalog.fetch_scan(files, "KBBB")


def test_the_time_argument():
    assert api.parse_datetime(None) is None and api.parse_datetime("2024-01-15T10:00:00") == datetime(2024, 1, 15, 10)
    with pytest.raises(ValueError):
        api.parse_datetime("soon")


def test_labels_of_all_thresholds(spark):
    """Nested components by flood fill, and rows that name a gate twice."""
    rng = np.random.default_rng(4)
    grid = rng.uniform(5, 65, (12, 15))
    grid[3, 4] = np.nan
    rows = [(7, int(r), int(c), float(grid[r, c])) for r, c in np.ndindex(grid.shape)] + [(7, 0, 0, float(grid[0, 0]))]
    got = {(x.threshold, x.az_idx, x.rng_idx): (x.label, x.parent_label, x.blob) for x in threshold_labels(spark.createDataFrame(rows, "scan_id long, az_idx int, rng_idx int, dbz double")).collect()}
    want: dict[tuple, int] = {}
    for t in (20, 30, 40, 50, 60):
        for r, c in np.ndindex(grid.shape):
            if grid[r, c] >= t and (t, r, c) not in want:
                todo = [(r, c)]
                while todo:
                    i, j = todo.pop()
                    if 0 <= i < 12 and 0 <= j < 15 and grid[i, j] >= t and (t, i, j) not in want:
                        want[t, i, j] = r * 1_000_000 + c
                        todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    assert got == {(t, r, c): (label, want.get((t - 10, r, c)), want[20, r, c]) for (t, r, c), label in want.items()}


def test_shear_wraps_around_and_skips_missing_gates(spark):
    azimuths, ranges = [0.0, 1.0, 2.0, 3.0], [2000.0, 2250.0, 2500.0]
    sweeps = spark.createDataFrame([(1, 0, azimuths, ranges), (2, 0, azimuths, ranges)], "scan_id long, sweep_idx int, azimuths array<double>, ranges_m array<double>")
    gates = spark.createDataFrame([(1, 0, 0, 0, -10.0), (1, 0, 3, 2, 8.0), (1, 0, 2, 1, float("nan")), (1, 0, 1, 1, 4.0)], "scan_id long, sweep_idx int, az_idx int, rng_idx int, vel double")
    got = sorted(tuple(r) for r in velocity.shear_gates(sweeps, gates).collect())
    assert got == [(1, 0, 0, 0, 18.0, -10.0, 8.0), (1, 0, 3, 2, 18.0, -10.0, 8.0)]


def test_nearest_scans_reads_a_day_once(spark):
    """No window frame that ends with its partition: Spark reads such a frame anew for each row. Files on both sides, at the second, and none."""
    files = spark.createDataFrame([("A", f"A20240101_{t}_V06") for t in ("000000", "001000", "002000")] + [("B", "B20240102_000000_V06")], "site_id string, filename string")
    asked = spark.createDataFrame([(1, "A", "2024-01-01 00:04:00"), (2, "A", "2024-01-01 00:05:00"), (3, "A", "2024-01-01 00:20:00"), (4, "A", "2024-01-01 23:00:00"), (5, "B", "2024-01-01 00:00:00")], "request_id int, site_id string, dt string").withColumn("dt", F.col("dt").cast("timestamp"))
    found = catalog.nearest_scans(asked, files)
    assert {r.request_id: (r.filename and r.filename[10:16], r.seconds_off) for r in found.collect()} == {1: ("000000", 240), 2: ("000000", 300), 3: ("002000", 0), 4: ("002000", 81600), 5: (None, None)}
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
