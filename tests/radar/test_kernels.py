from __future__ import annotations

import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormloom.functions import grid as G
from stormloom.functions import motion as M
from stormloom.operators import motion as table_motion


def flood(cells: set, steps: list) -> dict:
    label: dict = {}
    for start in sorted(cells):
        if start in label:
            continue
        todo = [start]
        while todo:
            at = todo.pop()
            if at in cells and at not in label:
                label[at] = start
                todo += [(at[0] + a, at[1] + b) for a, b in steps]
    return label


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_components(seed, diagonal):
    rng = np.random.default_rng(seed)
    r, c = np.nonzero(rng.random((20, 25)) < 0.45)
    order = rng.permutation(len(r))
    r, c = r[order], c[order]
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    want = flood(set(zip(r.tolist(), c.tolist(), strict=True)), near)
    got = G.components(r, c, G.EIGHT if diagonal else G.FOUR)
    assert all((r[g], c[g]) == want[int(x), int(y)] for x, y, g in zip(r, c, got, strict=True))
    assert len(G.components(r[:0], c[:0])) == 0


def test_phase_correlation():
    a, b = np.full((64, 64), np.nan), np.full((64, 64), np.nan)
    a[20:28, 30:38] = b[23:31, 34:42] = 45
    rows, cols, quality = G.phase_correlation(a, b, step=1)
    assert (rows, cols) == (-3, -4) and quality > 0.9
    assert G.phase_correlation(a * np.nan, b) == (0.0, 0.0, 0.0)


def test_window_and_shift():
    assert G.window(-3, 5, 9) == slice(0, 5) and G.window(7, 20, 9) == slice(7, 9) and G.window(12, 20, 9) == slice(0, 9)
    r, c = G.shifted_cells(np.array([0, 5]), np.array([0, 9]), (1.4, 0.6), (10, 10))
    assert r.tolist() == [1] and c.tolist() == [1]


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 3), (4, 4), (0, 3)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(30):
        cost = rng.integers(0, 9, shape).astype(float)
        pairs = G.assignment(cost)
        n, m = shape
        assert len(pairs) == min(shape) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        if not min(shape):
            continue
        best = min(sum(cost[r, c] for r, c in zip(range(n), p, strict=True)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[r, c] for c, r in enumerate(p)) for p in itertools.permutations(range(n), m))
        assert sum(cost[r, c] for r, c in pairs) == best
        again, u, v = G.priced_assignment(cost)
        assert again == pairs and abs(u.sum() + v.sum() - best) < 1e-9 and (cost - u[:, None] - v >= -1e-9).all()
        larger, left = (v, set(range(m)) - {c for _, c in pairs}) if n < m else (u, set(range(n)) - {r for r, _ in pairs})
        assert n == m or ((larger <= 1e-9).all() and (abs(larger[list(left)]) < 1e-9).all())


def path(*places, minutes=5):
    t = datetime(2026, 4, 8, 18)
    return [(t + timedelta(minutes=minutes * k), *p) for k, p in enumerate(places)]


def test_history_motion():
    assert M.history_motion(path((35, -97))).heading_label == "stationary"
    assert M.history_motion(path((35, -97), (36, -97), minutes=0)).reason == "zero elapsed time"
    north = M.history_motion(path(*[(35 + 0.02 * k, -97) for k in range(4)]))
    assert north.heading_label == "N" and north.score == 0.9 and abs(north.speed_kmh - 26.7) < 0.1 and north.speed_mph == 17
    assert M.history_motion(path((35, -97), (35.0001, -97))).heading_label == "nearly stationary"
    assert M.history_motion(path((35, -97), (36, -97))).reason == "speed exceeds plausibility threshold"
    back = M.history_motion(path((35, -97), (35.05, -97), (35.02, -97), (35.06, -97)))
    assert back.heading_label == "uncertain" and "inconsistent" in back.reason
    assert M.heading_flips(path((35, -97), (35.05, -97), (35.02, -97), (35.06, -97))) == 2


def test_field_and_blend():
    east = M.field_motion(M.Shift(0.0, 0.05, 0.8), 0.1)
    assert east.heading_label == "E" and east.confidence == "high"
    assert M.field_motion(M.Shift(1.0, 0.0, 0.9), 0.1).source == "suppressed" and M.field_motion(None, 1) is None
    a, b = M.Shift(0.01, 0.0, 0.8), M.Shift(0.02, 0.0, 0.7, "local_phase_correlation")
    assert M.blended(a, b).source == "blended:phase_correlation+local_phase_correlation" and 0.01 < M.blended(a, b).lat < 0.02
    assert M.blended(a, M.Shift(0.2, 0.0, 0.9)) == a and M.blended(None, b) == b and M.blended(a, None) == a


def test_reported_motion():
    north = path(*[(35 + 0.02 * k, -97) for k in range(4)])
    assert M.reported_motion(north, 0.9)[0].heading_label == "N"
    weak = M.reported_motion(north, 0.2)[0]
    assert weak.source == "suppressed" and weak.reason == "track identity too weak for publishable motion"
    assert M.reported_motion(north, 0.2, M.Shift(0.02, 0.0, 0.6), 5 / 60)[0].source == "motion_field"
    young = M.reported_motion(north, 0.6, continuity=M.Continuity(0.6, "new_track"))[0]
    assert young.reason == "track continuity too ambiguous for publishable motion"


def test_steps_of_microseconds(spark):
    """A step of a few microseconds is as long as its whole number of them says."""
    rows = [(1, 1_706_000_000_123_457, 35.0, 1), (1, 1_706_000_000_123_460, 35.0001, 2), (1, 1_706_000_001_123_459, 35.0101, 3)]
    found = table_motion.track_steps(spark.createDataFrame(rows, "track_id long, at long, lat double, position_id long").withColumns({"ts": F.timestamp_micros("at"), "lon": F.lit(-97.0)}))
    got = [r.speed_kmh for r in found.orderBy("position_id").collect()]
    assert got == pytest.approx([0.0001 * 111.32 * 3600 / 3e-6, 0.01 * 111.32 * 3600 / 0.999999], rel=1e-9)
