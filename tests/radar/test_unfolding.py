"""Velocities back from their folds: smooth fields, exhaustive search over few regions, odd sweeps."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from stormloom.functions.grid import components
from stormloom.operators.unfolding import PARTS, touching, unfold, unfold_velocity
from stormloom.sources import schemas

NYQUIST = 10.0


def folded(v: np.ndarray) -> np.ndarray:
    return v - 2 * NYQUIST * np.rint(v / (2 * NYQUIST))


def cells(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(x.ravel() for x in np.indices(shape))


@pytest.mark.parametrize("seed", range(4))
def test_smooth_fields(seed):
    """A wind around the radar, up to twice the Nyquist velocity, with holes and noise."""
    rng = np.random.default_rng(seed)
    az, gate = cells((72, 40))
    true = 19 * np.cos(2 * np.pi * (az / 72 - rng.random())) * (0.6 + 0.4 * np.sin(gate / 15)) + rng.normal(0, 0.4, len(az))
    keep = np.flatnonzero(rng.random(len(az)) > 0.15)
    piece = components(az[keep], gate[keep])  # nothing tells what a gate without neighbours is off by
    keep = keep[piece == np.bincount(piece).argmax()]
    got = unfold(az[keep], gate[keep], folded(true[keep]), 72, NYQUIST)
    np.testing.assert_allclose(got, true[keep], atol=1e-9)


def test_exhaustive_search():
    """The folds of few regions with the smallest steps across their borders, all tried."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        az, gate = cells((4, 5))
        true = 8 + np.cumsum(rng.uniform(0, 5, 5))[gate] + rng.uniform(-1, 1, 4)[az]
        v = folded(true)
        a, b = touching(az, gate, 100)  # no way around
        part = np.clip(np.floor((v + NYQUIST) / (2 * NYQUIST / PARTS)), 0, PARTS - 1)
        label = np.arange(len(v))
        for _ in range(len(v)):
            for i, j in zip(a, b, strict=True):
                if part[i] == part[j]:
                    label[i] = label[j] = min(label[i], label[j])
        names, of = np.unique(label, return_inverse=True)
        if len(names) > 6:
            continue

        def steps(f, of=of, v=v, a=a, b=b):
            u = v + 2 * NYQUIST * np.array(f)[of]
            return ((u[a] - u[b]) ** 2).sum()

        best = min(itertools.product(range(-1, 2), repeat=len(names)), key=steps)
        got = unfold(az, gate, v, 100, NYQUIST)
        assert abs(((got[a] - got[b]) ** 2).sum() - steps(best)) < 1e-9


def test_around_the_circle():
    """Neighbours over north: the only border between two halves."""
    az, gate = np.array([0, 1, 6, 7]), np.zeros(4, np.int64)
    got = unfold(az, gate, np.array([9.0, 9.0, -9.0, -9.0]), 8, NYQUIST)
    assert (got[0], got[2]) == (got[1], got[3]) and abs(got[0] - got[3]) == 2.0


def test_gates_without_neighbours():
    """Gates with nothing but missing ones beside them are unfolded by what is across."""
    az, gate = cells((72, 40))
    true = 19 * np.cos(2 * np.pi * az / 72)
    alone = (az % 24 == 5) & (gate % 10 == 5)
    beside = np.zeros(len(az), bool)
    for da, dr in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        beside |= ((az + da) % 24 == 5) & ((gate + dr) % 10 == 5)
    keep = np.flatnonzero(~beside)
    assert (np.abs(true[alone]) > NYQUIST).any()
    np.testing.assert_allclose(unfold(az[keep], gate[keep], folded(true[keep]), 72, NYQUIST), true[keep], atol=1e-9)


def test_groups_and_odd_rows(spark):
    """Sweeps apart; null and NaN velocities; sweeps without a header or a Nyquist velocity; none."""
    heads = [(1, 0, [0.0] * 4, [0.0] * 9, 0.0, 0.0, 0.5, 10.0), (1, 1, [0.0] * 4, [0.0] * 9, 0.0, 0.0, 0.5, None), (2, 0, [], [], 0.0, 0.0, 0.5, float("nan"))]
    rows = [(s, w, 0, k, x) for s, w in ((1, 0), (1, 1), (2, 0), (9, 9)) for k, x in enumerate([7.0, 9.0, 9.5, -9.0, -8.0])]
    rows += [(1, 0, 2, 0, None), (1, 0, 2, 1, float("nan"))]
    got = unfold_velocity(spark.createDataFrame(heads, schemas.VELOCITY_SWEEPS), spark.createDataFrame(rows, schemas.VELOCITY_GATES)).collect()
    of = {(s, w): [r.vel for r in sorted(got, key=lambda r: r.rng_idx) if (r.scan_id, r.sweep_idx, r.az_idx) == (s, w, 0)] for s, w in ((1, 0), (1, 1), (2, 0), (9, 9))}
    assert of[1, 0] == [7.0, 9.0, 9.5, 11.0, 12.0]
    assert of[1, 1] == of[2, 0] == of[9, 9] == [7.0, 9.0, 9.5, -9.0, -8.0]
    assert sorted(str(r.vel) for r in got if r.az_idx == 2) == ["None", "nan"]
    assert unfold_velocity(spark.createDataFrame(heads, schemas.VELOCITY_SWEEPS), spark.createDataFrame([], schemas.VELOCITY_GATES)).count() == 0
