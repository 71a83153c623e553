"""Scenes on a 360 x 500 grid, as tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from stormloom.sources import schemas

AZ = [float(x) for x in np.linspace(0, 359, 360)]
RNG = [float(x) for x in np.linspace(2000, 250000, 500)]
RADAR = (35.0, -97.0)
T0 = datetime(2026, 4, 8, 18, 0)


def grid(*blobs: tuple[int, int, int, int, float], shape: tuple[int, int] = (360, 500), fill: float = np.nan) -> np.ndarray:
    out = np.full(shape, fill)
    for r0, r1, c0, c1, v in blobs:
        out[r0:r1, c0:c1] = v
    return out


class Scenes:
    def __init__(self, spark):
        self.spark = spark

    def scans(self, ids, axes=(AZ, RNG), site="KTLX", minutes=5):
        sites = site if isinstance(site, list) else [site] * len(ids)
        rows = [(k, s, T0 + timedelta(minutes=minutes * i), *axes, *RADAR, 0.5, [0.5, 1.5, 2.4]) for i, (k, s) in enumerate(zip(ids, sites, strict=True))]
        return self.spark.createDataFrame(rows, schemas.SCANS)

    def gates(self, grids: dict[int, np.ndarray]):
        rows = [(k, int(r), int(c), float(g[r, c])) for k, g in grids.items() for r, c in zip(*np.nonzero(np.isfinite(g)), strict=True)]
        return self.spark.createDataFrame(rows, schemas.GATES)

    def volume(self, sweeps: dict[tuple[int, int], np.ndarray], axes=(AZ, [float(x) for x in np.linspace(2000, 230000, 500)])):
        heads = [(k, s, *axes, *RADAR, 0.5 + s, 26.2) for k, s in sweeps]
        rows = [(k, s, int(r), int(c), float(g[r, c])) for (k, s), g in sweeps.items() for r, c in zip(*np.nonzero(np.isfinite(g)), strict=True)]
        return self.spark.createDataFrame(heads, schemas.VELOCITY_SWEEPS), self.spark.createDataFrame(rows, schemas.VELOCITY_GATES)


@pytest.fixture(scope="session")
def scenes(spark):
    return Scenes(spark)
