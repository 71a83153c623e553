from __future__ import annotations

import numpy as np
import pytest

from stormloom.operators import detection as D
from stormloom.operators import quality as Q
from stormloom.operators import velocity as V

from .conftest import AZ, RNG, grid

NEAR = [float(x) for x in np.linspace(2000, 50000, 500)]
MID = [float(x) for x in np.linspace(2000, 120000, 500)]
CORES = [(80, 110, 190, 230, 25), (85, 100, 195, 208, 40), (85, 100, 212, 225, 40), (88, 96, 198, 204, 55), (88, 96, 216, 222, 55)]
SCENES = {
    "empty": (grid(fill=10), RNG, 0), "one": (grid((85, 95, 195, 205, 45)), RNG, 1), "two": (grid((10, 20, 50, 60, 35), (200, 210, 300, 310, 55)), RNG, 2),
    "nested": (grid((80, 100, 190, 210, 25), (85, 95, 195, 205, 35), (88, 92, 198, 202, 48)), RNG, 1), "tiny": (grid((90, 92, 100, 102, 40)), NEAR, 0), "weak": (grid((90, 95, 100, 105, 35)), MID, 0),
    "intense": (grid((90, 97, 100, 107, 50)), MID, 1), "cores": (grid(*CORES), RNG, 2), "core": (grid((80, 110, 190, 230, 25), (85, 105, 198, 222, 40), (90, 100, 204, 216, 55)), RNG, 1),
}


@pytest.fixture(scope="module")
def found(scenes):
    scans = scenes.scans([0], axes=(AZ, SCENES["empty"][1]))
    for k, (_, ranges, _) in enumerate(list(SCENES.values())[1:], 1):
        scans = scans.unionByName(scenes.scans([k], axes=(AZ, ranges)))
    result = D.detect_objects(scans, scenes.gates({k: np.where(g >= 20, g, np.nan) for k, (g, _, _) in enumerate(SCENES.values())}))
    rows = result.objects.orderBy("scan_id", "rank").collect()
    return result, {name: [r for r in rows if r.scan_id == k] for k, name in enumerate(SCENES)}


@pytest.mark.parametrize("name", SCENES)
def test_scene(found, name):
    assert len(found[1][name]) == SCENES[name][2]


def test_measures(found):
    (one,) = found[1]["one"]
    assert (one.peak_dbz, one.peak_label, one.pixel_count, one.bearing_deg) == (45.0, "heavy rain", 100, 89.5)
    assert [x.label for x in found[1]["nested"][0].layers] == ["light rain", "moderate rain", "heavy rain"]
    assert found[1]["intense"][0].peak_label == "intense rain"
    assert [r.peak_dbz for r in found[1]["two"]] == [55.0, 35.0]


def test_split_shares_all_gates(found):
    result, rows = found
    k = list(SCENES).index("cores")
    gates = result.object_gates.filter(f"scan_id = {k}").collect()
    assert len(gates) == 30 * 40 == sum(r.pixel_count for r in rows["cores"])
    assert len({(g.az_idx, g.rng_idx) for g in gates}) == len(gates)
    tree = result.hierarchy.filter(f"scan_id = {k}").collect()
    assert sorted(t.threshold for t in tree) == [20, 30, 30, 40, 40, 50, 50] and sum(t.parent_node_id is None for t in tree) == 1
    path = D.segmented(result.objects, result.hierarchy).filter(f"scan_id = {k}").first().threshold_path
    assert path == [20, 30, 40, 50]


def test_quality(scenes):
    weak, strong, missing, clear = grid(shape=(32, 32)), grid(shape=(32, 32)), grid((0, 4, 0, 4, 25), shape=(32, 32)), grid(shape=(32, 32), fill=5)
    weak[10, 10], strong[10, 10] = 28, 45
    axes = ([float(x) for x in range(32)], [1000.0 * x for x in range(32)])
    scans, gates = scenes.scans([1, 2, 3, 4], axes=axes), scenes.gates({1: weak, 2: strong, 3: missing, 4: clear})
    speckle = Q.speckle_gates(gates)
    assert [(r.scan_id, r.az_idx, r.rng_idx) for r in speckle.collect()] == [(1, 10, 10)]
    assert Q.remove_speckle(gates, speckle).filter("scan_id = 1").count() == 0
    rows = {r.scan_id: r for r in Q.scan_quality(scans, gates, speckle).collect()}
    assert rows[1].flags == ["high_missing_fraction", "speckle_filtered", "no_object_scale_echo"] and rows[1].removed_speckle_pixels == 1
    assert rows[3].flags == ["high_missing_fraction"] and rows[3].score < 0.8
    assert rows[4].score == 1.0 and rows[4].flags == ["no_object_scale_echo"]


def test_wind_regions(scenes):
    a, b = grid((50, 70, 100, 130, -20)), grid((50, 70, 100, 130, -22), (100, 120, 200, 230, 25))
    slow = grid((50, 70, 100, 130, -5), (200, 201, 5, 6, -20))
    sweeps, gates = scenes.volume({(1, 0): a, (1, 1): b, (2, 0): slow})
    rows = V.velocity_regions(sweeps, gates).orderBy("region_id").collect()
    assert [(r.scan_id, r.region_type, r.peak_velocity_ms, r.mean_velocity_ms, r.sweep_count, r.elevation_angles) for r in rows] == [(1, "inbound", -22.0, -21.0, 2, [0.5, 1.5]), (1, "outbound", 25.0, 25.0, 1, [1.5])]


@pytest.mark.parametrize("v,strength", [(5, None), (10, "weak"), (15, "moderate"), (20, "strong")])
def test_rotation(scenes, v, strength):
    g = grid((50, 60, 150, 160, -v), (60, 70, 150, 160, v))
    sweeps, gates = scenes.volume({(1, 0): g, (1, 1): g})
    rows = V.rotation_signatures(sweeps, gates).collect()
    assert [(r.strength, r.max_shear_ms, r.sweep_count) for r in rows] == ([] if strength is None else [(strength, 2.0 * v, 2)])


def test_shear_is_that_of_a_dense_grid(scenes):
    rng = np.random.default_rng(0)
    g = np.where(rng.random((12, 9)) < 0.8, rng.normal(0, 12, (12, 9)), np.nan)
    axes = ([float(x) for x in range(12)], [1000.0 + 250 * x for x in range(9)])
    sweeps, gates = scenes.volume({(1, 0): g}, axes=axes)
    got = {(r.az_idx, r.rng_idx): (r.shear, r.inbound, r.outbound) for r in V.shear_gates(sweeps, gates).collect()}
    want = {}
    for r in range(12):
        for c in range(9):
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    a, b = g[r, c], g[(r - dr) % 12, (c - dc) % 9]
                    if (dr or dc) and np.isfinite(a) and np.isfinite(b) and (a < 0) != (b < 0) and abs(a - b) >= max(15, np.nextafter(want.get((r, c), (0,))[0], 99) if (r, c) in want else 15):
                        want[r, c] = (abs(a - b), min(a, b), max(a, b))
    assert got == want


def test_objects_without_wind(scenes, found):
    sweeps, gates = scenes.volume({(99, 0): grid((1, 2, 1, 2, 3.0))})
    rows = V.analyze_velocity(sweeps, gates, found[0].objects).objects.collect()
    assert len(rows) == sum(n for _, _, n in SCENES.values()) and all(r.max_inbound_ms is None and r.rotation is None for r in rows)
