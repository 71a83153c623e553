"""Unfolding of velocities that a radar can only tell within its Nyquist interval, sweep by sweep.

Neighbouring gates of about the same velocity form regions. Two regions that touch are joined by an edge that carries
how many pairs of gates touch and the sum of their steps. The heaviest edge is taken first: its average step, in whole
intervals, is what one side is off by; that side is shifted, and the two are one region from then on. Regions that don't
touch are joined in the end across the gates that are missing between them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import FOUR, components
from ..sources.schemas import VELOCITY_GATES

#: Parts of the Nyquist interval whose gates form regions.
PARTS = 3
#: Most missing gates across which two gates still tell of each other, and by how much any pair that touches outweighs all
#: pairs that don't.
GAP, NEAR = 10, 1000.0


def touching(az: np.ndarray, rng: np.ndarray, n_az: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of gates that are neighbours in range or azimuth; the last azimuth is next to the first."""
    width = int(rng.max(initial=0)) + 2
    key = az.astype(np.int64) * width + rng
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    a, b = [], []
    for there, has in ((key + 1, np.ones(len(key), bool)), (((az + 1) % max(n_az, 1)).astype(np.int64) * width + rng, np.full(len(key), n_az > 2) | (az + 1 < n_az))):
        at = np.minimum(np.searchsorted(ordered, there), len(key) - 1)
        hit = np.flatnonzero((ordered[at] == there) & has)
        a.append(hit)
        b.append(order[at[hit]])
    return np.concatenate(a), np.concatenate(b)


def facing(az: np.ndarray, rng: np.ndarray, n_az: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of gates that have nothing but missing gates between them, in range or around in azimuth."""
    a, b = [], []
    for line, along, around in ((az, rng, 0), (rng, az, n_az)):
        order = np.lexsort((along, line))
        ends = np.diff(line[order], append=-1) != 0
        starts = np.roll(ends, 1)
        pairs = [(order[~ends], order[~starts], 0)] + [(order[ends], order[starts], around)] * (around > 0)
        for first, second, turn in pairs:
            step = along[second] + turn - along[first]
            near = (step > 1) & (step <= GAP + 1)
            a.append(first[near])
            b.append(second[near])
    return np.concatenate(a), np.concatenate(b)


def folds(region: np.ndarray, value: np.ndarray, a: np.ndarray, b: np.ndarray, interval: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Whole intervals to add to each region (numbered from 0), given each gate's region and pairs of gates with whole weights.
    Regions that hang together are off by a common number, chosen so that the gates' average fold is nearest to 0."""
    n = int(region.max(initial=-1)) + 1
    gates = np.bincount(region, minlength=n)
    edges: list[dict[int, list]] = [{} for _ in range(n)]
    low, high = np.minimum(region[a], region[b]), np.maximum(region[a], region[b])
    step = np.where(region[a] < region[b], value[a] - value[b], value[b] - value[a])
    apart = low != high
    weight = np.ones(len(a)) if weight is None else weight
    pair, at = np.unique(low[apart] * n + high[apart], return_inverse=True)
    counts, sums = np.bincount(at, weight[apart], len(pair)), np.bincount(at, (step * weight)[apart], len(pair))
    for p, count, total in zip(pair.tolist(), counts.tolist(), sums.tolist(), strict=True):
        edges[p // n][p % n] = [count, total]  # the sum of (this region's value less the other's)
        edges[p % n][p // n] = [count, -total]
    heap = [(-count, p // n, p % n) for p, count in zip(pair.tolist(), counts.tolist(), strict=True)]
    heapq.heapify(heap)
    members: list[list[int] | None] = [[k] for k in range(n)]
    fold = np.zeros(n, np.int64)
    while heap:
        weight, i, j = heapq.heappop(heap)
        if members[i] is None or members[j] is None or edges[i].get(j, (0,))[0] != -weight:
            continue  # one of the two is part of another by now, or the edge has grown
        if len(edges[i]) + len(members[i]) < len(edges[j]) + len(members[j]):
            i, j = j, i
        count, total = edges[i].pop(j)
        del edges[j][i]
        by = int(np.rint(total / (count * interval)))
        fold[members[j]] += by
        members[i] += members[j]
        members[j] = None
        for k, (c, t) in edges[j].items():
            here = edges[i].setdefault(k, [0, 0.0])
            here[0] += c
            here[1] += t + by * interval * c
            edges[k].pop(j)
            edges[k][i] = [here[0], -here[1]]
            heapq.heappush(heap, (-here[0], min(i, k), max(i, k)))
        edges[j] = {}
    for m in members:
        if m:
            fold[m] -= int(np.rint((fold[m] * gates[m]).sum() / gates[m].sum()))
    return fold


def unfold(az: np.ndarray, rng: np.ndarray, value: np.ndarray, n_az: int, nyquist: float | None) -> np.ndarray:
    """The velocities of a sweep's gates without folds. Without a Nyquist velocity they stay as they are."""
    if not len(value) or nyquist is None or not nyquist > 0:
        return value
    part = np.clip(np.floor((value + nyquist) / (2 * nyquist / PARTS)), 0, PARTS - 1)
    region = np.empty(len(value), np.int64)
    for k in range(PARTS):
        mine = np.flatnonzero(part == k)
        region[mine] = mine[components(az[mine], rng[mine], FOUR)]
    region = np.unique(region, return_inverse=True)[1]
    beside, across = touching(az, rng, n_az), facing(az, rng, n_az)
    a, b = (np.concatenate(x) for x in zip(beside, across, strict=True))
    weight = np.repeat([NEAR * len(value), 1.0], [len(beside[0]), len(across[0])])
    return value + 2 * nyquist * folds(region, value, a, b, 2 * nyquist, weight)[region]


def unfold_velocity(sweeps: DataFrame, gates: DataFrame) -> DataFrame:
    """gates (VELOCITY_GATES) with unfolded velocities; sweeps: their headers. A group is a sweep. Gates without a header,
    null and NaN velocities stay as they are. No rows in: no rows out."""
    heads = sweeps.select("scan_id", "sweep_idx", F.size("azimuths").alias("n_az"), "nyquist")

    def run(rows: pa.Table) -> pa.Table:
        value = rows.column("vel").to_numpy(zero_copy_only=False).astype(float).copy()
        n_az, nyquist = rows.column("n_az")[0].as_py(), rows.column("nyquist")[0].as_py()
        some = np.flatnonzero(np.isfinite(value))
        az, rng = (rows.column(c).to_numpy().astype(np.int64)[some] for c in ("az_idx", "rng_idx"))
        if n_az is not None:
            value[some] = unfold(az, rng, value[some], n_az, nyquist)
        out = rows.select(["scan_id", "sweep_idx", "az_idx", "rng_idx"])
        return out.append_column("vel", pa.array(value, mask=rows.column("vel").is_null().to_numpy(zero_copy_only=False)))

    joined = gates.select("scan_id", "sweep_idx", "az_idx", "rng_idx", "vel").join(heads, ["scan_id", "sweep_idx"], "left")
    return joined.groupBy("scan_id", "sweep_idx").applyInArrow(run, VELOCITY_GATES)
