"""Kernels over one grid at a time, in numpy: what no relational operator expresses."""

from __future__ import annotations

import numpy as np

FOUR = [(0, 1), (1, 0)]
EIGHT = [(0, 1), (1, -1), (1, 0), (1, 1)]


def components(rows: np.ndarray, cols: np.ndarray, neighbours: list[tuple[int, int]] = FOUR) -> np.ndarray:
    """For each cell the place, among the cells given, of its component's first cell in row order.

    Cells are distinct (row, col) pairs; the grid's edges aren't joined. Every round each component takes the least
    label around it and labels are followed to their roots, so rounds are few even for winding shapes.
    """
    n = len(rows)
    if not n:
        return np.zeros(0, np.int64)
    width = int(cols.max()) + 3
    key = (rows.astype(np.int64) + 1) * width + cols + 1
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    a, b = [], []
    for dr, dc in neighbours:
        there = ordered + dr * width + dc
        at = np.minimum(np.searchsorted(ordered, there), n - 1)
        hit = np.flatnonzero(ordered[at] == there)
        a.append(hit)
        b.append(at[hit])
    i, j = np.concatenate(a), np.concatenate(b)
    root = np.arange(n)
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def phase_correlation(previous: np.ndarray, current: np.ndarray, min_dbz: float = 20.0, step: int = 4) -> tuple[float, float, float]:
    """(row shift, column shift, quality 0 to 1) between two grids, every step-th row and column of them."""

    def prepared(grid: np.ndarray) -> np.ndarray:
        grid = np.where(np.isfinite(grid) & (grid >= min_dbz), grid, 0.0)
        return grid[::step, ::step] if step > 1 else grid

    a, b = prepared(previous), prepared(current)
    if not a.any() or not b.any():
        return 0.0, 0.0, 0.0
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    size = np.abs(cross)
    surface = np.abs(np.fft.ifft2(cross / np.where(size == 0.0, 1.0, size)))
    peak = np.unravel_index(surface.argmax(), surface.shape)
    top = float(surface[peak])
    shifts = [float((int(p) - n if p > n // 2 else int(p)) * step) for p, n in zip(peak, surface.shape, strict=True)]
    quality = min(1.0, max(0.0, (top - float(surface.mean())) / top)) if top > 0 else 0.0
    return round(shifts[0], 2), round(shifts[1], 2), round(quality, 3)


def window(low: int, high: int, limit: int) -> slice:
    """low to high cut to 0 .. limit; everything if nothing is left."""
    low, high = max(0, low), min(limit, high)
    return slice(low, high) if low < high else slice(0, limit)


def shifted_cells(rows: np.ndarray, cols: np.ndarray, by: tuple[float, float], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Cells moved by a rounded shift; those that leave the grid are lost."""
    r, c = rows + round(by[0]), cols + round(by[1])
    inside = (r >= 0) & (r < shape[0]) & (c >= 0) & (c < shape[1])
    return r[inside], c[inside]


def priced_assignment(cost: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Pairs (row, column) of a matching of least total cost that uses every row or every column, and prices of rows and of
    columns that prove it: no cell costs less than its row's and column's price, matched ones cost just that, and on the
    side that isn't used up no price is above 0 and those left over have 0.

    Shortest augmenting paths with potentials, one row after another."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return [], np.zeros(cost.shape[0]), np.zeros(cost.shape[-1])
    flipped = cost.shape[0] > cost.shape[1]
    if flipped:
        cost = cost.T
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        least, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = start, -1
        while True:
            reduced = cost[row] - u[row] - v
            better = ~done & (reduced < least)
            least[better], came[better] = reduced[better], col
            step_to = int(np.where(done, np.inf, least).argmin())
            step = least[step_to]
            u[start] += step
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            done[step_to], col = True, step_to
            if row_of[col] < 0:
                break
            row = row_of[col]
        while col >= 0:
            back = came[col]
            row_of[col] = start if back < 0 else row_of[back]
            col = back
    pairs = [(int(r), c) for c, r in enumerate(row_of) if r >= 0]
    return (sorted((c, r) for r, c in pairs), v, u) if flipped else (sorted(pairs), u, v)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of priced_assignment."""
    return priced_assignment(cost)[0]
