"""Conditioning across tiles and blocks of tiles, against floods and walks over whole arrays."""

import heapq

import numpy as np
import pytest
from test_raster import STEPS, array, cells

from thalweg.operators import condition
from thalweg.plans import tiles
from thalweg.plans.tiles import fewest_steps, least_greatest


def around(r, c, shape, steps=STEPS):
    return [(r + dr, c + dc) for dr, dc in steps if 0 <= r + dr < shape[0] and 0 <= c + dc < shape[1]]


def flooded(z):
    """The priority flood from the first and last cells with data of rows and columns."""
    ok, level, heap = ~np.isnan(z), np.full(z.shape, np.nan), []
    for lines, turn in ((ok, False), (ok.T, True)):
        for i, line in enumerate(lines):
            for j in np.flatnonzero(line)[[0, -1]] if line.any() else ():
                r, c = (int(j), i) if turn else (i, int(j))
                heap.append((z[r, c], r, c))
    heapq.heapify(heap)
    while heap:
        w, r, c = heapq.heappop(heap)
        if np.isnan(level[r, c]):
            level[r, c] = w
            for p, q in around(r, c, z.shape):
                if ok[p, q] and np.isnan(level[p, q]):
                    heapq.heappush(heap, (max(w, z[p, q]), p, q))
    return np.where(np.isnan(level), z, level)


@pytest.mark.parametrize("shape", [(37, 23), (3, 40), (1, 9), (64, 64)])
def test_fill_depressions_across_tiles(spark, monkeypatch, shape):
    monkeypatch.setattr(tiles, "TILE", 4)
    rng = np.random.default_rng(shape[0])
    z = rng.integers(0, 30, shape).astype(float)
    z[rng.random(shape) < 0.15] = np.nan
    df, spec = cells(spark, z)
    got = condition.fill_depressions(df, spec)
    assert got.count() == z.size
    assert np.array_equal(array(got, "z", shape), flooded(z), equal_nan=True)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_across_tiles(spark, monkeypatch, connectivity):
    monkeypatch.setattr(tiles, "TILE", 4)
    v = np.random.default_rng(connectivity).integers(0, 2, (35, 22))
    df, spec = cells(spark, v)
    got = {r["id"]: r["label"] for r in condition.connected_labels(df, spec, "z", connectivity).collect()}
    want, steps = {}, STEPS if connectivity == 8 else STEPS[::2]
    for start in np.ndindex(v.shape):
        label, todo = start[0] * 22 + start[1], [start]
        while todo:
            r, c = todo.pop()
            if r * 22 + c not in want:
                want[r * 22 + c] = label
                todo += [x for x in around(r, c, v.shape, steps) if v[x] == v[r, c]]
    assert got == want


def test_steps_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 4)
    rng = np.random.default_rng(2)
    v, enter, s = rng.integers(0, 2, (21, 30)), rng.random((21, 30)) < 0.9, np.where(rng.random((21, 30)) < 0.02, 1.0, np.inf)
    rows = [(r, c, float(v[r, c]), bool(enter[r, c]), float(s[r, c]) if s[r, c] < 9 else None) for r, c in np.ndindex(v.shape)]
    _, spec = cells(spark, v)
    got = fewest_steps(spark.createDataFrame(rows, "row long, col int, v double, enter boolean, s double"), spec)
    n, todo = s.copy(), [(1.0, r, c) for r, c in zip(*np.nonzero(s < 9))]
    while todo:
        d, r, c = heapq.heappop(todo)
        for x in around(r, c, v.shape):
            if v[x] == v[r, c] and enter[x] and d + 1 < n[x]:
                n[x] = d + 1
                heapq.heappush(todo, (d + 1, *x))
    assert {r["id"]: r["n"] for r in got.collect()} == {r * 30 + c: n[r, c] for r, c in np.ndindex(v.shape) if n[r, c] < np.inf}


def test_nothing_to_solve(spark):
    none = spark.createDataFrame([], "row long, col int, v double, enter boolean, s double")
    _, spec = cells(spark, np.zeros((300, 2)))
    assert least_greatest(none, spec).count() == 0 and fewest_steps(none, spec).count() == 0
