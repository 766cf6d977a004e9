"""Graphs over cells by tiles, against peeling cell by cell and against a walk over whole arrays."""

import numpy as np
import pytest
from test_raster import STEPS

from thalweg.plans.graphs import graph_carried
from thalweg.plans.loops import peeled
from thalweg.spec import GridSpec


def graph(seed, rows, cols, back=0.0):
    """Edges from each cell to some of its lower neighbours, and, of a share ``back``, to higher ones, which makes cycles."""
    rng = np.random.default_rng(seed)
    z = rng.permutation(rows * cols).reshape(rows, cols)
    edges = []
    for r, c in np.ndindex(rows, cols):
        for dr, dc in STEPS:
            p, q = r + dr, c + dc
            if 0 <= p < rows and 0 <= q < cols and rng.random() < (0.6 if z[p, q] < z[r, c] else back):
                edges.append((r * cols + c, p * cols + q, float(rng.choice([0.0, 0.25, 0.5]))))
    amounts = [(i, float(rng.integers(0, 9))) for i in range(rows * cols)]
    return z.ravel(), amounts, edges


def frames(spark, amounts, edges):
    return spark.createDataFrame(amounts, "id long, s double"), spark.createDataFrame(edges, "src long, dst long, m double")


@pytest.mark.parametrize("greatest", [False, True])
@pytest.mark.parametrize("side", [3, 64])
def test_graphs_by_tiles(spark, side, greatest):
    z, amounts, edges = graph(side, 10, 13)
    want = dict(amounts)
    for src, dst, m in sorted(edges, key=lambda e: -z[e[0]]):
        want[dst] = max(want[dst], want[src] + m) if greatest else want[dst] + want[src] * m
    got = {r["id"]: r["s"] for r in graph_carried(*frames(spark, amounts, edges), GridSpec(10, 13), greatest, side).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("greatest", [False, True])
@pytest.mark.parametrize("back", [0.02])
def test_cells_on_cycles_and_below_keep_what_reached_them(spark, back, greatest):
    _, amounts, edges = graph(7, 10, 13, back)
    frame = frames(spark, amounts, edges)
    want = {r["id"]: r["s"] for r in peeled(*frame, greatest).collect()}
    got = {r["id"]: r["s"] for r in graph_carried(*frame, GridSpec(10, 13), greatest, 5).collect()}
    assert got == pytest.approx(want)


def test_nothing_to_carry(spark):
    frame = frames(spark, [], [])
    assert graph_carried(*frame, GridSpec(5, 5)).count() == 0
    alone = frames(spark, [(3, 2.0), (8, 1.0)], [])
    assert sorted(map(tuple, graph_carried(*alone, GridSpec(5, 5), side=2).collect())) == [(3, 2.0), (8, 1.0)]
