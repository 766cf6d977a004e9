"""Paths over the cells of a grid, solved inside tiles first.

Tiles share the lines of cells between them, so each pair of neighbours lies within one tile. ``least_greatest`` contracts a tile to
what its shared lines need to know, then blocks of tiles, until one block is the whole grid, and then goes back down: about twice
log4(tiles across) rounds. A block's task holds a number of edges as large as its tiles' outlines, so the last one grows with the
square root of the number of cells. ``fewest_steps`` sends on what changed on shared lines: as many rounds as a path crosses tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions.geometry import STEPS, cell_id
from thalweg.plans.loops import pinned
from thalweg.spec import GridSpec

TILE = 128
#: Tiles (and blocks) along the side of the next larger block.
FANOUT = 4
#: The node that stands for all sources.
SOURCE = -1
KEYS = ["__tr", "__tc"]


def _shared(at, side: int):
    """Whether cells along row or column ``at`` (a column or an array) lie in two blocks."""
    return (at > 0) & (at % side == 0)


def _in_blocks(cells: DataFrame, side: int) -> DataFrame:
    """``cells`` once for each block that holds them."""
    blocks = lambda at: F.sequence(F.floor(F.greatest(at - 1, F.lit(0)) / side).cast("int"), F.floor(at / side).cast("int"))
    return cells.select("*", F.explode(blocks(F.col("row"))).alias("__tr")).select("*", F.explode(blocks(F.col("col"))).alias("__tc"))


def _places(values: DataFrame, spec: GridSpec, *columns: str | Column) -> DataFrame:
    return values.select(F.floor(F.col("id") / spec.ncols).cast("long").alias("row"), F.pmod("id", F.lit(spec.ncols)).cast("int").alias("col"), *columns)


def _merges(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> Iterator[tuple[int, int, float]]:
    """Trees of 0 to n - 1 that the edges join, by ascending weight: the one that ends, the one that goes on, and the weight."""
    up, order = list(range(n)), np.argsort(w, kind="stable")
    for i, j, x in zip(a[order].tolist(), b[order].tolist(), w[order].tolist(), strict=True):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            up[i] = j
            yield i, j, x


def _contracted(a, b, w, ncols: int, side: int):
    """A forest of edges that has the same least greatest weights between the nodes on lines that blocks share, and to SOURCE."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    stay = (nodes == SOURCE) | _shared(nodes // ncols, side) | _shared(nodes % ncols, side)
    face = np.where(stay, np.arange(len(nodes)), -1).tolist()
    out: list[tuple[int, int, float]] = []
    for i, j, x in _merges(at[: len(a)], at[len(a) :], w, len(nodes)):
        if face[i] >= 0 and face[j] >= 0:
            out.append((face[i], face[j], x))
        face[j] = max(face[i], face[j])
    p, q, x = (np.array(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return nodes[p], nodes[q], x


def _reached(a, b, w):
    """Nodes with a path from SOURCE, and the least greatest weight on one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    level = np.full(len(nodes), np.nan)
    if len(nodes) and nodes[0] == SOURCE:
        members: list[list[int] | None] = [[k] for k in range(len(nodes))]
        members[0] = None  # nodes are sorted; None marks the tree of SOURCE
        for i, j, x in _merges(at[: len(a)], at[len(a) :], w, len(nodes)):
            one, two = members[i], members[j]
            if one is None or two is None:
                level[one or two or []] = x
                members[j] = None
            else:
                small, large = sorted((one, two), key=len)
                large.extend(small)
                members[j] = large
            members[i] = []
    found = ~np.isnan(level)
    return nodes[found], level[found]


def _pairs(shape: tuple[int, int], dr: int, dc: int) -> tuple[tuple[slice, slice], tuple[slice, slice]]:
    """The parts of an array that hold cells and their neighbours by a step."""
    cut = lambda d, n: (slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d)))
    (r1, r2), (c1, c2) = cut(dr, shape[0]), cut(dc, shape[1])
    return (r1, c1), (r2, c2)


def _array(pdf, name: str, fill=np.nan) -> tuple[np.ndarray, int, int]:
    r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    out = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), fill)
    out[r - r.min(), c - c.min()] = pdf[name].to_numpy()
    return out, int(r.min()), int(c.min())


def _tile_edges(pdf, ncols: int, equal: bool, steps):
    """Edges between neighbours of a tile, and from SOURCE to cells with ``s``."""
    parts = []
    ground = pdf[pdf["v"].notna()]
    if len(ground):
        v, r0, c0 = _array(ground, "v")
        ids = (np.arange(v.shape[0]) + r0)[:, None] * ncols + np.arange(v.shape[1]) + c0
        for dr, dc in steps:
            p, q = _pairs(v.shape, dr, dc)
            on = v[p] == v[q] if equal else ~(np.isnan(v[p]) | np.isnan(v[q]))
            parts.append((ids[p][on], ids[q][on], np.full(on.sum(), -np.inf) if equal else np.maximum(v[p], v[q])[on]))
    source = pdf[pdf["s"].notna()]
    ids = source["row"].to_numpy() * ncols + source["col"].to_numpy()
    parts.append((ids, np.full(len(ids), SOURCE), source["s"].to_numpy()))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def least_greatest(cells: DataFrame, spec: GridSpec, equal: bool = False, connectivity: int = 8) -> DataFrame:
    """Of ``cells`` (row, col, v, s): id and ``level``, the least, over the paths from cells with ``s``, of the greatest of that ``s``
    and of the ``v`` of the steps' cells; with ``equal``, of ``s`` alone, on paths over equal ``v``. Cells without a path are left out."""
    ncols = spec.ncols
    steps = [(dr, dc) for dr, dc in STEPS if (dr, dc) > (0, 0) and (connectivity == 8 or dr == 0 or dc == 0)]
    sides = [TILE]
    while sides[-1] < max(spec.nrows, ncols):
        sides.append(sides[-1] * FANOUT)

    def edges_of(pdf, side: int):
        return _tile_edges(pdf, ncols, equal, steps) if side == sides[0] else tuple(pdf[c].to_numpy() for c in "abw")

    def contract(side: int):
        def run(key, pdf):
            a, b, w = _contracted(*edges_of(pdf, side), ncols, side)
            return type(pdf)({"a": a, "b": b, "w": w, "__tr": key[0], "__tc": key[1]})

        return run

    def solve(side: int):
        def run(pdf):
            ids, level = _reached(*edges_of(pdf, side))
            inside = ~(_shared(ids // ncols, side) | _shared(ids % ncols, side))
            return type(pdf)({"id": ids[inside], "level": level[inside]})

        return run

    tiled = _in_blocks(cells.select(F.col("row").cast("long").alias("row"), "col", F.col("v").cast("double").alias("v"), F.col("s").cast("double").alias("s")), TILE)
    shape = "a long, b long, w double, __tr int, __tc int"
    into = [tiled]
    for side in sides[:-1]:
        edges = pinned(into[-1].groupBy(*KEYS).applyInPandas(contract(side), shape), "contracted")
        into.append(edges.select("a", "b", "w", *[F.floor(F.col(k) / FANOUT).cast("int").alias(k) for k in KEYS]))
    known = None
    for side, part in reversed(list(zip(sides, into, strict=True))):
        if known is not None:
            on = _places(known, spec, "id", F.col("level").alias("w")).where(_shared(F.col("row"), side) | _shared(F.col("col"), side))
            at = _in_blocks(on, side)
            part = part.unionByName(at.select("row", "col", F.lit(None).cast("double").alias("v"), F.col("w").alias("s"), *KEYS) if side == TILE else at.select(F.col("id").alias("a"), F.lit(SOURCE).cast("long").alias("b"), "w", *KEYS))
        solved = part.groupBy(*KEYS).applyInPandas(solve(side), "id long, level double")
        known = pinned(solved if known is None else known.unionByName(solved), "levels")
    return known


def fewest_steps(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """Of ``cells`` (row, col, v, enter, s): id and ``n``, the least of ``s`` plus the steps from a cell that has it, to neighbours
    with an equal ``v`` that may be entered. Cells without a path are left out."""
    ncols = spec.ncols

    def spread(pdf):
        v, r0, c0 = _array(pdf, "v")
        enter = _array(pdf, "enter", False)[0].astype(bool)
        start = np.where(np.isnan(s := _array(pdf, "s")[0]), np.inf, s)
        ways = [(p, q, (v[p] == v[q]) & enter[q]) for p, q in (_pairs(v.shape, dr, dc) for dr, dc in STEPS)]
        n, fell = start.copy(), True
        while fell:
            before = n.copy()
            for p, q, on in ways:
                n[q] = np.where(on, np.minimum(n[q], n[p] + 1), n[q])
            fell = bool((n < before).any())
        r, c = np.nonzero(n < start)
        return type(pdf)({"id": (r + r0) * ncols + c + c0, "n": n[r, c]})

    ground = pinned(cells.select(cell_id(spec, F.col("row"), F.col("col")).alias("id"), F.col("row").cast("long").alias("row"), "col", F.col("v").cast("double").alias("v"), F.col("enter").cast("boolean").alias("enter"), F.col("s").cast("double").alias("n")), "ground")
    known = front = ground.where("n is not null").select("id", "n")
    tiled = _in_blocks(ground.drop("n"), TILE)
    while True:
        active = _in_blocks(_places(front, spec), TILE).select(*KEYS).distinct()
        work = tiled.join(active, KEYS, "left_semi").join(known.withColumnRenamed("n", "s"), "id", "left")
        better = pinned(work.groupBy(*KEYS).applyInPandas(spread, "id long, n double").groupBy("id").agg(F.min("n").alias("n")), "better")
        if better.isEmpty():
            return known
        known = pinned(known.unionByName(better).groupBy("id").agg(F.min("n").alias("n")), "known")
        row, col = F.floor(F.col("id") / ncols), F.pmod("id", F.lit(ncols))
        front = better.where(_shared(row, TILE) | _shared(col, TILE))
