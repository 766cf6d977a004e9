"""Forests over the cells of a grid, where each cell leads to one of its neighbours: tiles first, then what crosses them.

A tile is solved by doubling pointers in arrays and contracted to its border cells: where the path from each leaves the tile, and what it
takes along (a sum, a share, a cost). What is left has one row in SIDE / 4 and is solved by doubling in rounds of joins, about
log2(tiles on the longest path). Its results go back to the tiles, which are solved once more. So cells are dealt out twice, whatever the
paths' lengths. Forests with cycles go back to the rounds over all cells, which say what cells on a cycle get.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.plans.loops import Cycles, doubled_max, doubled_sum, pinned, roots
from thalweg.spec import GridSpec

SIDE = 256
KEYS = ["__tr", "__tc"]
TILES = "__tr int, __tc int"
CELL, EXIT, CYCLE = 0, 1, 2


def _dealt(rows: DataFrame, spec: GridSpec, side: int, *columns: str) -> DataFrame:
    """``rows`` (id) with the tile that each lies in; no next cell is -1."""
    at = [F.floor(F.floor(F.col("id") / spec.ncols) / side).cast("int").alias("__tr"), F.floor(F.pmod("id", F.lit(spec.ncols)) / side).cast("int").alias("__tc")]
    return rows.select(*[F.coalesce("p", F.lit(-1)).cast("long").alias("p") if c == "p" else F.col(c) for c in columns], *at)


class Tile:
    """The cells of a tile: ``nxt``, the place of the next one or -1; ``last``, that of the last one on the way inside the tile;
    ``out``, the cell outside that the last one leads to or -1; ``cycle``, whether there is no last one."""

    def __init__(self, ids: np.ndarray, p: np.ndarray, ncols: int, side: int):
        self.ids, n = ids, len(ids)
        row, col = ids // ncols, ids % ncols
        r, c = row % side, col % side
        at = np.full(side * side, -1)
        at[r * side + c] = np.arange(n)
        inside = (p >= 0) & (p // ncols // side == row // side) & (p % ncols // side == col // side)
        self.nxt = np.where(inside, at[np.where(inside, p // ncols % side * side + p % ncols % side, 0)], -1)
        self.border = (r == 0) | (c == 0) | (r == side - 1) | (c == side - 1)
        end = self.nxt < 0
        self.last = np.where(end, np.arange(n), self.nxt)
        for _ in range(n.bit_length() + 1):
            further = self.last[self.last]
            if (further == self.last).all():
                break
            self.last = further
        self.cycle = ~end[self.last]
        self.nxt = np.where(self.cycle, -1, self.nxt)  # else jumps along them would not end
        self.out = p[self.last]
        self.leaves = end & (p >= 0)

    def along(self, cost: np.ndarray, op=np.add) -> np.ndarray:
        """``cost`` put together over the way from each cell to where it leaves the tile; of ends of paths nothing."""
        total = np.where((self.nxt >= 0) | self.leaves, cost, op.identity)
        for ptr, part, on in self._rounds(total, op):
            total = np.where(on, op(part, part[ptr]), part)
        return total

    def _rounds(self, cost: np.ndarray, op):
        """Pointers and costs of ever longer jumps."""
        ptr = self.nxt
        while (on := ptr >= 0).any():
            yield ptr, cost, on
            cost = np.where(on, op(cost, cost[ptr]), cost)
            ptr = np.where(on, ptr[ptr], -1)

    def sums(self, s: np.ndarray, m: np.ndarray) -> np.ndarray:
        for ptr, share, on in self._rounds(m, np.multiply):
            s = s + np.bincount(ptr[on], share[on] * s[on], len(s))
        return s

    def most(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        for ptr, cost, on in self._rounds(c, np.add):
            gain = r.copy()
            np.maximum.at(gain, ptr[on], r[on] + cost[on])
            r = gain
        return r


def _tile(pdf, ncols: int, side: int) -> Tile:
    return Tile(pdf["id"].to_numpy(), pdf["p"].to_numpy(), ncols, side)


def _found(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each id its place in ``of``, and whether it is there."""
    order = np.argsort(of)
    at = np.searchsorted(of, ids, sorter=order)
    at = order[np.minimum(at, len(of) - 1)] if len(of) else np.zeros(len(ids), int)
    return at, (of[at] == ids if len(of) else np.zeros(len(ids), bool))


def forest_roots(nodes: DataFrame, spec: GridSpec, side: int = SIDE) -> DataFrame:
    """As ``loops.roots``, of ``nodes`` (id, p: a neighbour or null, d) on a grid: id, ``root``, ``d``; no row for cells on or above a
    cycle."""
    ncols = spec.ncols
    cells = _dealt(nodes.select("id", "p", F.coalesce(F.col("d").cast("double"), F.lit(0.0)).alias("d")), spec, side, "id", "p", "d")

    def contract(key, pdf):
        t = _tile(pdf, ncols, side)
        d, own = t.along(pdf["d"].to_numpy()), t.border & ~t.cycle
        outs = np.unique(t.out[~t.cycle & (t.out >= 0)])
        made = pd.DataFrame({"kind": CELL, "id": t.ids[own], "p": t.out[own], "root": t.ids[t.last[own]], "d": d[own]})
        exits = pd.DataFrame({"kind": EXIT, "id": outs, "p": -1, "root": -1, "d": 0.0})
        return pd.concat([made, exits]).assign(__tr=key[0], __tc=key[1])

    shape = f"kind int, id long, p long, root long, d double, {TILES}"
    parts = pinned(cells.groupBy(*KEYS).applyInPandas(contract, shape), "contracted")
    border = parts.where(F.col("kind") == CELL).select("id", F.when(F.col("p") >= 0, F.col("p")).alias("p"), "root", "d")
    ends = border.where("p is null").select(F.col("id").alias("end"), F.col("root").alias("to"), F.col("d").alias("more"))
    solved = roots(border.select("id", "p", "d")).select("id", F.col("root").alias("end"), "d").join(ends, "end").select("id", F.col("to").alias("root"), (F.col("d") + F.col("more")).alias("d"))
    known = pinned(parts.where(F.col("kind") == EXIT).select("id", *KEYS).join(solved, "id"), "exits")

    def finish(key, pdf, exits):
        t = _tile(pdf, ncols, side)
        d, root = t.along(pdf["d"].to_numpy()), t.ids[t.last]
        at, there = _found(t.out, exits["id"].to_numpy())
        on = t.out >= 0
        if len(exits):
            root = np.where(on, exits["root"].to_numpy()[at], root)
            d = d + np.where(on & there, exits["d"].to_numpy()[at], 0.0)
        keep = ~t.cycle & (~on | there)
        return pd.DataFrame({"id": t.ids[keep], "root": root[keep], "d": d[keep]})

    return pinned(cells.groupBy(*KEYS).cogroup(known.groupBy(*KEYS)).applyInPandas(finish, "id long, root long, d double"), "rooted")


def _carried(nodes: DataFrame, spec: GridSpec, side: int, share: str, own: str, solve, op, tile_op: str) -> DataFrame:
    """Of ``nodes`` (id, p, ``share``, ``own``): id and ``own`` with all that reaches it."""
    ncols, greatest = spec.ncols, tile_op == "most"
    cells = _dealt(nodes, spec, side, "id", "p", share, own)

    def contract(key, pdf):
        t = _tile(pdf, ncols, side)
        if t.cycle.any():
            return pd.DataFrame({"kind": [CYCLE], "id": -1, "p": -1, "v": 0.0, "__tr": key[0], "__tc": key[1]})
        x = pdf[share].to_numpy()
        total = getattr(t, tile_op)(pdf[own].to_numpy(), x)
        made = pd.DataFrame({"kind": CELL, "id": t.ids[t.border], "p": t.out[t.border], "v": t.along(x, op)[t.border]})
        crossing = pd.DataFrame({"kind": EXIT, "id": t.out[t.leaves], "p": -1, "v": op(total, x)[t.leaves]})
        return pd.concat([made, crossing]).assign(__tr=key[0], __tc=key[1])

    parts = pinned(cells.groupBy(*KEYS).applyInPandas(contract, f"kind int, id long, p long, v double, {TILES}"), "contracted")
    if not parts.where(F.col("kind") == CYCLE).isEmpty():
        raise Cycles
    base = parts.where(F.col("kind") == EXIT).groupBy("id").agg((F.max("v") if greatest else F.sum("v")).alias(own))
    border = parts.where(F.col("kind") == CELL).select("id", F.when(F.col("p") >= 0, F.col("p")).alias("p"), F.col("v").alias(share))
    reach = solve(border.join(base, "id", "left").select("id", "p", share, F.coalesce(own, F.lit(0.0)).alias(own)))
    inflow = pinned(_dealt(reach.where(F.col(own) != 0), spec, side, "id", own), "inflow")

    def finish(key, pdf, more):
        t = _tile(pdf, ncols, side)
        v = pdf[own].to_numpy().copy()
        at, there = _found(more["id"].to_numpy(), t.ids)
        extra = more[own].to_numpy()[there]
        v[at[there]] = np.maximum(v[at[there]], extra) if greatest else v[at[there]] + extra
        return pd.DataFrame({"id": t.ids, own: getattr(t, tile_op)(v, pdf[share].to_numpy())})

    return cells.groupBy(*KEYS).cogroup(inflow.groupBy(*KEYS)).applyInPandas(finish, f"id long, {own} double")


def forest_sums(nodes: DataFrame, spec: GridSpec, side: int = SIDE) -> DataFrame:
    """As ``loops.doubled_sum``, of ``nodes`` (id, p, s, m) on a grid: id and ``s``, the amount with all that reaches it."""
    nodes = nodes.select("id", "p", F.col("m").cast("double").alias("m"), F.col("s").cast("double").alias("s"))
    try:
        return _carried(nodes, spec, side, "m", "s", lambda x: doubled_sum(x, peel=False), np.multiply, "sums")
    except Cycles:
        return doubled_sum(nodes)


def forest_most(nodes: DataFrame, spec: GridSpec, side: int = SIDE) -> DataFrame:
    """As ``loops.doubled_max``, of ``nodes`` (id, p, c: 0 at least) on a grid: id and ``r``, the greatest cost of a path that ends there."""
    nodes = nodes.select("id", "p", F.col("c").cast("double").alias("c"), F.lit(0.0).alias("r"))
    try:
        return _carried(nodes, spec, side, "c", "r", lambda x: doubled_max(x, peel=False), np.add, "most")
    except Cycles:
        return doubled_max(nodes.drop("r"))
