"""Graphs without cycles over the cells of a grid, whose edges lead to neighbours: tiles first, then what crosses them.

What reaches the cells of a tile is linear in what comes in from other tiles (for greatest costs, linear with max for the sum). So a tile is
contracted to its entries, the cells with edges from outside: how much of what comes in at each goes to which entries of the tiles
around. What is left is peeled, a round for each tile on the longest path instead of one for each cell, over a row in SIDE / 4; what
comes in then goes back to the tiles, which are solved once more. Cells on cycles and below keep what had reached them, as in
``loops.peeled``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.plans.loops import peel, pinned
from thalweg.spec import GridSpec

SIDE = 64
KEYS = ["__tr", "__tc"]
NODE, EDGE = 0, 1
AMOUNT, LINK, HELD = 0, 1, 2
CELL, SENT = 0, 1


def _places(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The place of each id in ``of``, -1 where it isn't there."""
    if not len(of):
        return np.full(len(ids), -1)
    order = np.argsort(of)
    at = order[np.minimum(np.searchsorted(of, ids, sorter=order), len(of) - 1)]
    return np.where(of[at] == ids, at, -1)


class Part:
    """A tile's cells and edges: ``src``, ``dst``, ``m`` of those inside, by places; ``x``, ``to``, ``share`` of those that leave it;
    ``entries``, the places that edges from outside lead to; ``level``, the steps after which a cell has all that reaches it, -1 where
    a cycle or one of the ``held`` ids keeps it waiting."""

    def __init__(self, rows: pd.DataFrame, ncols: int, side: int, greatest: bool, held: np.ndarray | None = None):
        kind, a, b, v = (rows[c].to_numpy() for c in ("kind", "a", "b", "v"))
        node = kind == NODE
        self.ids, self.s, self.greatest, n = a[node], v[node], greatest, int(node.sum())
        home = (self.ids[0] // ncols // side, self.ids[0] % ncols // side) if n else None
        a, b, v = a[~node], b[~node], v[~node]
        i, j = _places(a, self.ids), _places(b, self.ids)
        away = (b // ncols // side != home[0]) | (b % ncols // side != home[1]) if n else np.zeros(len(b), bool)
        inside, leaves = (i >= 0) & (j >= 0), (i >= 0) & away
        self.src, self.dst, self.m = i[inside], j[inside], v[inside]
        self.x, self.to, self.share = i[leaves], b[leaves], v[leaves]
        self.entries = np.unique(j[(i < 0) & (j >= 0)])
        self._order(n, None if held is None else _places(held, self.ids))

    def _order(self, n: int, held: np.ndarray | None) -> None:
        need = np.bincount(self.dst, minlength=n)
        if held is not None:
            need[held[held >= 0]] += 1
        self.level, step = np.full(n, -1), 0
        src, dst = self.src, self.dst
        ready = need == 0
        while ready.any():
            self.level[ready] = step
            sends = ready[src]
            need = need - np.bincount(dst[sends], minlength=n)
            src, dst, step = src[~sends], dst[~sends], step + 1
            ready = (need == 0) & (self.level < 0)
        solved = np.flatnonzero(self.level[self.dst] >= 0)
        solved = solved[np.lexsort((self.dst[solved], self.level[self.dst[solved]]))]
        self.plan = np.split(solved, np.flatnonzero(np.diff(self.level[self.dst[solved]])) + 1) if len(solved) else []

    def spread(self, value: np.ndarray, joined: np.ufunc, passed: np.ufunc | None) -> np.ndarray:
        """``value`` (a row or number a cell) with all that reaches each cell inside the tile, in place; level by level."""
        for edges in self.plan:
            dst = self.dst[edges]
            first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
            got = value[self.src[edges]]
            if passed is not None:
                got = passed(got, self.m[edges] if value.ndim == 1 else self.m[edges][:, None])
            at = dst[first]
            value[at] = joined(value[at], joined.reduceat(got, first, axis=0))
        return value

    def totals(self, value: np.ndarray) -> np.ndarray:
        return self.spread(value, *((np.maximum, np.add) if self.greatest else (np.add, np.multiply)))

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        """How much of what comes in at each entry (column) reaches each cell (row), and whether a path does."""
        shape = (len(self.ids), len(self.entries))
        own = np.zeros(shape, bool)
        own[self.entries, np.arange(shape[1])] = True
        if self.greatest:
            value = self.totals(np.where(own, 0.0, -np.inf))
            return value, value > -np.inf
        return self.totals(own.astype(float)), self.spread(own, np.logical_or, None)


def _grouped(key: np.ndarray, value: np.ndarray, greatest: bool) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, each with the sum or the greatest of its values."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], (np.maximum if greatest else np.add).reduceat(value, first)


def _tile_of(c: str, spec: GridSpec, side: int) -> Column:
    return F.struct(F.floor(F.floor(F.col(c) / spec.ncols) / side).cast("int").alias("r"), F.floor(F.pmod(c, F.lit(spec.ncols)) / side).cast("int").alias("c"))


def graph_carried(amounts: DataFrame, edges: DataFrame, spec: GridSpec, greatest: bool = False, side: int = SIDE) -> DataFrame:
    """As ``loops.peeled``, of ``amounts`` (id, s) and ``edges`` (src, dst: a neighbour, m) on a grid: id and ``s`` with all that reaches
    it: amounts times shares added, or the greatest of amounts plus costs. Edges from or to ids that ``amounts`` lacks don't count,
    but for those from outside the tile, so ``src`` has to be among them."""
    ncols = spec.ncols
    nodes = amounts.select(F.lit(NODE).alias("kind"), F.col("id").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("s").cast("double").alias("v"), _tile_of("id", spec, side).alias("t"))
    lines = edges.select(F.lit(EDGE).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("m").cast("double").alias("v"), F.explode(F.array_distinct(F.array(_tile_of("src", spec, side), _tile_of("dst", spec, side)))).alias("t"))
    rows = pinned(nodes.unionByName(lines).select("kind", "a", "b", "v", F.col("t.r").alias("__tr"), F.col("t.c").alias("__tc")).repartition(*KEYS), "dealt")

    def contract(pdf):
        t = Part(pdf, ncols, side, greatest)
        base = t.totals(t.s.copy())
        ends, to = np.unique(t.to, return_inverse=True)
        out = t.level[t.x] >= 0
        op = np.add if greatest else np.multiply
        amount = np.where(out, op(base[t.x], t.share), 0.0)
        at, v = _grouped(to, amount, greatest)
        made = [pd.DataFrame({"kind": AMOUNT, "src": -1, "dst": ends[at], "m": v})]
        if len(t.entries) and out.any():
            value, reach = t.maps()
            k, c = np.nonzero(reach[t.x] & out[:, None])
            key, v = _grouped(c * len(ends) + to[k], op(value[t.x[k], c], t.share[k]), greatest)
            made.append(pd.DataFrame({"kind": LINK, "src": t.ids[t.entries[key // len(ends)]], "dst": ends[key % len(ends)], "m": v}))
        stuck = np.unique(t.to[~out])
        made.append(pd.DataFrame({"kind": HELD, "src": stuck, "dst": stuck, "m": 0.0}))
        return pd.concat(made)

    parts = pinned(rows.groupBy(*KEYS).applyInPandas(contract, "kind int, src long, dst long, m double"), "contracted")
    base = parts.where(F.col("kind") == AMOUNT).groupBy(F.col("dst").alias("id")).agg((F.max("m") if greatest else F.sum("m")).alias("s"))
    done, waiting = peel(base, parts.where(F.col("kind") != AMOUNT).select("src", "dst", "m"), greatest)
    waiting = pinned(waiting.select("id"), "held")
    stuck = not waiting.isEmpty()
    inflow = done.select("id", "s", F.lit(True).alias("ok")).unionByName(waiting.select("id", F.lit(0.0).alias("s"), F.lit(False).alias("ok")))
    inflow = inflow.select("*", _tile_of("id", spec, side).alias("t")).select("id", "s", "ok", F.col("t.r").alias("__tr"), F.col("t.c").alias("__tc"))

    def finish(pdf, more):
        ok = more["ok"].to_numpy().astype(bool)
        t = Part(pdf, ncols, side, greatest, more["id"].to_numpy()[~ok])
        at, v = _places(more["id"].to_numpy(), t.ids), t.s.copy()
        on = (at >= 0) & ok
        extra = more["s"].to_numpy()[on]
        v[at[on]] = np.maximum(v[at[on]], extra) if greatest else v[at[on]] + extra
        v = t.totals(v)
        op = np.add if greatest else np.multiply
        late = (t.level[t.dst] < 0) & (t.level[t.src] >= 0)
        if late.any():
            place, got = _grouped(t.dst[late], op(v[t.src[late]], t.m[late]), greatest)
            v[place] = np.maximum(v[place], got) if greatest else v[place] + got
        made = [pd.DataFrame({"kind": CELL, "id": t.ids, "s": v})]
        if stuck:
            sends = t.level[t.x] >= 0
            made.append(pd.DataFrame({"kind": SENT, "id": t.to[sends], "s": op(v[t.x[sends]], t.share[sends])}))
        return pd.concat(made)

    solved = rows.groupBy(*KEYS).cogroup(inflow.groupBy(*KEYS)).applyInPandas(finish, "kind int, id long, s double")
    if not stuck:
        return solved.where(F.col("kind") == CELL).select("id", "s")
    # cells on cycles and below, at which edges from other tiles end: what those sent that could
    solved = pinned(solved, "solved")
    sent = solved.where(F.col("kind") == SENT).join(waiting, "id", "left_semi").groupBy("id").agg((F.max("s") if greatest else F.sum("s")).alias("g"))
    total = F.greatest("s", "g") if greatest else F.col("s") + F.coalesce("g", F.lit(0.0))
    return solved.where(F.col("kind") == CELL).join(sent, "id", "left").select("id", total.alias("s"))
