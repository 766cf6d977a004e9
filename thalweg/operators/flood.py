"""Rapid flood spreading: depressions nested in depressions, what they hold, and where water stands after rain.

Every cell leads to its steepest lower neighbour, else to the first of its equals with a smaller id, else it is a minimum: cells with
the same minimum are a basin. Where two basins touch, the lowest pass between them is an edge. Taken from the lowest up, passes join
basins to depressions: the edges that join two make a binary tree, the hierarchy. A depression that is full spills over its pass into
the basin right across it; when both sides are full, the depression above them fills.

Of passes, equal levels go by the cells' ids, so that nothing depends on partitions. The hierarchy is built in rounds: each node's
lowest edge is an edge of the tree, what these connect becomes one node of the next round, and once the rest is solved each edge of a
round is put at its place on the way up. When LIMIT edges or fewer are left, one task takes them by turns; the same bound holds for
sums up the tree and the settling of water, which go by rounds of joins beyond it. Null and NaN have no data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions.geometry import cell_id, distances, on_rim, step_id
from thalweg.operators.hydro import ranked
from thalweg.plans.loops import doubled_sum, pinned, roots
from thalweg.plans.paths import forest_roots
from thalweg.plans.stencil import with_neighbours
from thalweg.spec import GridSpec

#: Rows of a graph or tree that one task may solve at the end of the rounds (some 100 bytes each).
LIMIT = 200_000
#: Steps to neighbours with a larger id: E, SE, S, SW.
FORWARD = (2, 3, 4, 5)
KEY = ["level", "x", "y"]
TREE = "node long, parent long, level double, x long, y long, drop long"
#: After every id of a cell.
LAST = (1 << 63) - 1


def basins(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """id, row, col, z, ``basin`` (the id of the minimum that a cell leads to) of the cells with data. ``cells`` has every position once."""
    z = F.col("z").cast("double")
    own = with_neighbours(cells.select("row", "col", F.when(~F.isnan(z), z).alias("z")))
    row, col = F.col("row"), F.col("col")
    slopes = F.array(*[F.coalesce((F.col("z") - F.col(f"n{k}")) / d, F.lit(float("-inf"))) for k, d in enumerate(distances(spec))])
    ids = F.array(*[step_id(spec, row, col, k) for k in range(8)])
    level = F.least(*[F.when(F.col(f"n{k}") == F.col("z"), step_id(spec, row, col, k)) for k in range(8)], F.lit(LAST))
    own = own.where("z is not null").select("row", "col", "z", cell_id(spec, row, col).alias("id"), slopes.alias("s"), ids.alias("ids"), level.alias("flat"))
    steep = F.array_max("s")
    p = F.when(steep > 0, F.get("ids", F.array_position("s", steep) - 1)).when(F.col("flat") < F.col("id"), F.col("flat"))
    own = pinned(own.select("id", "row", "col", "z", p.cast("long").alias("p")), "descent")
    found = forest_roots(own.select("id", "p", F.lit(0.0).alias("d")), spec)
    return pinned(own.select("id", "row", "col", "z").join(found.select("id", F.col("root").alias("basin")), "id"), "basins")


def passes(ground: DataFrame, spec: GridSpec, *, open_rim: bool = False) -> DataFrame:
    """lo, hi, level, x, y: the lowest pass between each two basins of ``basins`` that touch (8 neighbours), the greater elevation of two
    neighbouring cells ``x`` < ``y``; of equal levels the first by these. With ``open_rim`` cells on the grid's rim have a pass at their
    own elevation to the outside, a basin whose id is ``spec.size``."""
    every = _positions(ground, spec)
    n = with_neighbours(every, "v")
    row, col, own = F.col("row"), F.col("col"), F.col("v.basin")
    sides = [F.struct(F.col(f"n{k}.basin").alias("basin"), F.greatest(F.col("v.z"), F.col(f"n{k}.z")).alias("level"), step_id(spec, row, col, k).alias("y")) for k in FORWARD]
    met = n.where("v is not null").select(own.alias("own"), cell_id(spec, row, col).alias("x"), F.explode(F.array(*sides)).alias("s")).where(F.col("s.basin") != F.col("own"))
    met = met.select(F.least("own", "s.basin").alias("lo"), F.greatest("own", "s.basin").alias("hi"), "s.level", "x", "s.y")
    if open_rim:
        rim = ground.where(on_rim(spec, row, col)).select(F.col("basin").alias("lo"), F.lit(spec.size).cast("long").alias("hi"), F.col("z").alias("level"), F.col("id").alias("x"), F.lit(spec.size).cast("long").alias("y"))
        met = met.unionByName(rim)
    return met.groupBy("lo", "hi").agg(F.min(F.struct(*KEY)).alias("k")).select("lo", "hi", "k.level", "k.x", "k.y")


def _positions(ground: DataFrame, spec: GridSpec) -> DataFrame:
    """Every position of the grid, with ``v`` (z, basin) where there are data."""
    ids = ground.sparkSession.range(spec.size)
    place = ids.select("id", F.floor(F.col("id") / spec.ncols).cast("long").alias("row"), F.pmod("id", F.lit(spec.ncols)).cast("int").alias("col"))
    return place.join(ground.select("id", F.struct("z", "basin").alias("v")), "id", "left").select("row", "col", "v")


class Forest:
    """Trees of nodes that grow together."""

    def __init__(self, nodes: np.ndarray):
        self.up = {n: n for n in nodes.tolist()}

    def root(self, n: int) -> int:
        up = self.up
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tree of a graph's edges, taken in order."""
    e = pdf.sort_values(KEY, kind="stable")
    forest = Forest(np.unique(np.concatenate([e["u"], e["v"]])))
    top = {n: n for n in forest.up}
    out = []
    for u, v, lo, hi, level, x, y, eid in zip(*[e[c].tolist() for c in ("u", "v", "lo", "hi", *KEY, "eid")], strict=True):
        a, b = forest.root(u), forest.root(v)
        if a != b:
            out += [(top[a], eid, level, x, y, hi), (top[b], eid, level, x, y, lo)]
            forest.up[a] = b
            top[b] = eid
    return pd.DataFrame(out, columns=["node", "parent", *KEY, "drop"]).astype({"node": "int64", "parent": "int64", "x": "int64", "y": "int64", "drop": "int64", "level": "float64"})


def _key(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in KEY])


def climbed(asked: DataFrame, tree: DataFrame) -> DataFrame:
    """``asked`` (start, level, x, y and more) with ``node``: the last one on the way up from ``start`` in ``tree`` that is reached
    over passes not after (level, x, y)."""
    jumps = [pinned(tree.select("node", F.col("parent").alias("up"), _key().alias("k")), "jumps")]
    while True:
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        further = pinned(a.join(b, F.col("a.up") == F.col("b.node")).select("a.node", "b.up", "b.k"), "jumps")
        if further.isEmpty():
            break
        jumps.append(further)
    at = asked.withColumn("node", F.col("start"))
    for turn, jump in enumerate(reversed(jumps), 1):
        there = at.join(jump, "node", "left")
        at = there.withColumn("node", F.when(F.col("k") <= _key(), F.col("up")).otherwise(F.col("node"))).drop("up", "k")
        if turn % 6 == 0:
            at = pinned(at, "climbing")
    return pinned(at, "climbed")


def _tree(edges: DataFrame, limit: int) -> DataFrame:
    """The tree (TREE) of the graph of ``edges`` (u, v, lo, hi, level, x, y, eid)."""
    if edges.count() <= limit:
        return pinned(edges.groupBy(F.lit("all")).applyInPandas(_joined, TREE), "tree")
    whole = F.struct(*KEY, "eid", "u", "v", "lo", "hi").alias("e")
    ends = edges.select(F.col("u").alias("n"), whole).unionByName(edges.select(F.col("v").alias("n"), whole))
    first = ends.groupBy("n").agg(F.min("e").alias("e"))
    times = first.groupBy(F.col("e.eid").alias("eid")).agg(F.count("*").alias("c"))
    picked = pinned(first.select("n", "e.*").join(times, "eid"), "picked")
    other = F.when(F.col("n") == F.col("u"), F.col("v")).otherwise(F.col("u"))
    to = picked.select(F.col("n").alias("id"), F.when(~((F.col("c") == 2) & (F.col("n") < other)), other).alias("p"), F.lit(0.0).alias("d"))
    group = roots(to).select(F.col("id").alias("n"), F.col("root").alias("g"))
    rest = edges.join(times.select("eid"), "eid", "left_anti")
    for end in ("u", "v"):
        rest = rest.join(group.select(F.col("n").alias(end), F.col("g").alias(f"g{end}")), end)
    rest = rest.where("gu != gv").select(*KEY, "eid", F.col("gu").alias("u"), F.col("gv").alias("v"), "lo", "hi")
    rest = rest.groupBy(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q")).agg(F.min(whole).alias("e")).select("e.*")
    upper = _tree(pinned(rest, "contracted"), limit)
    # every picked edge goes above the last node that is joined before it
    one = picked.groupBy("eid", "u", "v", "lo", "hi", *KEY, "c").agg(F.min("n").alias("n"))
    asked = one.join(group, "n").withColumnRenamed("g", "start")
    chain = ranked(climbed(asked, upper).withColumnRenamed("node", "below"), "below", *KEY)
    chain = pinned(chain.select("place", "below", "eid", "n", "u", "lo", "hi", "c", *KEY), "chains")
    apart = lambda c: F.when(F.col("n") == F.col("u"), F.col("lo" if c else "hi")).otherwise(F.col("hi" if c else "lo"))  # noqa: E731  the basin on the picking node's side, or across
    leaves = picked.select(F.col("n").alias("node"), F.col("eid").alias("parent"), *KEY, apart(False).alias("drop"))
    above = chain.select((F.col("place") - 1).alias("place"), F.col("below").alias("b2"), F.col("eid").alias("parent"), *[F.col(c).alias(f"k_{c}") for c in KEY], apart(True).alias("drop"))
    linked = pinned(chain.select("place", "below", "eid").join(above, "place", "left").withColumn("on", F.coalesce(F.col("b2") == F.col("below"), F.lit(False))), "linked")
    keys = [F.col(f"k_{c}").alias(c) for c in KEY]
    along = linked.where("on").select(F.col("eid").alias("node"), "parent", *keys, "drop")
    last = linked.where("not on").select(F.col("eid").alias("node"), F.col("below")).join(upper.withColumnRenamed("node", "below"), "below").select("node", "parent", *KEY, "drop")
    lowest = chain.groupBy("below").agg(F.min(F.struct(*KEY, "eid", apart(True).alias("drop"))).alias("e"))
    under = lowest.where("below < 0").select(F.col("below").alias("node"), F.col("e.eid").alias("parent"), *[F.col(f"e.{c}").alias(c) for c in KEY], "e.drop")
    free = upper.where("node < 0").join(lowest.select(F.col("below").alias("node")), "node", "left_anti")
    out = leaves
    for part in (along, last, under, free):
        out = out.unionByName(part.select(*leaves.columns))
    return pinned(out, "tree")


def hierarchy(pass_: DataFrame, spec: GridSpec, limit: int = LIMIT) -> DataFrame:
    """The nested depressions that ``passes`` make: node, parent, level, x, y, drop. A node is a basin (its id) or a depression in which
    two others are joined (a negative id); ``level`` is that at which it spills, over the pass from ``x`` to ``y``, into the basin
    ``drop``. What is never joined to anything (the whole grid's depression, say) has no row."""
    step = F.col("y") - F.col("x")
    k = F.when(F.col("y") == spec.size, 0).when(step == spec.ncols, 4).when(step == spec.ncols + 1, 3).when(step == spec.ncols - 1, 5).otherwise(2)
    k = F.when((step == 1) & (spec.ncols != 2), 2).otherwise(k)
    edges = pass_.select(F.col("lo").alias("u"), F.col("hi").alias("v"), "lo", "hi", *KEY, (-(F.col("x") * 8 + k + 1)).cast("long").alias("eid"))
    return _tree(pinned(edges, "edges"), limit)


def _nodes(ground: DataFrame, tree: DataFrame) -> DataFrame:
    """All nodes with their parents and spill levels: those of ``tree``, its tops, and basins without passes."""
    names = tree.select("node").unionByName(tree.select(F.col("parent").alias("node"))).unionByName(ground.select(F.col("basin").alias("node"))).distinct()
    return names.join(tree, "node", "left")


def _up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over a bounded tree: nodes in the order of their parents' passes."""
    pdf = pdf.sort_values(KEY, kind="stable", na_position="last")
    at = {n: i for i, n in enumerate(pdf["node"].tolist())}
    n, s = pdf["n"].to_numpy().copy(), pdf["s"].to_numpy().copy()
    for i, p in enumerate(pdf["parent"].tolist()):
        if p == p and p is not None:
            j = at[int(p)]
            n[j] += n[i]
            s[j] += s[i]
    return pd.DataFrame({"node": pdf["node"], "n": n, "s": s})


def _sums(nodes: DataFrame, limit: int) -> DataFrame:
    """Of ``nodes`` (node, parent, level, x, y, n, s): node, and n and s with all below it."""
    if nodes.count() <= limit:
        return nodes.groupBy(F.lit("all")).applyInPandas(_up, "node long, n double, s double")
    one = lambda c: doubled_sum(nodes.select(F.col("node").alias("id"), F.col("parent").alias("p"), F.col(c).alias("s"), F.lit(1.0).alias("m"))).select(F.col("id").alias("node"), F.col("s").alias(c))
    return one("n").join(one("s"), "node")


def capacities(ground: DataFrame, tree: DataFrame, spec: GridSpec, limit: int = LIMIT) -> DataFrame:
    """node, parent, level, x, y, drop and ``capacity``: what a node holds until it spills, in elevation times cells; infinite for tops
    and for what is joined with the outside.

    A cell counts for the nodes on the way up from its basin that spill above it: they begin with one node, so each cell is counted
    there, and counts and elevations are summed up the tree."""
    base = ground.agg(F.min("z")).head()[0] or 0.0
    spill = tree.select(F.col("node").alias("basin"), F.col("level").alias("spill"))
    cell = ground.select("basin", "z").join(spill, "basin", "left")
    counted = cell.groupBy("basin", F.when(F.col("z") >= F.col("spill"), F.col("z")).alias("level")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("z") - base).alias("s"))
    high = counted.where("level is not null").select(F.col("basin").alias("start"), "level", F.lit(LAST).alias("x"), F.lit(LAST).alias("y"), "n", "s")
    low = counted.where("level is null").select(F.col("basin").alias("node"), "n", "s")
    at = low.unionByName(climbed(high, tree).select("node", "n", "s")).groupBy("node").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    nodes = _nodes(ground, tree).join(at, "node", "left").fillna(0.0, ["n", "s"])
    nodes = pinned(nodes.withColumn("s", F.when(F.col("node") == spec.size, float("-inf")).otherwise(F.col("s"))), "nodes")
    whole = F.coalesce((F.col("level") - base) * F.col("n") - F.col("s"), F.lit(float("inf")))
    full = nodes.drop("n", "s").join(_sums(nodes, limit), "node")
    return pinned(full.select("node", "parent", *KEY, "drop", F.greatest(whole, F.lit(0.0)).alias("capacity")), "capacities")


class Tally:
    """Amounts at places, and their sum between two places (a binary indexed tree)."""

    def __init__(self, n: int):
        self.sums = [0.0] * (n + 1)

    def add(self, at: int, amount: float) -> None:
        at += 1
        while at < len(self.sums):
            self.sums[at] += amount
            at += at & -at

    def before(self, at: int) -> float:
        out = 0.0
        while at:
            out += self.sums[at]
            at &= at - 1
        return out


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The water of a bounded tree: depressions from the highest pass down, what is over in one flowing to the other's basin."""
    pdf = pdf.sort_values(KEY, kind="stable", na_position="last")
    nodes, cap, drop = pdf["node"].tolist(), pdf["capacity"].tolist(), pdf["drop"].tolist()
    at = {n: i for i, n in enumerate(nodes)}
    parent = [at[int(p)] if p == p and p is not None else -1 for p in pdf["parent"].tolist()]
    below: list[list[int]] = [[] for _ in nodes]
    total = pdf["w"].tolist()
    for i, p in enumerate(parent):  # children come before their parents
        if p >= 0:
            below[p].append(i)
            total[p] += total[i]
    start, end, places = [0] * len(nodes), [0] * len(nodes), 0
    stack = [(i, False) for i, p in enumerate(parent) if p < 0]
    while stack:
        i, left = stack.pop()
        if left:
            end[i] = places
            continue
        start[i] = places
        places += not below[i]
        stack.append((i, True))
        stack += [(j, False) for j in below[i]]
    moved, pool, held = Tally(places), [-1] * len(nodes), [0.0] * len(nodes)
    arrived = lambda i: total[i] + moved.before(end[i]) - moved.before(start[i])
    for i in range(len(nodes) - 1, -1, -1):
        if parent[i] < 0:
            held[i] = total[i]
        if pool[i] < 0 and (not below[i] or held[i] >= sum(cap[j] for j in below[i])):
            pool[i] = i
        if not below[i]:
            continue
        a, b = below[i]
        if pool[i] >= 0:
            pool[a] = pool[b] = pool[i]
        x, y = arrived(a), arrived(b)
        over, back = min(max(0.0, x - cap[a]), max(0.0, cap[b] - y)), min(max(0.0, y - cap[b]), max(0.0, cap[a] - x))
        held[a], held[b] = min(cap[a], x + back), min(cap[b], y + over)
        if over:
            moved.add(start[at[int(drop[a])]], over)
        if back:
            moved.add(start[at[int(drop[b])]], back)
    leaves = [i for i, c in enumerate(below) if not c]
    return pd.DataFrame({"basin": [nodes[i] for i in leaves], "pool": [nodes[pool[i]] for i in leaves], "water": [held[pool[i]] for i in leaves]})


def _settled_by_rounds(nodes: DataFrame, limit: int) -> DataFrame:
    """As ``_settled``: flows between the two sides of each pass, from what the flows of the round before bring, until none changes.
    What is right above a pass is right below it a round later."""
    nodes = pinned(nodes, "nodes")
    own = pinned(_sums(nodes.select("node", "parent", *KEY, F.lit(0.0).alias("n"), F.col("w").alias("s")), limit).select("node", F.col("s").alias("total")), "totals")
    flows = pinned(nodes.where("parent is not null").select("node", F.lit(0.0).alias("f")), "flows")
    side = nodes.join(own, "node").select("node", "parent", "drop", "capacity", "total")
    while True:
        gained = flows.join(nodes.select("node", "drop"), "node").groupBy(F.col("drop").alias("node")).agg(F.sum("f").alias("g"))
        moved = nodes.select("node", "parent", *KEY).join(gained, "node", "left").join(flows, "node", "left")
        net = _sums(moved.select("node", "parent", *KEY, F.lit(0.0).alias("n"), (F.coalesce("g", F.lit(0.0)) - F.coalesce("f", F.lit(0.0))).alias("s")), limit).select("node", F.col("s").alias("net"))
        here = pinned(side.join(net, "node").join(flows, "node", "left").select("node", "parent", "drop", "capacity", "total", (F.col("total") + F.col("net") + F.coalesce("f", F.lit(0.0))).alias("a"), F.coalesce("f", F.lit(0.0)).alias("f")), "water")
        other = here.select("parent", F.col("node").alias("o"), F.col("capacity").alias("oc"), F.col("a").alias("oa"), F.col("f").alias("of"))
        pair = here.where("parent is not null").join(other, "parent").where("node != o")
        x, ox = F.col("a") - F.col("of"), F.col("oa") - F.col("f")  # what arrives on each side without this pass's own flows
        flow = F.least(F.greatest(x - F.col("capacity"), F.lit(0.0)), F.greatest(F.col("oc") - ox, F.lit(0.0)))
        pair = pinned(pair.select("node", "parent", x.alias("a"), "capacity", "oc", "of", F.col("f").alias("old"), flow.alias("f")), "flows")
        if pair.where(F.abs(F.col("f") - F.col("old")) > 1e-12 * (1 + F.abs(F.col("f"))) + 1e-13 * F.abs(F.col("a"))).isEmpty():
            break
        flows = pair.select("node", "f")
    tops = here.where("parent is null").select("node", F.col("total").alias("water"))  # what flows stays in the tree
    water = pinned(tops.unionByName(pair.select("node", F.least("capacity", F.col("a") + F.col("of")).alias("water"))), "held")
    room = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.sum("capacity").alias("room"))
    # below an active node all are, which rounding may deny where passes are level; so a node's pool is the highest active one above it
    active = water.join(room, "node").where("water >= room").select(F.col("node").alias("parent"), F.lit(1.0).alias("d"))
    up = nodes.select("node", "parent").join(active, "parent", "left").select(F.col("node").alias("id"), F.col("parent").alias("p"), F.coalesce("d", F.lit(0.0)).alias("d"))
    above = roots(up).where("d > 0").select("id")
    to = up.join(above.withColumn("on", F.lit(True)), "id", "left").select("id", F.when(F.col("on"), F.col("p")).alias("p"), F.lit(0.0).alias("d"))
    basin = nodes.select("node").join(room, "node", "left_anti")
    pools = basin.join(roots(to), basin["node"] == F.col("id")).select(F.col("node").alias("basin"), F.col("root").alias("pool"))
    return pools.join(water.withColumnRenamed("node", "pool"), "pool").select("basin", "pool", "water")


def settle(capacity: DataFrame, runoff: DataFrame, limit: int = LIMIT) -> DataFrame:
    """basin, ``pool`` (the node whose water covers it: itself, or the largest depression above it whose sides are full) and ``water``,
    what the pool holds, of ``capacities`` and ``runoff`` (basin, w: what falls on it). Nothing is lost: pools hold what has fallen."""
    w = runoff.groupBy(F.col("basin").alias("node")).agg(F.sum(F.col("w").cast("double")).alias("w"))
    nodes = pinned(capacity.join(w, "node", "left").fillna(0.0, ["w"]), "runoff")
    if nodes.count() <= limit:
        return pinned(nodes.groupBy(F.lit("all")).applyInPandas(_settled, "basin long, pool long, water double"), "settled")
    return pinned(_settled_by_rounds(nodes, limit), "settled")


def total(amount: Column) -> Column:
    """The sum of ``amount``: of its multiples of 2^-20, which is exact up to 2^33, and of the rest, so that errors don't grow with the rows."""
    whole = F.rint(amount * 2.0**20) / 2.0**20
    return F.sum(whole) + F.sum(amount - whole)


def water_levels(rows: DataFrame) -> DataFrame:
    """pool and ``level``, of ``rows`` (pool, water, id, z: the cells of a pool): the level at which the cells below it hold the water.

    A pool's cells are ranged by elevation and their sums carried on from range to range, so no task holds a pool."""
    by = ["pool", "z", "id"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = rows.groupBy("pool").agg(F.min("z").alias("base"))
    cells = rows.join(base, "pool").withColumn("z", F.col("z") - F.col("base"))
    ranged = pinned(cells.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("pool", "part").agg(F.count("*").alias("n"), F.sum("z").alias("s"))
    earlier = Window.partitionBy("pool").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("pool", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s0"))
    upto = Window.partitionBy("pool", "part").orderBy("z", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("n1", F.count("*").over(upto)).withColumn("s1", F.sum("z").over(upto)).join(parts, ["pool", "part"])
    wet = run.where((F.col("n0") + F.col("n1")) * F.col("z") - F.col("s0") - F.col("s1") < F.col("water"))
    return wet.groupBy("pool", "water", "base").agg(F.count("*").alias("n"), total(F.col("z")).alias("s")).select("pool", (F.col("base") + (F.col("water") + F.col("s")) / F.col("n")).alias("level"))


def flood(cells: DataFrame, water: DataFrame, spec: GridSpec, *, open_rim: bool = False, limit: int = LIMIT) -> DataFrame:
    """row, col, level, depth of the cells under water after ``water`` (row, col, depth: of rain) has run off, filled depressions and
    spilled. The grid is closed, so that depths add up to the rain, unless ``open_rim`` lets water leave over the rim. Rain on cells
    without data, and null rain, is none."""
    ground = basins(cells, spec)
    tree = hierarchy(passes(ground, spec, open_rim=open_rim), spec, limit)
    full = capacities(ground, tree, spec, limit)
    rain = water.where("depth > 0").select(cell_id(spec, F.col("row"), F.col("col")).alias("id"), F.col("depth").cast("double").alias("w"))
    pools = settle(full, ground.join(rain, "id").select("basin", "w"), limit).where("water > 0")
    inside = pinned(ground.join(pools, "basin").select("pool", "water", "id", "row", "col", "z"), "pools")
    level = water_levels(inside.select("pool", "water", "id", "z"))
    return inside.join(level, "pool").where("level > z").select("row", "col", "level", (F.col("level") - F.col("z")).alias("depth"))
