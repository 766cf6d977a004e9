"""Pits, flats, flow directions and local geometry: one neighbourhood each, no loops.

Cells are (row, col, z), dense, with a null z where there is no data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions.geometry import DIRMAP, FACETS, SECTORS, STEPS, cell_id, distances, facet, on_rim, step_id
from thalweg.plans.stencil import KEYS, around, by_tile, in_tile, in_tiles, with_neighbours
from thalweg.spec import GridSpec

NS = [f"n{k}" for k in range(8)]


def _around(cells: DataFrame, spec: GridSpec, finite: bool = False) -> DataFrame:
    """Neighbours without data count as higher than any (``finite``: by one), and ``inside`` tells cells off the rim."""
    near = with_neighbours(cells)
    if finite:  # one row
        near = near.join(F.broadcast(cells.agg((F.max("z") + 1).alias("__top"))))
    else:
        near = near.withColumn("__top", F.lit(math.inf))
    return near.select(*cells.columns, *[F.coalesce(n, "__top").alias(n) for n in NS], (~on_rim(spec, F.col("row"), F.col("col")) & F.col("z").isNotNull()).alias("inside"))


def detect_pits(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """row, col, ``pit``: lower than all eight neighbours, off the rim."""
    return _around(cells, spec).select("row", "col", F.coalesce(F.col("inside") & (F.col("z") < F.least(*NS)), F.lit(False)).alias("pit"))


def fill_pits(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """row, col, z with every pit raised to its lowest neighbour."""
    lowest = F.least(*[F.col(n) - F.col("z") for n in NS])
    a = _around(cells, spec, finite=True)
    return a.select("row", "col", F.when(F.col("inside") & (F.col("z") < F.least(*NS)), F.col("z") + lowest).otherwise(F.col("z")).alias("z"))


def detect_flats(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """row, col, ``flat``: no neighbour is lower, but one is as low; off the rim."""
    return _around(cells, spec).select("row", "col", F.coalesce(F.col("inside") & (F.least(*NS) == F.col("z")), F.lit(False)).alias("flat"))


def flowdir_d8(cells: DataFrame, spec: GridSpec, dirmap=DIRMAP, flats: int = -1, pits: int = -2) -> DataFrame:
    """row, col, ``fdir``: the code of the steepest descent, the first of equals; ``flats`` and ``pits`` without one; null without
    data. Neighbours without data and off the grid are passed over."""
    d = distances(spec)
    slopes = [(F.col("z") - F.col(n)) / F.lit(d[k]) for k, n in enumerate(NS)]
    a = with_neighbours(cells).select("row", "col", "z", *[s.alias(f"s{k}") for k, s in enumerate(slopes)])
    most = F.greatest(*[f"s{k}" for k in range(8)])
    code = F.coalesce(*[F.when(F.col(f"s{k}") == F.col("most"), F.lit(dirmap[k])) for k in range(8)])
    a = a.withColumn("most", most)
    return a.select("row", "col", F.when(F.col("z").isNull(), None).when(F.col("most") > 0, code).when(F.col("most") == 0, flats).otherwise(pits).cast("int").alias("fdir"))


def flowdir_dinf(cells: DataFrame, spec: GridSpec, flats: float = -1.0, pits: float = -2.0) -> DataFrame:
    """row, col, ``angle`` in radians counter-clockwise from east; ``flats`` or ``pits`` without descent; null on the rim and
    without data."""
    dx, dy = spec.dx, spec.dy
    a = _around(cells, spec, finite=True)
    found = []
    for k, (e1, e2, ac, af) in enumerate(FACETS):
        along = dx if e1 in (2, 6) else dy
        r, s = facet(F.col("z"), F.col(f"n{e1}"), F.col(f"n{e2}"), along, dy if along == dx and e1 in (2, 6) else dx)
        angle = F.pmod(F.lit(float(af)) * r + F.lit(ac * math.pi / 2), F.lit(2 * math.pi))
        found.append(F.struct(s.alias("s"), F.lit(-k).alias("k"), angle.alias("a")))
    facets = a.select("row", "col", "inside", F.array(*found).alias("all"))
    best = facets.select("row", "col", "inside", F.array_max("all").alias("b"))
    return best.select("row", "col", F.when(F.col("inside"), F.when(F.col("b.s") < 0, pits).when(F.col("b.s") == 0, flats).otherwise(F.col("b.a"))).alias("angle"))


def flowdir_mfd(cells: DataFrame, spec: GridSpec, p: float = 1.0) -> DataFrame:
    """Edges (row, col, k, ``prop``) to all lower neighbours, shares of a cell adding up to 1."""
    d = distances(spec)
    drop = lambda k: F.pow(F.greatest(F.col("z") - F.col(f"n{k}"), F.lit(0.0)), F.lit(p)) / F.lit(d[k]) if p != 1 else F.greatest((F.col("z") - F.col(f"n{k}")) / F.lit(d[k]), F.lit(0.0))
    a = with_neighbours(cells).where("z is not null").select("row", "col", *[F.when(F.col(f"n{k}").isNotNull(), drop(k)).otherwise(0.0).alias(f"d{k}") for k in range(8)])
    total = sum((F.col(f"d{k}") for k in range(1, 8)), F.col("d0"))
    long = a.select("row", "col", total.alias("t"), F.posexplode(F.array(*[f"d{k}" for k in range(8)])).alias("k", "d"))
    return long.where("d > 0").select("row", "col", "k", (F.col("d") / F.col("t")).alias("prop"))


def _pick(k: Column, of) -> Column:
    return F.coalesce(*[F.when(k == j, of(j)) for j in range(8)])


def d8_edges(fdir: DataFrame, spec: GridSpec, dirmap=DIRMAP) -> DataFrame:
    """id, ``p`` (the receiver's id; null for sinks, off-grid moves and other codes), ``k`` (direction) of every cell with data."""
    row, col = F.col("row"), F.col("col")
    k = F.coalesce(*[F.when(F.col("fdir") == c, F.lit(j)) for j, c in enumerate(dirmap)])
    a = fdir.where("fdir is not null").select("row", "col", k.alias("k"))
    return a.select(cell_id(spec, row, col).alias("id"), _pick(F.col("k"), lambda j: step_id(spec, row, col, j)).alias("p"), "k", "row", "col")


def dinf_edges(angles: DataFrame, spec: GridSpec) -> DataFrame:
    """Edges (id, dst, k, ``prop``) of an angle raster: its two receivers, or one twice as a single edge, with a positive share."""
    row, col = F.col("row"), F.col("col")
    sector = F.floor(F.col("angle") / F.lit(math.pi / 4)).cast("int")
    rest = F.pmod(F.col("angle"), F.lit(math.pi / 4)) / F.lit(math.pi / 4)
    a = angles.where(f"angle >= 0 and angle < {2 * math.pi!r}").select("row", "col", sector.alias("s"), rest.alias("q"))
    ks = F.array(*[F.lit(x) for x in SECTORS])
    two = F.array(F.struct(F.element_at(ks, F.col("s") + 1).alias("k"), (1 - F.col("q")).alias("prop")), F.struct(F.element_at(ks, F.pmod(F.col("s") + 1, F.lit(8)) + 1).alias("k"), F.col("q").alias("prop")))
    a = a.select("row", "col", F.explode(two).alias("x")).select("row", "col", "x.k", "x.prop").where("prop > 0")
    return a.select(cell_id(spec, row, col).alias("id"), _pick(F.col("k"), lambda j: step_id(spec, row, col, j)).alias("dst"), "k", "prop")


def mfd_edges(props: DataFrame, spec: GridSpec) -> DataFrame:
    row, col = F.col("row"), F.col("col")
    return props.select(cell_id(spec, row, col).alias("id"), _pick(F.col("k"), lambda j: step_id(spec, row, col, j)).alias("dst"), "k", "prop")


def edges(flow: DataFrame, spec: GridSpec, routing: str, dirmap=DIRMAP) -> DataFrame:
    """(id, dst, k, prop) for any routing; moves off the grid are left out."""
    if routing == "d8":
        return d8_edges(flow, spec, dirmap).where("p is not null").select("id", F.col("p").alias("dst"), "k", F.lit(1.0).alias("prop"))
    if routing == "dinf":
        return dinf_edges(flow, spec).where("dst is not null")
    if routing == "mfd":
        return mfd_edges(flow, spec).where("dst is not null")
    raise ValueError(f"routing must be 'd8', 'dinf' or 'mfd', not {routing!r}")


def _with_flow(cells: DataFrame, flow: DataFrame, routing: str, dirmap, near: bool) -> DataFrame:
    """``cells`` with ``f0`` to ``f7``, the shares that flow to each neighbour (null without), and if ``near`` with ``n0`` to ``n7``. Cells
    and flow are brought together by one shuffle: by tile, where neighbours are found too, or by cell."""
    names = {"d8": ["fdir"], "dinf": ["angle"], "mfd": ["k", "prop"]}.get(routing)
    if names is None:
        raise ValueError(f"routing must be 'd8', 'dinf' or 'mfd', not {routing!r}")
    ground = cells.select("row", "col", "z", *[F.lit(None).cast(flow.schema[n].dataType).alias(n) for n in names], F.lit(True).alias("here"))
    routes = flow.select("row", "col", F.lit(None).cast(cells.schema["z"].dataType).alias("z"), *names, F.lit(False).alias("here"))
    both = by_tile(in_tiles(ground).unionByName(in_tile(routes))) if near else ground.unionByName(routes)
    if routing == "mfd":
        found = [F.max(F.when(F.col("k") == j, F.col("prop"))).alias(f"f{j}") for j in range(8)]
    else:
        found = [F.max(names[0]).alias("f")]
    keys, own = ([*KEYS, "row", "col"], [F.max("__own").alias("__own")]) if near else (["row", "col"], [])
    a = both.groupBy(*keys).agg(F.max("z").alias("z"), F.max("here").alias("here"), *own, *found)
    if near:
        a = around(a)
    a = a.where("here")
    rest = [c for c in a.columns if c not in ("f", "here")]
    if routing == "d8":
        return a.select(*rest, *[F.when(F.col("f") == c, F.lit(1.0)).alias(f"f{j}") for j, c in enumerate(dirmap)])
    if routing == "dinf":
        eighth = math.pi / 4
        sector = F.when((F.col("f") >= 0) & (F.col("f") < 2 * math.pi), F.floor(F.col("f") / F.lit(eighth)).cast("int"))
        a = a.select(*rest, sector.alias("s"), (F.pmod(F.col("f"), F.lit(eighth)) / F.lit(eighth)).alias("q"))
        share = lambda i: F.when(F.col("s") == i, 1 - F.col("q")).when(F.col("s") == (i - 1) % 8, F.col("q"))
        return a.select(*rest, *[share(SECTORS.index(j)).alias(f"f{j}") for j in range(8)])
    return a


def _drop() -> Column:
    """What is off the grid or without data adds nothing."""
    parts = [F.coalesce(F.col(f"f{j}") * (F.col("z") - F.col(f"n{j}")), F.lit(0.0)) for j in range(8)]
    return sum(parts[1:], parts[0])


def _distance(spec: GridSpec) -> Column:
    """A move off the grid has its length too."""
    parts = [F.coalesce(F.col(f"f{j}") * F.lit(d), F.lit(0.0)) for j, d in enumerate(distances(spec))]
    return sum(parts[1:], parts[0])


def _where_data(spec: GridSpec, value: Column, rim: bool) -> Column:
    """Null without data; 0 on the rim if ``rim``."""
    edge = on_rim(spec, F.col("row"), F.col("col")) if rim else F.lit(False)
    return F.when(F.col("z").isNull(), None).when(edge, 0.0).otherwise(value)


def cell_dh(cells: DataFrame, flow: DataFrame, spec: GridSpec, routing: str = "d8", dirmap=DIRMAP) -> DataFrame:
    """row, col, ``dh``: the drop to the receivers, weighted by their shares; 0 without any, and on the rim for D8 and D-infinity."""
    a = _with_flow(cells, flow, routing, dirmap, near=True)
    return a.select("row", "col", _where_data(spec, _drop(), routing != "mfd").alias("dh"))


def cell_distances(cells: DataFrame, flow: DataFrame, spec: GridSpec, routing: str = "d8", dirmap=DIRMAP) -> DataFrame:
    """row, col, ``dist``: the distance to the receivers, weighted by their shares; 0 without any, and on the rim for D-infinity."""
    a = _with_flow(cells, flow, routing, dirmap, near=False)
    return a.select("row", "col", _where_data(spec, _distance(spec), routing == "dinf").alias("dist"))


def cell_slopes(cells: DataFrame, flow: DataFrame, spec: GridSpec, routing: str = "d8", dirmap=DIRMAP) -> DataFrame:
    """row, col, ``slope``: drop over distance; 0 where the distance is 0."""
    a = _with_flow(cells, flow, routing, dirmap, near=True)
    a = a.select("row", "col", _where_data(spec, _drop(), routing != "mfd").alias("dh"), _where_data(spec, _distance(spec), routing == "dinf").alias("dist"))
    return a.select("row", "col", F.when(F.col("dist") == 0, 0.0).otherwise(F.col("dh") / F.col("dist")).alias("slope"))


__all__ = ["STEPS", "cell_dh", "cell_distances", "cell_slopes", "d8_edges", "detect_flats", "detect_pits", "dinf_edges", "edges", "fill_pits", "flowdir_d8", "flowdir_dinf", "flowdir_mfd", "mfd_edges"]
