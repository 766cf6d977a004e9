"""Tables for storm-water models: reaches of a channel network, what drains to each, and the sections of a model's input file.

A reach is a stretch of ``hydro.segments``, without its last cell, which the next reach begins with (or which is the outlet). Each
cell drains to the reach of the first channel cell on its way down. Sections are DataFrames of a row per element; ``write_sections``
puts them together as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions.geometry import DIRMAP, cell_id
from thalweg.operators import hydro, terrain
from thalweg.plans.loops import pinned
from thalweg.spec import GridSpec

# The columns of the sections of a storm-water model's input, and what they hold unless said otherwise.
COLUMNS = {
    "raingages": "name rain_type time_interval snow_catch data_source",
    "subcatchments": "name raingage outlet total_area pct_imperv width pct_slope curb_length snow_pack",
    "subareas": "subcatchment n_imperv n_perv s_imperv s_perv pct_zero route_to pct_routed",
    "infiltration": "subcatchment suction hyd_con imd_max",
    "junctions": "name elevation maxdepth initdepth surdepth aponded",
    "outfalls": "name invert_elevation outfall_type stage_table_ts tide_gate route_to",
    "conduits": "name inlet_node outlet_node length mannings_n inlet_offset outlet_offset init_flow max_flow",
    "xsections": "link shape geom_1 geom_2 geom_3 geom_4 barrels",
    "coordinates": "node x_coord y_coord",
}
DEFAULTS = {
    "raingages": {"name": "R0", "rain_type": "VOLUME", "time_interval": "0:05", "snow_catch": 1.0, "data_source": "TIMESERIES STEP_INPUT"},
    "subcatchments": {"raingage": "R0", "pct_imperv": 100, "curb_length": 0, "snow_pack": ""},
    "subareas": {"n_imperv": 0.01, "n_perv": 0.1, "s_imperv": 0.05, "s_perv": 0.05, "pct_zero": 25, "route_to": "OUTLET", "pct_routed": ""},
    "infiltration": {"suction": 3.0, "hyd_con": 0.5, "imd_max": 4},
    "junctions": {"maxdepth": 10, "initdepth": 0, "surdepth": 0, "aponded": 0},
    "outfalls": {"outfall_type": "FREE", "stage_table_ts": "", "tide_gate": "NO", "route_to": ""},
    "conduits": {"mannings_n": 0.05, "inlet_offset": 0, "outlet_offset": 0, "init_flow": 0, "max_flow": 0},
    "xsections": {"shape": "RECT_OPEN", "geom_3": 0, "geom_4": 0, "barrels": 1},
}
OPTIONS = {"FLOW_UNITS": "CMS", "INFILTRATION": "GREEN_AMPT", "FLOW_ROUTING": "DYNWAVE", "LINK_OFFSETS": "DEPTH", "ALLOW_PONDING": "YES", "MIN_SLOPE": "0"}
#: Square metres in a unit of subcatchments' areas.
HECTARE = 10_000.0


def reach_cells(flow: DataFrame, cells: DataFrame, mask: DataFrame, spec: GridSpec, *, dirmap=DIRMAP) -> tuple[DataFrame, DataFrame]:
    """The reaches (``number``, ``head``, ``tail``, ``cells``) of the channels of ``mask`` (row, col), and of every cell that drains to one
    its ``reach``: row, col, reach (the number). The outlet of the channels and what enters right there drain to none."""
    reaches = hydro.segments(flow, mask, spec, dirmap=dirmap)
    held = reaches.select("number", F.explode(F.slice("cells", 1, F.size("cells") - 1)).alias("channel"))
    drained = hydro.compute_hand(flow, cells, mask, spec, dirmap=dirmap)
    return reaches, pinned(drained.join(held, "channel").select("row", "col", F.col("number").alias("reach")), "reaches")


def reach_table(flow: DataFrame, cells: DataFrame, mask: DataFrame, spec: GridSpec, acc: DataFrame | None = None, *, dirmap=DIRMAP) -> DataFrame:
    """A row for each reach: reach, head, tail, ``length`` (along the flow), ``drop`` (of the elevation), ``slope`` of the channel, the
    ``area`` that drains to it (its own cells included), its ``width`` (the area over half the length), the mean ``land_slope`` along
    flow of these cells, z0 and z1 (the ends' elevations), and with ``acc`` (row, col, acc) the accumulation ``flow`` at the last cell."""
    reaches, drained = reach_cells(flow, cells, mask, spec, dirmap=dirmap)
    ident = cell_id(spec, F.col("row"), F.col("col")).alias("id")
    steps = terrain.cell_distances(cells, flow, spec, dirmap=dirmap)
    slopes = terrain.cell_slopes(cells, flow, spec, dirmap=dirmap)
    land = drained.join(slopes, ["row", "col"], "left").groupBy("reach").agg((F.count("*") * (spec.dx * spec.dy)).alias("area"), F.avg("slope").alias("land_slope"))
    along = reaches.select(F.col("number").alias("reach"), F.explode(F.slice("cells", 1, F.size("cells") - 1)).alias("id"))
    length = along.join(steps.select(ident, "dist"), "id").groupBy("reach").agg(F.sum("dist").alias("length"))
    z = cells.select(ident, F.col("z").cast("double").alias("z"))
    out = reaches.select(F.col("number").alias("reach"), "head", "tail", F.get("cells", F.size("cells") - 2).alias("last"))
    out = out.join(length, "reach").join(land, "reach", "left")
    out = out.join(z.select(F.col("id").alias("head"), F.col("z").alias("z0")), "head").join(z.select(F.col("id").alias("tail"), F.col("z").alias("z1")), "tail")
    if acc is not None:
        out = out.join(acc.select(ident.alias("last"), F.col("acc").alias("flow")), "last")
    drop = F.col("z0") - F.col("z1")
    own = ["reach", "head", "tail", "length", drop.alias("drop"), (drop / F.col("length")).alias("slope"), F.coalesce("area", F.lit(0.0)).alias("area"), (F.coalesce("area", F.lit(0.0)) / (F.col("length") / 2)).alias("width"), "land_slope", "z0", "z1"]
    return pinned(out.select(*own, *(["flow"] if acc is not None else [])), "reach_table")


def channel_dims(flow: Column, a: float = 7.2, b: float = 0.5, c: float = 0.5, f: float = 0.3, w_scale: float = 1 / 5000, d_scale: float = 1 / 5000, w_offset: float = 0.3, d_offset: float = 1.1) -> tuple[Column, Column]:
    """Width and depth of a channel as powers of its accumulation."""
    return a * F.pow(flow * w_scale, b) + w_offset, c * F.pow(flow * d_scale, f) + d_offset


def _section(name: str, rows: DataFrame, given: dict) -> DataFrame:
    values = DEFAULTS.get(name, {}) | given
    return rows.select(*[F.lit(values[c]).alias(c) if c in values else F.col(c) for c in COLUMNS[name].split()])


def sections(reaches: DataFrame, spec: GridSpec, **given: dict) -> dict[str, DataFrame]:
    """The sections of a model of ``reach_table`` (with ``flow``), by name. ``given`` has for a section values in place of DEFAULTS
    or of what is worked out, by column. A tail that is no head is an outfall. Areas are in hectares, slopes in per cent."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    ends = reaches.select(F.col("tail").alias("id"), F.col("z1").alias("elevation"))
    heads = reaches.select(F.col("head").alias("id"), F.col("z0").alias("elevation"))
    outlets = ends.distinct().join(heads.select("id"), "id", "left_anti")
    nodes = heads.distinct().select(name("J", "id").alias("name"), "elevation", "id")
    last = outlets.select(name("O", "id").alias("name"), F.col("elevation").alias("invert_elevation"), "id")
    width, depth = channel_dims(F.col("flow"))
    tails = reaches.join(outlets.select(F.col("id").alias("tail"), F.lit(True).alias("out")), "tail", "left")
    to = F.when(F.col("out"), name("O", "tail")).otherwise(name("J", "tail"))
    x, y = (F.lit(p) * (F.col("id") % spec.ncols) + F.lit(q) * F.floor(F.col("id") / spec.ncols) + F.lit(r) for p, q, r in (spec.affine[:3], spec.affine[3:]))
    one = reaches.sparkSession.range(1)
    s = name("S", "reach")
    link = name("C", "reach")
    rows = {
        "raingages": one,
        "subcatchments": reaches.select(s.alias("name"), name("J", "head").alias("outlet"), (F.col("area") / HECTARE).alias("total_area"), "width", (F.coalesce("land_slope", F.lit(0.0)) * 100).alias("pct_slope")),
        "subareas": reaches.select(s.alias("subcatchment")),
        "infiltration": reaches.select(s.alias("subcatchment")),
        "junctions": nodes,
        "outfalls": last,
        "conduits": tails.select(link.alias("name"), name("J", "head").alias("inlet_node"), to.alias("outlet_node"), "length"),
        "xsections": reaches.select(link.alias("link"), depth.alias("geom_1"), width.alias("geom_2")),
        "coordinates": nodes.select("name", "id").unionByName(last.select("name", "id")).select(F.col("name").alias("node"), x.alias("x_coord"), y.alias("y_coord")),
    }
    return {k: _section(k, v, given.get(k, {})) for k, v in rows.items()}


def write_sections(tables: dict[str, DataFrame], path: str, *, title: str = "", options: dict[str, str] | None = None, series: list[tuple[str, float]] | None = None) -> None:
    """Write a model's input as text to the folder ``path``: its parts, one after the other, are the file. ``series`` has times and
    values of the rain. Rows of a section come in the order of their first column."""
    spark = next(iter(tables.values())).sparkSession
    fixed = [("TITLE", [title]), ("OPTIONS", [f"{k} {v}" for k, v in (OPTIONS | (options or {})).items()])]
    late = [("TIMESERIES", [f"STEP_INPUT {t} {v}" for t, v in series or [("0:00", 1.5), ("0:05", 0.0)]])]
    names = [*(n for n, _ in fixed), *(t.upper() for t in tables), *(n for n, _ in late)]
    lines = [(names.index(n), 1, f"{k:06d}", line) for n, rows in (*fixed, *late) for k, line in enumerate(rows)]
    lines += [(i, 0, "", f"[{n}]") for i, n in enumerate(names)] + [(i, 2, "", "") for i in range(len(names))]
    parts = [spark.createDataFrame(lines, "s int, p int, k string, value string")]
    for name, df in tables.items():
        text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
        parts.append(df.select(F.lit(names.index(name.upper())).alias("s"), F.lit(1).alias("p"), F.col(df.columns[0]).cast("string").alias("k"), F.rtrim(text).alias("value")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reduce(DataFrame.unionByName, parts).repartitionByRange(n, "s", "p", "k").sortWithinPartitions("s", "p", "k").select("value").write.text(path)
