"""A query per operator over rasters made of the ``embeddings`` table (a row per vector), and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg import flood_queries
from thalweg.functions.crs import transform
from thalweg.grid import Grid, Raster
from thalweg.operators import condition, derived, hydro, stormwater, terrain, vector, view
from thalweg.plans.loops import pinned, scratch
from thalweg.sources import ascii as ascii_grid
from thalweg.sources import geojson, geotiff
from thalweg.spec import GridSpec

Query = Callable[[SparkSession, str], DataFrame]
#: Elevations by raster: rough; with a long slope; in steps with flats.
RASTERS = {"noise": "v", "ramp": "v + 0.3 * row", "steps": "floor(8 * v)"}


def raster(spark: SparkSession, sf_dir: str, name: str = "noise") -> tuple[DataFrame, GridSpec]:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n, width = t.agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).head()
    cells = t.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).selectExpr("row", "col", "cast(v as double) as v")
    return cells.selectExpr("row", "col", f"cast({RASTERS[name]} as double) as z"), GridSpec(n, width, (1.0, 0.0, 0.0, 0.0, -1.0, float(n)))


def _flow(spark: SparkSession, sf_dir: str, name: str, routing: str = "d8"):
    cells, spec = raster(spark, sf_dir, name)
    flow = {"d8": terrain.flowdir_d8, "dinf": terrain.flowdir_dinf, "mfd": terrain.flowdir_mfd}[routing](cells, spec)
    return cells, spec, pinned(flow, "flow")


def _r(c: str, name: str | None = None):
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(name or c)


def _weights(cells: DataFrame) -> DataFrame:
    return cells.select("row", "col", (1 + F.pmod(F.col("row") + F.col("col"), F.lit(4))).cast("double").alias("w"))


def _efficiency(cells: DataFrame, width: int) -> DataFrame:
    e = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)]), (F.pmod(F.col("row") * width + F.col("col"), F.lit(4)) + 1).cast("int"))
    return cells.select("row", "col", e.alias("e"))


def _mask(acc: DataFrame, over: float) -> DataFrame:
    return acc.where(F.col("acc") > over).select("row", "col")


def _top(acc: DataFrame, spec: GridSpec) -> tuple[int, int]:
    """(col, row) of the cell off the rim with the largest accumulation; of equals the first."""
    inner = (F.col("row") > 0) & (F.col("col") > 0) & (F.col("row") < spec.nrows - 1) & (F.col("col") < spec.ncols - 1)
    r = acc.where(inner).orderBy(F.col("acc").desc(), "row", "col").select("row", "col").head()
    return r[1], r[0]


def _local(op: str, name: str, routing: str | None = None) -> Query:
    def run(spark, sf_dir):
        if routing:
            cells, spec, flow = _flow(spark, sf_dir, name, routing)
            out = getattr(terrain, op)(cells, flow, spec, routing)
        else:
            cells, spec = raster(spark, sf_dir, name)
            out = getattr(terrain, op)(cells, spec)
        return out.select(*[_r(c) if t == "double" else c for c, t in out.dtypes])

    return run


def _accumulation(name: str, routing: str, extra: str = "") -> Query:
    def run(spark, sf_dir):
        cells, spec, flow = _flow(spark, sf_dir, name, routing)
        kw = {"weighted": {"weights": _weights(cells)}, "efficiency": {"efficiency": _efficiency(cells, spec.ncols)}}.get(extra, {})
        return hydro.accumulation(flow, spec, routing, **kw).select("row", "col", _r("acc"))

    return run


def top_accumulation(spark, sf_dir):
    cells, spec, flow = _flow(spark, sf_dir, "ramp")
    return hydro.accumulation(flow, spec).orderBy(F.col("acc").desc(), "row", "col").limit(10)


def _poured(f) -> Query:
    def run(spark, sf_dir):
        cells, spec, flow = _flow(spark, sf_dir, "noise")
        acc = pinned(hydro.accumulation(flow, spec), "acc")
        return f(cells, spec, flow, *_top(acc, spec))

    return run


catchment_d8 = _poured(lambda cells, spec, flow, x, y: hydro.catchment(x, y, flow, spec, xytype="index"))
distance_to_outlet_d8 = _poured(lambda cells, spec, flow, x, y: hydro.distance_to_outlet(x, y, flow, spec, xytype="index").select("row", "col", _r("dist")))


def width_function(spark, sf_dir):
    return distance_to_outlet_d8(spark, sf_dir).groupBy("dist").agg(F.count("*").alias("n"))


def distance_to_ridge_d8(spark, sf_dir):
    cells, spec, flow = _flow(spark, sf_dir, "noise")
    return hydro.distance_to_ridge(flow, spec, weights=_weights(cells)).select("row", "col", _r("dist"))


def _routed(f, routing: str) -> Query:
    def run(spark, sf_dir):
        cells, spec, flow = _flow(spark, sf_dir, "noise", routing)
        return f(spec, flow)

    return run


def _routed_pour(f, routing: str) -> Query:
    """``f`` at the cell off the rim with the largest accumulation of the same routing."""

    def run(spark, sf_dir):
        cells, spec, flow = _flow(spark, sf_dir, "noise", routing)
        acc = pinned(hydro.accumulation(flow, spec, routing).select("row", "col", _r("acc")), "acc")
        return f(spec, flow, *_top(acc, spec))

    return run


def _hand(spark, sf_dir, name="noise", over=4, routing="d8"):
    cells, spec, flow = _flow(spark, sf_dir, name)
    acc = pinned(hydro.accumulation(flow, spec), "acc")
    used = flow if routing == "d8" else _flow(spark, sf_dir, name, routing)[2]
    return hydro.compute_hand(used, cells, _mask(acc, over), spec, routing)


def hand_d8(spark, sf_dir):
    return _hand(spark, sf_dir).select("row", "col", "channel", _r("hand"))


def inundation(spark, sf_dir):
    """Depth of water 0.5 above the drainage."""
    return _hand(spark, sf_dir).where("hand < 0.5").select("row", "col", F.round(0.5 - F.col("hand"), 6).alias("depth"))


def _network(f) -> Query:
    def run(spark, sf_dir):
        cells, spec, flow = _flow(spark, sf_dir, "ramp")
        acc = pinned(hydro.accumulation(flow, spec), "acc")
        return f(flow, _mask(acc, 50), spec)

    return run


def _filled(spark, sf_dir):
    cells, spec = raster(spark, sf_dir, "steps")
    return condition.fill_depressions(cells, spec)


def _view(interpolation: str) -> Query:
    def run(spark, sf_dir):
        cells, spec = raster(spark, sf_dir)
        target = GridSpec(spec.nrows // 2, spec.ncols // 2, (2.0, 0.0, 0.25, 0.0, -2.0, spec.affine[5] - 0.25))
        return view.view(cells, spec, target, interpolation).select("row", "col", _r("z"))

    return run


def clip_to(spark, sf_dir):
    cells, spec = raster(spark, sf_dir)
    high = cells.select("row", "col", F.when(F.col("z") > 0.35, F.col("z")).alias("z"))
    return view.clip_to(high, spec)[0].where("z is not null")


def _points(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return t.selectExpr("c_custkey as pid", "cast(c_custkey % 64 as double) + 0.4 as x", "cast(c_custkey % 500 as double) + 0.4 as y")


def nearest_cell(spark, sf_dir):
    return view.nearest_cell(_points(spark, sf_dir), raster(spark, sf_dir)[1]).select("pid", "col", "row")


def snap_to_mask(spark, sf_dir):
    cells, spec = raster(spark, sf_dir)
    return view.snap_to_mask(cells.where("z > 0.3").select("row", "col"), _points(spark, sf_dir), spec).select("pid", "sx", "sy", _r("dist"))


def rasterize(spark, sf_dir):
    _, spec = raster(spark, sf_dir)
    t = spark.read.parquet(f"{sf_dir}/nation.parquet")
    p = lambda x, y: F.struct((F.col("n_nationkey") * 2 + x).cast("double").alias("x"), (F.col("n_nationkey") * 11 + y).cast("double").alias("y"))
    shapes = t.select(F.col("n_nationkey").alias("sid"), F.array(p(1.25, 3.25), p(11.25, 8.25), p(6.25, 27.25)).alias("ring"), F.col("n_regionkey").cast("double").alias("value"))
    return view.rasterize(shapes, spec, fill=-1.0)


def to_crs(spark, sf_dir):
    cells, spec = raster(spark, sf_dir)
    spec = GridSpec(spec.nrows, spec.ncols, (0.01, 0.0, -97.0, 0.0, -0.01, 33.0))
    return view.to_crs(cells, spec, "EPSG:3857")[0].where("z is not null")


def polygonize(spark, sf_dir):
    cells, spec = raster(spark, sf_dir, "steps")
    return view.polygonize(cells, spec).select("label", "value", "n_cells", F.size("edges").alias("n_edges"))


def to_crs_utm(spark, sf_dir):
    cells, spec = raster(spark, sf_dir)
    spec = GridSpec(spec.nrows, spec.ncols, (0.01, 0.0, -97.0, 0.0, -0.01, 33.0))
    return view.to_crs(cells, spec, "EPSG:32614")[0].where("z is not null")


def _burn(sigma: float | None) -> Query:
    """Elevations lowered by 2 along the channels."""

    def run(spark, sf_dir):
        cells, spec, flow = _flow(spark, sf_dir, "noise")
        return derived.burn(cells, _mask(hydro.accumulation(flow, spec), 4), 2.0, spec, sigma).select("row", "col", _r("z"))

    return run


def accumulated_angle(spark, sf_dir):
    cells, spec, flow = _flow(spark, sf_dir, "noise")
    return derived.accumulated_angle(flow, spec).select("row", "col", _r("x"), _r("y"), _r("angle"))


def hand_classes(spark, sf_dir):
    """Cells by class of height above the drainage."""
    return _hand(spark, sf_dir).groupBy(derived.class_of("hand", [0.05, 0.15, 0.25, 0.35, 0.45]).alias("class")).agg(F.count("*").alias("n"))


def weighted_distance_to_outlet(spark, sf_dir):
    """Distances where water in channels travels ten times as fast."""
    cells, spec, flow = _flow(spark, sf_dir, "noise")
    acc = pinned(hydro.accumulation(flow, spec), "acc")
    w = acc.select("row", "col", F.when(F.col("acc") >= 4, 0.1).otherwise(1.0).alias("w"))
    return hydro.distance_to_outlet(*_top(acc, spec), flow, spec, weights=w, xytype="index").select("row", "col", _r("dist"))


def weighted_width_function(spark, sf_dir):
    return derived.histogram(pinned(weighted_distance_to_outlet(spark, sf_dir), "dist"), "dist", 60).select("bin", "n")


def land_cover_overlay(spark, sf_dir):
    """Flooded cells and mean depth by kind of cover, which is on a coarser, shifted grid."""
    cells, spec, flow = _flow(spark, sf_dir, "noise")
    coarse = GridSpec(spec.nrows // 2, spec.ncols // 2, (2.0, 0.0, 0.25, 0.0, -2.0, spec.affine[5] - 0.25))
    cover = cells.where("row % 2 = 0 and col % 2 = 0").selectExpr("row div 2 as row", "cast(col div 2 as int) as col", "cast(floor(4 * z) as int) as z")
    return derived.overlay(inundation(spark, sf_dir), view.view(cover, coarse, spec), "depth").select("kind", "n", _r("mean"))


def polygons(spark, sf_dir):
    cells, spec = raster(spark, sf_dir, "steps")
    return vector.polygons(cells, spec).select("label", "value", "n_cells", vector.area_of().alias("area"))


def polygons_round_trip(spark, sf_dir):
    """Regions as polygons in a GeoJSON file, read back and made cells again."""
    cells, spec = raster(spark, sf_dir, "steps")
    path = scratch(spark, "geojson")
    geojson.to_geojson(vector.polygons(cells, spec).select(F.col("label").alias("sid"), "value", "geometry"), path)
    shapes = geojson.read_geojson(spark, path, "sid long, value double")
    return view.rasterize(shapes.select("sid", "value", geojson.rings().alias("rings")), spec, fill=-1e9)


def coordinates(spark, sf_dir):
    cells, spec = raster(spark, sf_dir)
    turned = replace(spec, affine=(2.0, 0.25, 10.0, -0.5, -2.0, 7.0))
    return view.coordinates(cells, turned).select("row", "col", "x", "y")


def inundation_varying(spark, sf_dir):
    """Depth of water where each channel cell is 0.75 * acc ** 0.2 deep."""
    cells, spec, flow = _flow(spark, sf_dir, "noise")
    acc = pinned(hydro.accumulation(flow, spec), "acc")
    hand = hydro.compute_hand(flow, cells, _mask(acc, 4), spec)
    depth = acc.select("row", "col", (F.pow("acc", F.lit(0.2)) * 0.75).alias("depth"))
    return hydro.inundation(hand, spec, depth).select("row", "col", _r("depth"))


def ascii_round_trip(spark, sf_dir):
    """The raster, written as an ASCII grid and read back."""
    cells, spec = raster(spark, sf_dir)
    path = scratch(spark, "ascii")
    ascii_grid.to_ascii(cells, spec, path)
    return ascii_grid.read_ascii(spark, path)[0]


def raster_round_trip(spark, sf_dir):
    """The raster, written as a GeoTIFF and read back."""
    cells, spec = raster(spark, sf_dir)
    path = scratch(spark, "geotiff")
    geotiff.to_raster(cells, replace(spec, nodata=-9999.0), path)
    return geotiff.read_raster(spark, path)[0]


def storm_water_reaches(spark, sf_dir):
    """Reaches of channels with what drains to each."""
    cells, spec, flow = _flow(spark, sf_dir, "ramp")
    acc = pinned(hydro.accumulation(flow, spec), "acc")
    t = stormwater.reach_table(flow, cells, _mask(acc, 50), spec, acc)
    return t.select("reach", "head", "tail", *[_r(c) for c in ("length", "drop", "slope", "area", "width", "land_slope", "flow")])


def projected_points(spark, sf_dir):
    """Points in Albers' and Lambert's conics and a UTM zone."""
    lon, lat = (-125 + F.pmod("c_custkey", F.lit(580)) / 10).cast("double"), (25 + F.pmod("c_custkey", F.lit(240)) / 10).cast("double")
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("pid"), lon.alias("lon"), lat.alias("lat"))
    out = {}
    for name, crs in (("albers", "EPSG:5070"), ("lambert", "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=23 +lon_0=-96 +datum=NAD83"), ("utm", "EPSG:32614")):
        lon = F.col("lon") if name != "utm" else (F.col("lon") - 99 + 96) / 8 - 87
        x, y = transform(lon, F.col("lat"), "EPSG:4326", crs)
        out |= {f"{name}_x": F.round(x, 3) + F.lit(0.0), f"{name}_y": F.round(y, 3) + F.lit(0.0)}
    return points.select("pid", *[c.alias(k) for k, c in out.items()])


def masked_mosaic(spark, sf_dir):
    """The raster, written as a mosaic of GeoTIFFs by the tasks and read back within a polygon; blocks outside aren't read."""
    cells, spec = raster(spark, sf_dir)
    folder, n = scratch(spark, "mosaic"), spec.nrows
    geotiff.to_mosaic(cells, replace(spec, nodata=-9999.0), folder, side=128, block=32)
    shape = {"type": "Polygon", "coordinates": [[(5.3, 0.1 * n + 0.3), (60.7, 0.45 * n + 0.7), (21.3, 0.9 * n + 0.3)]]}
    return geotiff.read_raster(spark, f"{folder}/*.tif", mask_geometry=shape)[0].where("z is not null")


def grid_clipped_accumulation(spark, sf_dir):
    """Accumulation on the window of a catchment, only within it."""
    cells, spec = raster(spark, sf_dir)
    grid = Grid(spark, spec)
    fdir = grid.flowdir(Raster(cells, spec))
    x, y = _top(grid.accumulation(fdir).cells, spec)
    whole, held = grid.spec, grid.catchment(x, y, fdir, xytype="index")
    grid.clip_to(replace(held, cells=pinned(held.cells, "catchment")))
    col, row = whole.nearest_cell(*grid.spec.xy(0, 0))
    acc = grid.accumulation(fdir).cells.join(grid.mask, ["row", "col"], "left_semi")
    return acc.select((F.col("row") + row).alias("row"), (F.col("col") + col).alias("col"), _r("acc"))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"top_accumulation": top_accumulation}
    found |= {op: _local(op, name) for op, name in (("detect_pits", "noise"), ("fill_pits", "noise"), ("detect_flats", "steps"), ("flowdir_d8", "steps"), ("flowdir_dinf", "noise"), ("flowdir_mfd", "noise"))}
    found |= {f"{op}_{r}": _local(op, "noise", r) for op in ("cell_dh", "cell_distances", "cell_slopes") for r in ("d8", "dinf", "mfd")}
    found |= {"accumulation_d8": _accumulation("noise", "d8"), "accumulation_d8_weighted": _accumulation("noise", "d8", "weighted"), "accumulation_d8_efficiency": _accumulation("noise", "d8", "efficiency")}
    found |= {"accumulation_dinf": _accumulation("noise", "dinf"), "accumulation_mfd": _accumulation("noise", "mfd")}
    found |= {"catchment_d8": catchment_d8, "distance_to_outlet_d8": distance_to_outlet_d8, "width_function": width_function, "distance_to_ridge_d8": distance_to_ridge_d8, "hand_d8": hand_d8, "inundation": inundation}
    for r in ("dinf", "mfd"):
        found |= {
            f"catchment_{r}": _routed_pour(lambda s, f, x, y, r=r: hydro.catchment(x, y, f, s, r, xytype="index"), r),
            f"distance_to_outlet_{r}": _routed_pour(lambda s, f, x, y, r=r: hydro.distance_to_outlet(x, y, f, s, r, xytype="index").select("row", "col", _r("dist")), r),
            f"distance_to_ridge_{r}": _routed(lambda s, f, r=r: hydro.distance_to_ridge(f, s, r).select("row", "col", _r("dist")), r),
            f"hand_{r}": lambda spark, d, r=r: _hand(spark, d, routing=r).select("row", "col", "channel", _r("hand")),
        }
    found |= {"stream_order": _network(hydro.stream_order), "extract_river_network": _network(hydro.extract_river_network), "extract_profiles": _network(lambda *a: hydro.extract_profiles(*a).select("number", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("cells"), "next"))}
    found |= {"fill_depressions": _filled, "detect_depressions": lambda s, d: condition.detect_depressions(*raster(s, d, "steps")), "resolve_flats": lambda s, d: condition.resolve_flats(*raster(s, d, "steps")).select("row", "col", _r("z"))}
    found |= {"view_nearest": _view("nearest"), "view_linear": _view("linear"), "clip_to": clip_to, "nearest_cell": nearest_cell, "snap_to_mask": snap_to_mask, "rasterize": rasterize, "polygonize": polygonize, "to_crs": to_crs, "to_crs_utm": to_crs_utm, "burn": _burn(None), "burn_blurred": _burn(2.5)}
    found |= {"inundation_varying": inundation_varying, "ascii_round_trip": ascii_round_trip, "raster_round_trip": raster_round_trip, "masked_mosaic": masked_mosaic, "projected_points": projected_points, "storm_water_reaches": storm_water_reaches, "grid_clipped_accumulation": grid_clipped_accumulation}
    found |= {"accumulated_angle": accumulated_angle, "hand_classes": hand_classes, "weighted_distance_to_outlet": weighted_distance_to_outlet, "weighted_width_function": weighted_width_function, "land_cover_overlay": land_cover_overlay}
    found |= {"polygons": polygons, "polygons_round_trip": polygons_round_trip, "coordinates": coordinates}
    return found | flood_queries.queries()


#: Rounds of the SQL that ends by count.
ROUNDS = 120

# SQL of the same definitions, with tables of its own.
# Steps (row, col) and codes from N clockwise; directions of the sectors from east counter-clockwise; facets (first
# and second neighbour, quarter turns added, sign of the angle).
_STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
_CODES = (64, 128, 1, 2, 4, 8, 16, 32)
_SECTORS = (2, 1, 0, 7, 6, 5, 4, 3)
_FACETS = ((2, 1, 0, 1), (0, 1, 1, -1), (0, 7, 1, 1), (6, 7, 2, -1), (6, 5, 2, 1), (4, 5, 3, -1), (4, 3, 3, 1), (2, 3, 4, -1))


def _cells(name: str) -> str:
    return f"cells0 AS (SELECT vec_id AS row, unnest(range(len(embedding)))::INT AS col, unnest(embedding)::DOUBLE AS v FROM embeddings), cells AS (SELECT row, col, ({RASTERS[name]})::DOUBLE AS z FROM cells0), g AS (SELECT max(row) AS mr, max(col) AS mc, max(z) + 1 AS top FROM cells)"


_OFFS = "offs(k, dr, dc, dist, code) AS (VALUES " + ", ".join(f"({k}, {r}, {c}, sqrt({abs(r) + abs(c)}::DOUBLE), {_CODES[k]})" for k, (r, c) in enumerate(_STEPS)) + ")"
_NB = "nb AS (SELECT c.row, c.col, c.z, o.k, o.dist, o.code, n.row AS nr, n.col AS nc, n.z AS zn FROM cells c CROSS JOIN offs o JOIN cells n ON n.row = c.row + o.dr AND n.col = c.col + o.dc)"
_INNER = "row > 0 AND col > 0 AND row < (SELECT mr FROM g) AND col < (SELECT mc FROM g)"
_LOW = f"low AS (SELECT row, col, any_value(z) AS z, min(zn) AS lo, min(zn - z) AS ld, bool_or(true) AS b FROM nb GROUP BY row, col), inn AS (SELECT *, ({_INNER}) AS inside FROM low)"
_D8 = "ranked AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY (z - zn) / dist DESC, k) AS rn FROM nb), d8 AS (SELECT row, col, z, zn, nr, nc, dist, CASE WHEN z > zn THEN code WHEN z = zn THEN -1 ELSE -2 END AS fdir, z > zn AS flows FROM ranked WHERE rn = 1)"
_MFD = "m0 AS (SELECT *, greatest((z - zn) / dist, 0) AS d FROM nb), mfd AS (SELECT row, col, k, dist, z, zn, nr, nc, d / sum(d) OVER (PARTITION BY row, col) AS prop FROM m0 QUALIFY d > 0)"


def _with(name: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_cells(name)}, {_OFFS}, {_NB}, " + ", ".join(parts) + " "


def _dinf_sql() -> str:
    wide = "wide AS (SELECT row, col, any_value(z) AS z, " + ", ".join(f"max(zn) FILTER (k = {k}) AS n{k}" for k in range(8)) + " FROM nb GROUP BY row, col HAVING count(*) = 8)"
    facets = " UNION ALL ".join(f"SELECT row, col, {k} AS f, {ac} AS ac, {af} AS af, z - n{e1} AS s1, n{e1} - n{e2} AS s2, z - n{e2} AS s3 FROM wide" for k, (e1, e2, ac, af) in enumerate(_FACETS))
    lim = "(pi() / 4)"
    fs = f"f0 AS ({facets}), f1 AS (SELECT *, atan2(s2, s1) AS r, sqrt(s1 * s1 + s2 * s2) AS h FROM f0), f2 AS (SELECT row, col, f, ac, af, CASE WHEN r < 0 THEN 0 WHEN r > {lim} THEN {lim} ELSE r END AS r, CASE WHEN r < 0 THEN s1 WHEN r > {lim} THEN s3 / sqrt(2) ELSE h END AS s FROM f1), f2x AS (SELECT *, af * r + ac * (pi() / 2) AS x FROM f2)"
    best = "f3 AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY s DESC, f) AS rn FROM f2x), dinf AS (SELECT row, col, CASE WHEN s < 0 THEN -2.0 WHEN s = 0 THEN -1.0 ELSE (x % (2 * pi()) + CASE WHEN x % (2 * pi()) < 0 THEN 2 * pi() ELSE 0 END) % (2 * pi()) END AS angle FROM f3 WHERE rn = 1)"
    sect = "sect(s, k) AS (VALUES " + ", ".join(f"({s}, {k})" for s, k in enumerate(_SECTORS)) + ")"
    split = "a AS (SELECT row, col, floor(angle / (pi() / 4))::INT AS s, (angle % (pi() / 4)) / (pi() / 4) AS q FROM dinf WHERE angle >= 0), e0 AS (SELECT row, col, s, 1 - q AS prop FROM a UNION ALL SELECT row, col, (s + 1) % 8, q FROM a), de AS (SELECT row, col, k, prop FROM e0 JOIN sect USING (s) WHERE prop > 0)"
    return ", ".join([wide, fs, best, sect, split])


_PROJECTED = """
WITH pts AS (SELECT c_custkey AS pid, radians(-125 + (c_custkey % 580) / 10.0::DOUBLE) AS lon, radians(25 + (c_custkey % 240) / 10.0::DOUBLE) AS lat,
                    radians((-125 + (c_custkey % 580) / 10.0::DOUBLE - 3) / 8 - 87 + 99) AS turn FROM customer),
k AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257222101::DOUBLE AS f, f * (2 - f) AS e2, sqrt(e2) AS e),
par AS (SELECT u.*, sin(phi) AS s, cos(phi) / sqrt(1 - e2 * sin(phi) ** 2) AS m, tan(pi() / 4 - phi / 2) / ((1 - e * sin(phi)) / (1 + e * sin(phi))) ** (e / 2) AS t,
              (1 - e2) * (sin(phi) / (1 - e2 * sin(phi) ** 2) - ln((1 - e * sin(phi)) / (1 + e * sin(phi))) / (2 * e)) AS q
       FROM (SELECT unnest(['0', 'a1', 'a2', 'l1', 'l2']) AS name, radians(unnest([23.0, 29.5, 45.5, 33.0, 45.0])::DOUBLE) AS phi UNION ALL SELECT pid::VARCHAR || 'p', lat FROM pts) u, k),
fixed AS (SELECT max(m) FILTER (name = 'a1') AS ma, max(m) FILTER (name = 'a2') AS mb, max(q) FILTER (name = 'a1') AS qa, max(q) FILTER (name = 'a2') AS qb, max(q) FILTER (name = '0') AS q0,
                 max(m) FILTER (name = 'l1') AS ml, max(m) FILTER (name = 'l2') AS mm, max(t) FILTER (name = 'l1') AS tl, max(t) FILTER (name = 'l2') AS tm, max(t) FILTER (name = '0') AS t0 FROM par),
cone AS (SELECT *, (ma ** 2 - mb ** 2) / (qb - qa) AS na, ln(ml / mm) / ln(tl / tm) AS nl FROM fixed),
cone2 AS (SELECT *, ma ** 2 + na * qa AS ca, ml / (nl * tl ** nl) AS fl FROM cone),
conics AS (SELECT pid, a * sqrt(ca - na * q) / na AS ra, a * sqrt(ca - na * q0) / na AS r0, na * (lon - radians(-96)) AS ta, a * fl * t ** nl AS rl, a * fl * t0 ** nl AS l0, nl * (lon - radians(-96)) AS tl
           FROM pts JOIN par ON par.name = pid::VARCHAR || 'p' CROSS JOIN cone2 CROSS JOIN k),
w AS (SELECT 1 / 298.257223563::DOUBLE AS f, f / (2 - f) AS n, 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) * 0.9996 AS r, 2 * sqrt(n) / (1 + n) AS e),
z AS (SELECT pid, sinh(atanh(sin(lat)) - e * atanh(e * sin(lat))) AS t, turn FROM pts, w),
z2 AS (SELECT pid, atan(t / cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM z),
utm AS (SELECT pid, 500000 + r * (eta + (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16) * cos(2 * xi) * sinh(2 * eta) + (13 * n ** 2 / 48 - 3 * n ** 3 / 5) * cos(4 * xi) * sinh(4 * eta) + 61 * n ** 3 / 240 * cos(6 * xi) * sinh(6 * eta)) AS ux,
               r * (xi + (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16) * sin(2 * xi) * cosh(2 * eta) + (13 * n ** 2 / 48 - 3 * n ** 3 / 5) * sin(4 * xi) * cosh(4 * eta) + 61 * n ** 3 / 240 * sin(6 * xi) * cosh(6 * eta)) AS uy FROM z2, w)
SELECT pid, round(ra * sin(ta), 3) + 0.0 AS albers_x, round(r0 - ra * cos(ta), 3) + 0.0 AS albers_y, round(rl * sin(tl), 3) + 0.0 AS lambert_x, round(l0 - rl * cos(tl), 3) + 0.0 AS lambert_y,
       round(ux, 3) + 0.0 AS utm_x, round(uy, 3) + 0.0 AS utm_y
FROM conics JOIN utm USING (pid)
"""


def oracle_sql() -> dict[str, str]:
    out = {}
    r6 = lambda x: f"round({x}, 6) + 0.0"
    out["detect_pits"] = _with("noise", _LOW) + "SELECT row, col, inside AND z < lo AS pit FROM inn"
    out["fill_pits"] = _with("noise", _LOW) + f"SELECT row, col, {r6('CASE WHEN inside AND z < lo THEN z + ld ELSE z END')} AS z FROM inn"
    out["detect_flats"] = _with("steps", _LOW) + "SELECT row, col, inside AND z = lo AS flat FROM inn"
    out["flowdir_d8"] = _with("steps", _D8) + "SELECT row, col, fdir::INT AS fdir FROM d8"
    out["flowdir_dinf"] = _with("noise", _dinf_sql()) + f"SELECT c.row, c.col, {r6('angle')} AS angle FROM cells c LEFT JOIN dinf USING (row, col)"
    out["flowdir_mfd"] = _with("noise", _MFD) + f"SELECT row, col, k, {r6('prop')} AS prop FROM mfd"
    rim = f"NOT ({_INNER})"
    d8l = _with("noise", _D8, f"l AS (SELECT row, col, CASE WHEN {rim} OR NOT flows THEN 0 ELSE z - zn END AS dh, CASE WHEN flows THEN dist ELSE 0 END AS dist FROM d8)")
    mfl = _with("noise", _MFD, "m AS (SELECT row, col, sum(prop * (z - zn)) AS dh, sum(prop * dist) AS dist FROM mfd GROUP BY row, col), l AS (SELECT row, col, coalesce(dh, 0) AS dh, coalesce(dist, 0) AS dist FROM cells LEFT JOIN m USING (row, col))")
    dil = _with("noise", _dinf_sql(), f"m AS (SELECT row, col, sum(prop * (z - zn)) AS dh, sum(prop * dist) AS dist FROM de JOIN nb USING (row, col, k) GROUP BY row, col), l AS (SELECT row, col, CASE WHEN {rim} THEN 0 ELSE coalesce(dh, 0) END AS dh, CASE WHEN {rim} THEN 0 ELSE coalesce(dist, 0) END AS dist FROM cells LEFT JOIN m USING (row, col))")
    for r, q in (("d8", d8l), ("mfd", mfl), ("dinf", dil)):
        out[f"cell_dh_{r}"] = q + f"SELECT row, col, {r6('dh::DOUBLE')} AS dh FROM l"
        out[f"cell_distances_{r}"] = q + f"SELECT row, col, {r6('dist::DOUBLE')} AS dist FROM l"
        out[f"cell_slopes_{r}"] = q + f"SELECT row, col, {r6('CASE WHEN dist = 0 THEN 0 ELSE dh / dist END')} AS slope FROM l"
    w, e = "(1 + (row + col) % 4)::DOUBLE", "([0.0, 0.25, 0.5, 1.0])[((row * 64 + col) % 4 + 1)::INT]::DOUBLE"
    walk = lambda amount, eff: f"up(row, col, sr, sc, m) AS (SELECT row, col, row, col, 1.0::DOUBLE FROM cells UNION ALL SELECT d.nr, d.nc, u.sr, u.sc, u.m * {eff} FROM up u JOIN d8 d ON d.row = u.row AND d.col = u.col AND d.flows), am AS (SELECT row AS sr, col AS sc, {amount} AS w FROM cells), acc AS (SELECT row, col, sum(m * w) AS acc FROM up JOIN am USING (sr, sc) GROUP BY row, col)"
    ueff = e.replace("row", "u.row").replace("col", "u.col")
    out["accumulation_d8"] = _with("noise", _D8, walk("1.0::DOUBLE", "1.0"), recursive=True) + "SELECT row, col, acc FROM acc"
    out["accumulation_d8_weighted"] = _with("noise", _D8, walk(w, "1.0"), recursive=True) + "SELECT row, col, acc FROM acc"
    out["accumulation_d8_efficiency"] = _with("noise", _D8, walk("1.0::DOUBLE", ueff), recursive=True) + f"SELECT row, col, {r6('acc')} AS acc FROM acc"
    out["top_accumulation"] = _with("ramp", _D8, walk("1.0::DOUBLE", "1.0"), recursive=True) + "SELECT row, col, acc FROM acc ORDER BY acc DESC, row, col LIMIT 10"
    acc = walk("1.0::DOUBLE", "1.0")
    pour = f"pour AS (SELECT row AS pr, col AS pc FROM acc WHERE {_INNER} ORDER BY acc DESC, row, col LIMIT 1)"
    out["catchment_d8"] = _with("noise", _D8, acc, pour, recursive=True) + f"SELECT DISTINCT u.sr AS row, u.sc AS col FROM up u JOIN pour ON u.row = pr AND u.col = pc WHERE NOT (sr = 0 OR sc = 0 OR sr = (SELECT mr FROM g) OR sc = (SELECT mc FROM g))"
    dist = "dist(row, col, dist) AS (SELECT pr, pc, 0.0::DOUBLE FROM pour UNION ALL SELECT d.row, d.col, t.dist + 1 FROM dist t JOIN d8 d ON d.nr = t.row AND d.nc = t.col AND d.flows)"
    out["grid_clipped_accumulation"] = out["catchment_d8"].replace("SELECT DISTINCT u.sr AS row, u.sc AS col FROM", "SELECT a.row, a.col, a.acc FROM acc a JOIN (SELECT DISTINCT u.sr AS row, u.sc AS col FROM") + ") c USING (row, col)"
    out["distance_to_outlet_d8"] = _with("noise", _D8, acc, pour, dist, recursive=True) + "SELECT row, col, dist FROM dist"
    out["width_function"] = _with("noise", _D8, acc, pour, dist, recursive=True) + "SELECT dist, count(*) AS n FROM dist GROUP BY dist"
    out["distance_to_ridge_d8"] = _with("noise", _D8, "up(row, col, m) AS (SELECT row, col, 0.0::DOUBLE FROM cells UNION ALL SELECT d.nr, d.nc, max(u.m + (1 + (d.nr + d.nc) % 4)) FROM up u JOIN d8 d ON d.row = u.row AND d.col = u.col AND d.flows GROUP BY d.nr, d.nc)", recursive=True) + "SELECT row, col, max(m) AS dist FROM up GROUP BY row, col"
    hand = f"ch AS (SELECT row, col FROM acc WHERE acc > 4 AND {_INNER}), hd(row, col, cr, cc) AS (SELECT row, col, row, col FROM ch UNION ALL SELECT d.row, d.col, h.cr, h.cc FROM hd h JOIN d8 d ON d.nr = h.row AND d.nc = h.col AND d.flows WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.row = d.row AND ch.col = d.col) AND NOT (d.row = 0 OR d.col = 0 OR d.row = (SELECT mr FROM g) OR d.col = (SELECT mc FROM g))), hand AS (SELECT h.row, h.col, h.cr * 64 + h.cc AS channel, a.z - b.z AS hand FROM hd h JOIN cells a ON a.row = h.row AND a.col = h.col JOIN cells b ON b.row = h.cr AND b.col = h.cc)"
    out["hand_d8"] = _with("noise", _D8, acc, hand, recursive=True) + f"SELECT row, col, channel, {r6('hand')} AS hand FROM hand"
    out["inundation"] = _with("noise", _D8, acc, hand, recursive=True) + "SELECT row, col, round(0.5 - hand, 6) AS depth FROM hand WHERE hand < 0.5"
    out["inundation_varying"] = _with("noise", _D8, acc, hand, recursive=True) + f"SELECT h.row, h.col, {r6('0.75 * pow(a.acc, 0.2) - h.hand')} AS depth FROM hand h JOIN acc a ON a.row = h.channel // 64 AND a.col = h.channel % 64 WHERE h.hand < 0.75 * pow(a.acc, 0.2)"
    out["ascii_round_trip"] = out["raster_round_trip"] = _with("noise") + "SELECT row, col, z FROM cells"
    out["burn"] = _with("noise", _D8, acc, recursive=True) + "SELECT c.row, c.col, round(CASE WHEN a.acc > 4 THEN c.z - 2.0 ELSE c.z END, 6) + 0.0 AS z FROM cells c JOIN acc a USING (row, col)"
    ker = "ker AS (SELECT d, exp(-d * d / 12.5) / (SELECT sum(exp(-d * d / 12.5)) FROM range(-10, 11) t(d)) AS w FROM range(-10, 11) t(d)), b0 AS (SELECT row, col FROM acc WHERE acc > 4)"
    soft = "b1 AS (SELECT r + d AS row, col, sum(w) AS m FROM (SELECT unnest([row, -1 - row, 2 * (SELECT mr + 1 FROM g) - 1 - row]) AS r, col FROM b0) CROSS JOIN ker WHERE r + d BETWEEN 0 AND (SELECT mr FROM g) GROUP BY ALL), b2 AS (SELECT row, c + d AS col, sum(m * w) AS m FROM (SELECT row, unnest([col, -1 - col, 2 * (SELECT mc + 1 FROM g) - 1 - col]) AS c, m FROM b1) CROSS JOIN ker WHERE c + d BETWEEN 0 AND (SELECT mc FROM g) GROUP BY ALL)"
    out["burn_blurred"] = _with("noise", _D8, acc, ker, soft, recursive=True) + f"SELECT c.row, c.col, {r6('c.z - 2.0 * CASE WHEN b0.row IS NULL THEN coalesce(b2.m, 0) ELSE (SELECT max(m) FROM b2) END')} AS z FROM cells c LEFT JOIN b2 USING (row, col) LEFT JOIN b0 USING (row, col)"
    unit = "un AS (SELECT row AS sr, col AS sc, CASE WHEN flows THEN (nc - col) / dist ELSE 0 END AS x, CASE WHEN flows THEN (row - nr) / dist ELSE 0 END AS y FROM d8), xy AS (SELECT row, col, sum(x) AS x, sum(y) AS y FROM up JOIN un USING (sr, sc) GROUP BY row, col)"
    out["accumulated_angle"] = _with("noise", _D8, acc, unit, recursive=True) + f"SELECT row, col, {r6('x')} AS x, {r6('y')} AS y, {r6('atan2(round(y, 9) + 0.0, round(x, 9) + 0.0)')} AS angle FROM xy"
    out["hand_classes"] = _with("noise", _D8, acc, hand, recursive=True) + "SELECT ((hand >= 0.05)::INT + (hand >= 0.15)::INT + (hand >= 0.25)::INT + (hand >= 0.35)::INT + (hand >= 0.45)::INT)::INT AS class, count(*) AS n FROM hand GROUP BY class"
    slow = "dist(row, col, dist) AS (SELECT pr, pc, 0.0::DOUBLE FROM pour UNION ALL SELECT d.row, d.col, t.dist + CASE WHEN a.acc >= 4 THEN 0.1 ELSE 1.0 END FROM dist t JOIN d8 d ON d.nr = t.row AND d.nc = t.col AND d.flows JOIN acc a ON a.row = d.row AND a.col = d.col)"
    out["weighted_distance_to_outlet"] = _with("noise", _D8, acc, pour, slow, recursive=True) + f"SELECT row, col, {r6('dist')} AS dist FROM dist"
    out["weighted_width_function"] = _with("noise", _D8, acc, pour, slow, recursive=True) + "SELECT least(floor(round(dist, 6) / ((SELECT max(round(dist, 6)) + 1e-5 FROM dist) / 60)), 59)::INT AS bin, count(*) AS n FROM dist GROUP BY bin"
    cover = "cv AS (SELECT row // 2 AS r, col // 2 AS c, floor(4 * z)::INT AS kind FROM cells WHERE row % 2 = 0 AND col % 2 = 0)"
    out["land_cover_overlay"] = _with("noise", _D8, acc, hand, cover, recursive=True) + f"SELECT kind, count(*) AS n, {r6('avg(round(0.5 - hand, 6))')} AS mean FROM hand h LEFT JOIN cv ON r = round_even((h.row - 0.25) / 2, 0) AND c = round_even((h.col - 0.25) / 2, 0) WHERE hand < 0.5 GROUP BY kind"
    out["polygons_round_trip"] = _with("steps") + "SELECT row, col, z FROM cells"
    out["coordinates"] = _with("noise") + "SELECT row, col, 2.0 * col + 0.25 * row + 10.0 AS x, -0.5 * col - 2.0 * row + 7.0 AS y FROM cells"
    # D-infinity and MFD: edges of one shape; of two cells that lead to each other the larger's edge is turned to its other receiver
    turn = "e0x AS (SELECT row, col, nr, nc, k, prop FROM de JOIN nb USING (row, col, k)), bad AS (SELECT a.row, a.col, a.nr, a.nc FROM e0x a JOIN e0x b ON b.row = a.nr AND b.col = a.nc AND b.nr = a.row AND b.nc = a.col WHERE a.row * 64 + a.col > a.nr * 64 + a.nc), oth AS (SELECT b.row, b.col, b.nr, b.nc, any_value(e.nr) AS tr, any_value(e.nc) AS tc FROM bad b JOIN e0x e ON e.row = b.row AND e.col = b.col AND (e.nr <> b.nr OR e.nc <> b.nc) GROUP BY ALL), e AS (SELECT x.row, x.col, coalesce(o.tr, x.nr) AS nr, coalesce(o.tc, x.nc) AS nc, x.prop FROM e0x x LEFT JOIN oth o USING (row, col, nr, nc))"
    graphs = {"mfd": [_MFD, "e AS (SELECT row, col, nr, nc, prop, k FROM mfd), e0x AS (SELECT * FROM e)"], "dinf": [_dinf_sql(), turn]}
    amounts = {"mfd": "cells", "dinf": "(SELECT c.row, c.col FROM cells c JOIN dinf USING (row, col))"}
    for r, graph in graphs.items():
        total = f"us(row, col, m) AS (SELECT row, col, 1.0::DOUBLE FROM {amounts[r]} UNION ALL SELECT d.nr, d.nc, sum(u.m * d.prop) FROM us u JOIN e d ON d.row = u.row AND d.col = u.col GROUP BY d.nr, d.nc), tot AS (SELECT c.row, c.col, round(coalesce(sum(m), 0), 6) + 0.0 AS acc FROM cells c LEFT JOIN us USING (row, col) GROUP BY ALL)"
        step = "1" if r == "mfd" else "(SELECT count(*) FROM dinf q WHERE q.row = d.nr AND q.col = d.nc)"
        far = f"ur(row, col, m) AS (SELECT row, col, 0.0::DOUBLE FROM cells UNION ALL SELECT d.nr, d.nc, max(u.m + {step}) FROM ur u JOIN e d ON d.row = u.row AND d.col = u.col GROUP BY d.nr, d.nc)"
        at = f"pour AS (SELECT row AS pr, col AS pc FROM tot WHERE {_INNER} ORDER BY acc DESC, row, col LIMIT 1)"
        off = "NOT (e.row = 0 OR e.col = 0 OR e.row = (SELECT mr FROM g) OR e.col = (SELECT mc FROM g))"
        hit = f"hit(row, col) AS (SELECT pr, pc FROM pour UNION SELECT e.row, e.col FROM hit h JOIN e0x e ON e.nr = h.row AND e.nc = h.col WHERE {off})"
        # all lengths of walks, as far as no cell's shortest path is longer
        way = f"way(row, col, dist) AS (SELECT pr, pc, 0 FROM pour UNION SELECT e.row, e.col, w.dist + 1 FROM way w JOIN e0x e ON e.nr = w.row AND e.nc = w.col WHERE w.dist < 100 AND {off if r == 'mfd' else 'true'})"
        out[f"accumulation_{r}"] = _with("noise", *graph, total, recursive=True) + "SELECT row, col, acc FROM tot"
        out[f"distance_to_ridge_{r}"] = _with("noise", *graph, far, recursive=True) + "SELECT row, col, max(m) AS dist FROM ur GROUP BY row, col"
        out[f"catchment_{r}"] = _with("noise", *graph, total, at, hit, recursive=True) + "SELECT row, col FROM hit"
        out[f"distance_to_outlet_{r}"] = _with("noise", *graph, total, at, way, recursive=True) + "SELECT row, col, min(dist)::DOUBLE AS dist FROM way GROUP BY row, col"
        starts = f"ch AS (SELECT row, col FROM acc WHERE acc > 4 AND {_INNER}), eu AS (SELECT e.row, e.col, e.nr, e.nc, (e.k + 4) % 8 AS j FROM e0x e WHERE {off})"
        hops = "hp(row, col, n) AS (SELECT row, col, 0 FROM ch UNION SELECT eu.row, eu.col, n + 1 FROM hp JOIN eu ON eu.nr = hp.row AND eu.nc = hp.col WHERE n < 60), hops AS (SELECT row, col, min(n) AS n FROM hp GROUP BY row, col)"
        level = "hn(row, col, channel, place, n) AS (SELECT row, col, row * 64 + col, -(row * 64 + col), 0 FROM ch UNION ALL SELECT row, col, channel, row_number() OVER (ORDER BY o), n FROM (SELECT eu.row, eu.col, arg_min(hn.channel, hn.place * 8 + eu.j) AS channel, min(hn.place * 8 + eu.j) AS o, any_value(hn.n) + 1 AS n FROM hn JOIN eu ON eu.nr = hn.row AND eu.nc = hn.col JOIN hops ON hops.row = eu.row AND hops.col = eu.col AND hops.n = hn.n + 1 GROUP BY eu.row, eu.col))"
        out[f"hand_{r}"] = _with("noise", _D8, acc, *graph, starts, hops, level, recursive=True) + f"SELECT h.row, h.col, h.channel, {r6('a.z - b.z')} AS hand FROM hn h JOIN cells a ON a.row = h.row AND a.col = h.col JOIN cells b ON b.row = h.channel // 64 AND b.col = h.channel % 64"
    rim = f"NOT ({_INNER})"
    # water falls to the level of its lowest neighbour, down to the ground, in so many rounds that none changes any more
    sink = f"wl(row, col, w, i) AS (SELECT row, col, CASE WHEN {rim} THEN z ELSE 1e9 END, 0 FROM cells UNION ALL SELECT a.row, a.col, greatest(any_value(c.z), least(any_value(a.w), min(b.w))), any_value(a.i) + 1 FROM wl a JOIN offs o ON true JOIN wl b ON b.row = a.row + o.dr AND b.col = a.col + o.dc JOIN cells c ON c.row = a.row AND c.col = a.col WHERE a.i < {ROUNDS} GROUP BY a.row, a.col)"
    out["fill_depressions"] = _with("steps", sink, recursive=True) + f"SELECT row, col, w AS z FROM wl WHERE i = {ROUNDS}"
    out["detect_depressions"] = _with("steps", sink, recursive=True) + f"SELECT row, col, w > z AS depression FROM wl JOIN cells USING (row, col) WHERE i = {ROUNDS}"
    side = "sd AS (SELECT row, col, nr, nc FROM nb WHERE z = zn AND dist = 1)"
    least = f"lb(row, col, l, i) AS (SELECT row, col, row * 64 + col, 0 FROM cells UNION ALL SELECT a.row, a.col, least(any_value(a.l), coalesce(min(b.l), any_value(a.l))), any_value(a.i) + 1 FROM lb a LEFT JOIN sd ON sd.row = a.row AND sd.col = a.col LEFT JOIN lb b ON b.row = sd.nr AND b.col = sd.nc WHERE a.i < {ROUNDS} GROUP BY a.row, a.col)"
    out["polygonize"] = _with("steps", side, least, f"same AS (SELECT row, col, count(*) AS n FROM sd GROUP BY row, col)", recursive=True) + f"SELECT l AS label, any_value(z) AS value, count(*) AS n_cells, sum(4 - coalesce(n, 0))::INT AS n_edges FROM lb JOIN cells USING (row, col) LEFT JOIN same USING (row, col) WHERE i = {ROUNDS} GROUP BY l"
    # channels of the ramp: cells, what feeds them, and the stretches between nodes
    net = f"ch AS (SELECT row, col FROM acc WHERE acc > 50 AND {_INNER}), ce AS (SELECT row * 64 + col AS id, CASE WHEN flows THEN nr * 64 + nc END AS p FROM d8 JOIN ch USING (row, col)), fd AS (SELECT p AS id, count(*) AS n FROM ce WHERE p IS NOT NULL GROUP BY p), nd AS (SELECT id, p, coalesce(n, 0) AS n, coalesce(n, 0) + (p IS NULL)::INT AS fed, coalesce(n, 0) = 0 OR coalesce(n, 0) + (p IS NULL)::INT > 1 AS node FROM (SELECT id FROM ce UNION SELECT id FROM fd) LEFT JOIN ce USING (id) LEFT JOIN fd USING (id))"
    walks = "dn(id, d) AS (SELECT id, 0 FROM nd WHERE p IS NULL UNION ALL SELECT nd.id, d + 1 FROM dn JOIN nd ON nd.p = dn.id), uw(id, v) AS (SELECT id, id FROM nd WHERE n = 0 UNION ALL SELECT nd.p, v FROM uw JOIN nd USING (id) WHERE nd.p IS NOT NULL), mx AS (SELECT id, max(v) AS v FROM uw GROUP BY id)"
    order = "so(id, p, fed, ord, i) AS (SELECT id, p, fed, 1, 0 FROM nd UNION ALL SELECT a.id, a.p, a.fed, coalesce(max(b.ord) + (min(b.ord) = max(b.ord) AND a.fed > 1)::INT, 1), a.i + 1 FROM so a LEFT JOIN so b ON b.p = a.id WHERE a.i <= (SELECT max(d) FROM dn) GROUP BY a.id, a.p, a.fed, a.i)"
    out["stream_order"] = _with("ramp", _D8, acc, net, walks, order, recursive=True) + "SELECT id // 64 AS row, (id % 64)::INT AS col, ord::INT AS ord FROM so WHERE i = (SELECT max(i) FROM so)"
    parts = "sg(head, tail, path) AS (SELECT id, p, [id, p] FROM nd WHERE node AND p IS NOT NULL UNION ALL SELECT head, nd.p, list_append(path, nd.p) FROM sg JOIN nd ON nd.id = sg.tail WHERE NOT nd.node), sn AS (SELECT (row_number() OVER (ORDER BY v DESC, d DESC) - 1)::INT AS number, head, tail, path FROM sg JOIN nd ON nd.id = sg.tail AND nd.node JOIN mx ON mx.id = head JOIN dn ON dn.id = head)"
    out["extract_river_network"] = _with("ramp", _D8, acc, net, walks, parts, recursive=True) + """SELECT number, head, tail, '{"type":"LineString","coordinates":[' || array_to_string(list_transform(path, lambda i: '[' || (i % 64)::DOUBLE || ',' || (mr + 1 - i // 64)::DOUBLE || ']'), ',') || ']}' AS geometry FROM sn CROSS JOIN g"""
    drains = f"rc AS (SELECT number AS reach, unnest(path[1:len(path) - 1]) AS id FROM sn), fl AS (SELECT row * 64 + col AS id, nr * 64 + nc AS p, dist, z, zn FROM d8 WHERE flows AND {_INNER}), dr(reach, id) AS (SELECT reach, id FROM rc UNION ALL SELECT dr.reach, fl.id FROM dr JOIN fl ON fl.p = dr.id WHERE fl.id NOT IN (SELECT id FROM ce)), ld AS (SELECT reach, count(*)::DOUBLE AS area, avg((z - zn) / dist) AS land_slope FROM dr JOIN fl USING (id) GROUP BY reach), ln AS (SELECT reach, sum(dist) AS length FROM rc JOIN fl USING (id) GROUP BY reach)"
    ends = "JOIN ln ON ln.reach = sn.number JOIN ld ON ld.reach = sn.number JOIN cells a ON a.row * 64 + a.col = head JOIN cells b ON b.row * 64 + b.col = tail JOIN acc ON acc.row * 64 + acc.col = path[len(path) - 1]"
    out["storm_water_reaches"] = _with("ramp", _D8, acc, net, walks, parts, drains, recursive=True) + f"SELECT number AS reach, head, tail, {r6('length')} AS length, {r6('a.z - b.z')} AS drop, {r6('(a.z - b.z) / length')} AS slope, {r6('area')} AS area, {r6('area / (length / 2)')} AS width, {r6('land_slope')} AS land_slope, {r6('acc.acc')} AS flow FROM sn {ends}"
    out["extract_profiles"] = _with("ramp", _D8, acc, net, walks, parts, recursive=True) + "SELECT a.number, array_to_string(a.path, ',') AS cells, coalesce(b.number, (SELECT min(c.number) FROM sn c WHERE c.tail = a.tail)) AS next FROM sn a LEFT JOIN sn b ON b.head = a.tail"
    out["polygons"] = out["polygonize"].replace("sum(4 - coalesce(n, 0))::INT AS n_edges", "count(*)::DOUBLE AS area")
    kinds = f"kd AS (SELECT row, col, any_value(z) AS z, coalesce(any_value({_INNER}), false) AND min(zn) = any_value(z) AS flat, max(zn) > any_value(z) AS hi, NOT any_value({_INNER}) OR min(zn) < any_value(z) AS dr FROM nb GROUP BY row, col)"
    near = "nr AS (SELECT a.row, a.col, b.row AS nr, b.col AS nc, a.z, b.z AS zn, b.flat AS fn, b.dr AS dn FROM kd a JOIN nb n ON n.row = a.row AND n.col = a.col JOIN kd b ON b.row = n.nr AND b.col = n.nc WHERE a.flat)"
    label = f"fl(row, col, l, i) AS (SELECT row, col, row * 64 + col, 0 FROM kd WHERE flat UNION ALL SELECT a.row, a.col, least(any_value(a.l), coalesce(min(b.l), any_value(a.l))), any_value(a.i) + 1 FROM fl a LEFT JOIN nr ON nr.row = a.row AND nr.col = a.col AND fn LEFT JOIN fl b ON b.row = nr.nr AND b.col = nr.nc WHERE a.i < {ROUNDS} GROUP BY a.row, a.col)"
    walk_to = lambda name, start, way: f"{name}0(row, col, v) AS ({start} UNION SELECT n.{way}, v + 1 FROM {name}0 t JOIN nr n ON {{on}} WHERE v < {ROUNDS}), {name} AS (SELECT row, col, min(v) AS v FROM {name}0 GROUP BY row, col)"
    away = walk_to("aw", "SELECT row, col, 1 FROM kd WHERE flat AND hi", "nr, n.nc").format(on="n.row = t.row AND n.col = t.col AND fn")
    to = walk_to("tw", "SELECT DISTINCT nr, nc, 1 FROM nr WHERE dn AND zn = z", "row, n.col").format(on="n.nr = t.row AND n.nc = t.col AND zn = z")
    tops = f"tp AS (SELECT l, max(v) AS top FROM aw JOIN fl USING (row, col) WHERE i = {ROUNDS} GROUP BY l), fr AS (SELECT row, col, top - v AS f FROM aw JOIN fl USING (row, col) JOIN tp USING (l) WHERE i = {ROUNDS})"
    out["resolve_flats"] = _with("steps", kinds, near, label, away, to, tops, recursive=True) + f"SELECT c.row, c.col, {r6('c.z + 1e-5 * (2 * coalesce(v, 0) + coalesce(f, 0))')} AS z FROM cells c LEFT JOIN tw USING (row, col) LEFT JOIN fr USING (row, col)"
    tgt = f"t AS (SELECT i AS row, j::INT AS col, 2.0 * j + 0.25 AS x, (SELECT mr + 1 FROM g) - 0.25 - 2.0 * i AS y FROM range((SELECT (mr + 1) // 2 FROM g)) a(i), range((SELECT (mc + 1) // 2 FROM g)) b(j)), s AS (SELECT row, col, (SELECT mr + 1 FROM g) - y AS sr, x AS sc FROM t)"
    out["view_nearest"] = _with("noise", tgt) + f"SELECT s.row, s.col, {r6('c.z')} AS z FROM s LEFT JOIN cells c ON c.row = round_even(sr, 0)::BIGINT AND c.col = round_even(sc, 0)::INT"
    lin = "cc AS (SELECT row, col, floor(sr)::BIGINT AS r, floor(sc)::INT AS c, sr - floor(sr) AS tr, sc - floor(sc) AS tc FROM s), xx AS (SELECT row, col, r, c, (1 - tr) * (1 - tc) AS w FROM cc UNION ALL SELECT row, col, r, c + 1, (1 - tr) * tc FROM cc UNION ALL SELECT row, col, r + 1, c, tr * (1 - tc) FROM cc UNION ALL SELECT row, col, r + 1, c + 1, tr * tc FROM cc)"
    out["view_linear"] = _with("noise", tgt, lin) + f"SELECT x.row, x.col, {r6('sum(w * z)')} AS z FROM xx x JOIN cells c ON c.row = x.r AND c.col = x.c GROUP BY x.row, x.col"
    out["clip_to"] = _with("noise", "h AS (SELECT * FROM cells WHERE z > 0.35)") + "SELECT row - (SELECT min(row) FROM h) AS row, (col - (SELECT min(col) FROM h))::INT AS col, z FROM h"
    merc = "k AS (SELECT 6378137.0::DOUBLE AS r, pi() / 180 AS q, mr + 1 AS n, mc + 1 AS m FROM g), b AS (SELECT *, -97.0 * q * r AS x0, (-97.0 + 0.01 * m) * q * r AS x1, ln(tan(pi() / 4 + 33.0 * q / 2)) * r AS y1, ln(tan(pi() / 4 + (33.0 - 0.01 * n) * q / 2)) * r AS y0 FROM k), s AS (SELECT row, col, ((x0 + (x1 - x0) / m * col) / (q * r) + 97.0) / 0.01 AS sc, (33.0 - (2 * atan(exp((y1 - (y1 - y0) / n * row) / r)) - pi() / 2) / q) / 0.01 AS sr FROM cells CROSS JOIN b)"
    out["to_crs"] = _with("noise", merc) + "SELECT s.row, s.col, c.z FROM s JOIN cells c ON c.row = round_even(sr, 0)::BIGINT AND c.col = round_even(sc, 0)::INT"
    pts = "pts AS (SELECT c_custkey AS pid, (c_custkey % 64)::DOUBLE + 0.4 AS x, (c_custkey % 500)::DOUBLE + 0.4 AS y FROM customer)"
    out["nearest_cell"] = _with("noise", pts) + "SELECT pid, round_even(x, 0)::INT AS col, round_even((SELECT mr + 1 FROM g) - y, 0)::BIGINT AS row FROM pts"
    out["snap_to_mask"] = _with("noise", pts, "m AS (SELECT row, col, col::DOUBLE AS sx, (SELECT mr + 1 FROM g)::DOUBLE - row AS sy FROM cells WHERE z > 0.3), d AS (SELECT pid, sx, sy, row, col, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS dist FROM pts CROSS JOIN m)") + f"SELECT pid, sx, sy, {r6('dist')} AS dist FROM d QUALIFY row_number() OVER (PARTITION BY pid ORDER BY dist, row, col) = 1"
    tri = "tri AS (SELECT n_nationkey AS sid, n_regionkey::DOUBLE AS value, unnest([1, 2, 3]) AS i, unnest([n_nationkey * 2 + 1.25, n_nationkey * 2 + 11.25, n_nationkey * 2 + 6.25])::DOUBLE AS xi, unnest([n_nationkey * 11 + 3.25, n_nationkey * 11 + 8.25, n_nationkey * 11 + 27.25])::DOUBLE AS yi FROM nation), sides AS (SELECT a.sid, a.value, a.xi, a.yi, b.xi AS xj, b.yi AS yj FROM tri a JOIN tri b ON a.sid = b.sid AND b.i = (a.i + 1) % 3 + 1), px AS (SELECT row, col, col + 0.5 AS px, (SELECT mr + 1 FROM g) - row - 0.5 AS py FROM cells), hits AS (SELECT row, col, sid, any_value(value) AS value FROM px JOIN sides ON (yi > py) <> (yj > py) AND px < (xj - xi) * (py - yi) / (yj - yi) + xi GROUP BY row, col, sid HAVING count(*) % 2 = 1), lasts AS (SELECT row, col, arg_max(value, sid) AS v FROM hits GROUP BY row, col)"
    out["rasterize"] = _with("noise", tri) + "SELECT c.row, c.col, coalesce(v, -1.0)::DOUBLE AS z FROM cells c LEFT JOIN lasts USING (row, col)"
    corners = "k(i, x, y) AS (SELECT unnest([0, 1, 2, 3]), unnest([5.3, 60.7, 21.3, 5.3])::DOUBLE, unnest([0.1 * n + 0.3, 0.45 * n + 0.7, 0.9 * n + 0.3, 0.1 * n + 0.3])::DOUBLE FROM (SELECT mr + 1 AS n FROM g))"
    cut = "hits AS (SELECT c.row, c.col, c.z FROM cells c JOIN k a ON true JOIN k b ON b.i = a.i + 1 CROSS JOIN g WHERE (a.y > mr + 0.5 - c.row) <> (b.y > mr + 0.5 - c.row) AND c.col + 0.5 < a.x + (mr + 0.5 - c.row - a.y) * (b.x - a.x) / (b.y - a.y))"
    out["masked_mosaic"] = _with("noise", corners, cut) + "SELECT row, col, any_value(z) AS z FROM hits GROUP BY row, col HAVING count(*) % 2 = 1"
    out["projected_points"] = _PROJECTED
    return out | flood_queries.oracle_sql()
