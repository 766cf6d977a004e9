"""The engine's façade: a grid in view, and rasters that its methods bring onto it before they work."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions.geometry import DIRMAP
from thalweg.operators import condition, derived, hydro, terrain, vector
from thalweg.operators import view as views
from thalweg.plans.loops import pinned
from thalweg.sources import ascii as ascii_grid
from thalweg.sources import geotiff
from thalweg.spec import GridSpec

ROUTINGS = {"d8": ("fdir", terrain.flowdir_d8), "dinf": ("angle", terrain.flowdir_dinf), "mfd": ("prop", terrain.flowdir_mfd)}


@dataclass(frozen=True)
class Raster:
    """Cells (row, col, ``value``; for MFD flow also k) on a grid. ``routing`` is set on flow directions."""

    cells: DataFrame
    spec: GridSpec
    value: str = "z"
    routing: str | None = None

    def to_crs(self, crs: str, interpolation: str = "nearest") -> Raster:
        return replace(self, **dict(zip(("cells", "spec"), views.to_crs(self.cells, self.spec, crs, interpolation, self.value), strict=True)))

    def on(self, spec: GridSpec, interpolation: str = "nearest") -> Raster:
        """The raster on another grid, by its own nodata and without masks."""
        if self.routing:
            raise ValueError("flow directions can't be resampled")
        spec = replace(spec, nodata=self.spec.nodata)
        return replace(self, cells=views.view(self.cells, self.spec, spec, interpolation, self.value), spec=spec)

    def congruent(self, other: Raster) -> bool:
        return self.spec.congruent(other.spec)

    def where(self, condition_: str) -> Raster:
        """The cells of which the SQL condition holds; as a mask these are its cells."""
        return replace(self, cells=self.cells.where(condition_))

    def mapped(self, expression: str) -> Raster:
        """Grid algebra: each cell's value by a SQL expression of row, col and the value."""
        return replace(self, cells=self.cells.withColumn(self.value, F.expr(expression)))


def _offset(source: GridSpec, target: GridSpec) -> tuple[int, int] | None:
    """(rows, columns) by which the target's first cell lies within the source, if the two share their lines."""
    a, t = source.affine, target.affine
    if source.crs != target.crs or any(abs(a[i] - t[i]) > 1e-12 * max(abs(a[0]), abs(a[4])) for i in (0, 1, 3, 4)):
        return None
    i = source.inverse()
    col, row = i[0] * t[2] + i[1] * t[5] + i[2], i[3] * t[2] + i[4] * t[5] + i[5]
    near = abs(row - round(row)) < 1e-6 and abs(col - round(col)) < 1e-6
    return (round(row), round(col)) if near else None


class Grid:
    """A grid in view (``spec``), and a ``mask`` of its cells (row, col), or None for all of them.

    Every method brings its rasters onto the grid. One that shares the grid's lines is shifted, without a shuffle; others
    are resampled. Cells off the mask are null. Flow directions can only be shifted.
    """

    def __init__(self, spark: SparkSession, spec: GridSpec, mask: DataFrame | None = None):
        self.spark, self.spec, self.mask = spark, spec, mask

    @classmethod
    def from_raster(cls, data: Raster | str, spark: SparkSession | None = None, **kw) -> Grid:
        if isinstance(data, Raster):
            return cls(data.cells.sparkSession, data.spec)
        if not isinstance(data, str) or spark is None:
            raise TypeError("a Raster, or a path and a session")
        return cls(spark, geotiff.read_raster(spark, data, **kw)[1])

    @classmethod
    def from_ascii(cls, spark: SparkSession, path: str, **kw) -> Grid:
        return cls(spark, ascii_grid.read_ascii(spark, path, **kw)[1])

    shape = property(lambda self: (self.spec.nrows, self.spec.ncols))
    size = property(lambda self: self.spec.size)
    affine = property(lambda self: self.spec.affine)
    bbox = property(lambda self: self.spec.bbox)
    extent = property(lambda self: self.spec.extent)
    crs = property(lambda self: self.spec.crs)

    # sources and sinks

    def read_ascii(self, path: str, **kw) -> Raster:
        return Raster(*ascii_grid.read_ascii(self.spark, path, **kw))

    def read_raster(self, path: str, **kw) -> Raster:
        return Raster(*geotiff.read_raster(self.spark, path, **kw))

    def to_ascii(self, raster: Raster, path: str, *, target: GridSpec | None = None, interpolation: str = "nearest", **kw) -> None:
        out = self.view(raster, interpolation, target)
        ascii_grid.to_ascii(out.cells, out.spec, path, value=out.value, **kw)

    def to_raster(self, raster: Raster, path: str, *, target: GridSpec | None = None, interpolation: str = "nearest", **kw) -> None:
        out = self.view(raster, interpolation, target)
        geotiff.to_raster(out.cells, out.spec, path, value=out.value, **kw)

    # views

    def view(
        self,
        raster: Raster,
        interpolation: str = "nearest",
        target: GridSpec | None = None,
        masked: bool = True,
        *,
        input_mask: Raster | None = None,
        nodata: float | None = None,
        dtype: str | None = None,
        affine: tuple | None = None,
        shape: tuple[int, int] | None = None,
        crs: str | None = None,
    ) -> Raster:
        """``raster`` on the grid, or on ``target`` or on one with another ``affine``, ``shape`` or ``crs``; with ``masked``, null off the
        grid's mask (the grid's own view only). Cells off ``input_mask``, on the raster's own grid, count as without data.
        ``nodata`` (else the raster's) is what sinks write for null; ``dtype`` is a Spark type to cast values to."""
        if not isinstance(raster, Raster):
            raise TypeError("not a Raster")
        if affine is not None or shape is not None or crs is not None:
            base = target or self.spec
            target = replace(base, affine=affine or base.affine, nrows=(shape or (base.nrows,))[0], ncols=(shape or (0, base.ncols))[1], crs=crs or base.crs)
        if input_mask is not None:
            if not input_mask.spec.congruent(raster.spec):
                raise ValueError("the input mask is not on the raster's grid")
            held = input_mask.cells.where(F.coalesce(F.col(input_mask.value).cast("boolean"), F.lit(False))).select("row", "col", F.lit(True).alias("__in")).distinct()
            kept = raster.cells.join(held, ["row", "col"], "left")
            raster = replace(raster, cells=kept.withColumn(raster.value, F.when(F.col("__in"), F.col(raster.value))).drop("__in"))
        if dtype is not None:
            raster = replace(raster, cells=raster.cells.withColumn(raster.value, F.col(raster.value).cast(dtype)))
        if nodata is not None:
            raster = replace(raster, spec=replace(raster.spec, nodata=nodata))
        spec = replace(target or self.spec, nodata=raster.spec.nodata)
        cells, at = raster.cells, _offset(raster.spec, spec)
        names = [c for c in cells.columns if c not in ("row", "col")]
        if at is not None and not raster.spec.congruent(spec):
            (dr, dc), row, col = at, F.col("row"), F.col("col")
            inside = row.between(dr, dr + spec.nrows - 1) & col.between(dc, dc + spec.ncols - 1)
            cells = cells.where(inside).select((row - dr).cast("long").alias("row"), (col - dc).cast("int").alias("col"), *names)
            if not (dr >= 0 and dc >= 0 and dr + spec.nrows <= raster.spec.nrows and dc + spec.ncols <= raster.spec.ncols):
                cells = self._dense(cells, spec) if raster.routing != "mfd" else cells
        elif at is None:
            if raster.routing:
                raise ValueError("flow directions can't be resampled")
            cells = views.view(cells, raster.spec, spec, interpolation, raster.value)
        if masked and target is None and self.mask is not None:
            on = self.mask.select(F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), F.lit(True).alias("__on")).distinct()
            cells = cells.join(on, ["row", "col"], "left")
            cells = cells.select("row", "col", *[F.when(F.col("__on"), F.col(c)).alias(c) if c == raster.value else F.col(c) for c in names])
        return replace(raster, cells=cells, spec=spec)

    def _dense(self, cells: DataFrame, spec: GridSpec) -> DataFrame:
        grid = self.spark.range(spec.size).select(F.floor(F.col("id") / spec.ncols).cast("long").alias("row"), F.pmod("id", F.lit(spec.ncols)).cast("int").alias("col"))
        return grid.join(cells, ["row", "col"], "left")

    def clip_to(self, raster: Raster, pad: tuple[int, int, int, int] = (0, 0, 0, 0)) -> None:
        """The grid shrinks to the smallest window with all data of ``raster`` (padded), and its mask is where there are data."""
        cells, self.spec = views.clip_to(raster.cells, raster.spec, pad, raster.value)
        self.mask = cells.where(F.col(raster.value).isNotNull()).select("row", "col")

    def nearest_cell(self, x: float, y: float, snap: str = "corner") -> tuple[int, int]:
        return self.spec.nearest_cell(x, y, snap)

    def snap_to_mask(self, mask: Raster, points: DataFrame) -> DataFrame:
        return views.snap_to_mask(self._on(mask), points, self.spec)

    def polygonize(self, raster: Raster, connectivity: int = 4) -> DataFrame:
        return views.polygonize(self.view(raster).cells, self.spec, raster.value, connectivity)

    def polygons(self, raster: Raster, connectivity: int = 4, mask: Raster | None = None) -> DataFrame:
        """Regions of equal values as GeoJSON polygons."""
        return vector.polygons(self.view(raster).cells, self.spec, raster.value, connectivity, None if mask is None else self._on(mask))

    def rasterize(self, shapes: DataFrame, fill: float = 0.0, all_touched: bool = False, *, out_shape: tuple[int, int] | None = None, affine: tuple | None = None, crs: str | None = None, **kw) -> Raster:
        """Shapes on the grid, or on one of another shape, affine transform or coordinate system; only on the grid's mask, if it has
        one and no other grid is asked for."""
        if out_shape is None and affine is None and crs is None:
            return Raster(views.rasterize(shapes, self.spec, fill, all_touched, **{"mask": self.mask, **kw}), self.spec)
        spec = replace(self.spec, nrows=(out_shape or (self.spec.nrows,))[0], ncols=(out_shape or (0, self.spec.ncols))[1], affine=affine or self.spec.affine, crs=crs or self.spec.crs)
        return Raster(views.rasterize(shapes, spec, fill, all_touched, **kw), spec)

    # conditioning

    def detect_pits(self, dem: Raster) -> Raster:
        return self._made(terrain.detect_pits(self._z(dem), self.spec), "pit")

    def fill_pits(self, dem: Raster, nodata_out: float | None = None) -> Raster:
        return self._made(terrain.fill_pits(self._z(dem), self.spec), "z", dem, nodata_out)

    def detect_flats(self, dem: Raster) -> Raster:
        return self._made(terrain.detect_flats(self._z(dem), self.spec), "flat")

    def detect_depressions(self, dem: Raster) -> Raster:
        return self._made(condition.detect_depressions(self._z(dem), self.spec), "depression")

    def fill_depressions(self, dem: Raster, nodata_out: float | None = None) -> Raster:
        return self._made(condition.fill_depressions(self._z(dem), self.spec), "z", dem, nodata_out)

    def resolve_flats(self, dem: Raster, eps: float = 1e-5, nodata_out: float | None = None) -> Raster:
        return self._made(condition.resolve_flats(self._z(dem), self.spec, eps), "z", dem, nodata_out)

    def burn(self, dem: Raster, channels: Raster, depth: float, sigma: float | None = None) -> Raster:
        return self._made(derived.burn(self._z(dem), self._on(channels), depth, self.spec, sigma), "z", dem)

    # flow

    # Null is nodata in every result; ``nodata_out`` is what sinks write for it. ``algorithm`` chooses between two ways to the same
    # result elsewhere and is only checked here.

    def flowdir(self, dem: Raster, routing: str = "d8", nodata_out: float | None = None, **kw) -> Raster:
        """Flow directions, written once to the shared folder, since whatever follows reads them more than once."""
        if routing not in ROUTINGS:
            raise ValueError(f"routing must be one of {sorted(ROUTINGS)}, not {routing!r}")
        name, op = ROUTINGS[routing]
        spec = self.spec if nodata_out is None else replace(self.spec, nodata=nodata_out)
        return Raster(pinned(op(self._z(dem), self.spec, **kw), "flow"), spec, name, routing)

    def catchment(self, x: float, y: float, fdir: Raster, pour_value: float | None = None, nodata_out: float | None = None, algorithm: str = "iterative", **kw) -> Raster:
        """The member cells, each with the value true; the pour point with false if ``pour_value`` is 0."""
        self._either(algorithm)
        flow, spec, routing = self._flow(fdir)
        value = F.lit(True)
        if pour_value is not None and not pour_value:
            at = hydro._pour(spec, x, y, kw.get("xytype", "coordinate"), kw.get("snap", "corner"))
            value = F.col("row") * spec.ncols + F.col("col") != at
        return self._made(hydro.catchment(x, y, flow, spec, routing, **kw).withColumn("catchment", value), "catchment", nodata=nodata_out)

    def accumulation(self, fdir: Raster, weights: Raster | None = None, efficiency: Raster | None = None, nodata_out: float | None = None, algorithm: str = "iterative", **kw) -> Raster:
        self._either(algorithm)
        return self._made(hydro.accumulation(*self._flow(fdir), weights=self._as(weights, "w"), efficiency=self._as(efficiency, "e"), **kw), "acc", nodata=nodata_out)

    def accumulated_angle(self, fdir: Raster, **kw) -> Raster:
        return self._made(derived.accumulated_angle(self._d8(fdir), self.spec, **kw).select("row", "col", "angle"), "angle")

    def distance_to_outlet(self, x: float, y: float, fdir: Raster, weights: Raster | None = None, nodata_out: float | None = None, method: str = "shortest", algorithm: str = "iterative", **kw) -> Raster:
        self._either(algorithm)
        if method != "shortest":
            raise NotImplementedError("only the shortest distance")
        return self._made(hydro.distance_to_outlet(x, y, *self._flow(fdir), weights=self._as(weights, "w"), **kw), "dist", nodata=nodata_out)

    def distance_to_ridge(self, fdir: Raster, weights: Raster | None = None, nodata_out: float | None = None, algorithm: str = "iterative", **kw) -> Raster:
        self._either(algorithm)
        return self._made(hydro.distance_to_ridge(*self._flow(fdir), weights=self._as(weights, "w"), **kw), "dist", nodata=nodata_out)

    def compute_hand(self, fdir: Raster, dem: Raster, mask: Raster, return_index: bool = False, nodata_out: float | None = None, algorithm: str = "iterative", **kw) -> Raster:
        self._either(algorithm)
        flow, spec, routing = self._flow(fdir)
        out = hydro.compute_hand(flow, self._z(dem), self._on(mask), spec, routing, **kw)
        name = "channel" if return_index else "hand"
        return self._made(out.select("row", "col", name), name, nodata=nodata_out)

    def inundation(self, fdir: Raster, dem: Raster, mask: Raster, depth: float | Raster, **kw) -> Raster:
        """Depth of water over the cells: the channel's depth less the height above it, where that is over 0."""
        flow, spec, routing = self._flow(fdir)
        hand = hydro.compute_hand(flow, self._z(dem), self._on(mask), spec, routing, **kw)
        return self._made(hydro.inundation(hand, spec, self._as(depth, "depth") if isinstance(depth, Raster) else depth), "depth")

    def stream_order(self, fdir: Raster, mask: Raster, **kw) -> Raster:
        return self._made(hydro.stream_order(self._d8(fdir), self._on(mask), self.spec, **kw), "ord")

    def extract_river_network(self, fdir: Raster, mask: Raster, **kw) -> DataFrame:
        return hydro.extract_river_network(self._d8(fdir), self._on(mask), self.spec, **kw)

    def extract_profiles(self, fdir: Raster, mask: Raster, **kw) -> DataFrame:
        return hydro.extract_profiles(self._d8(fdir), self._on(mask), self.spec, **kw)

    def cell_dh(self, dem: Raster, fdir: Raster, dirmap=DIRMAP) -> Raster:
        return self._made(terrain.cell_dh(self._z(dem), *self._flow(fdir), dirmap), "dh")

    def cell_distances(self, dem: Raster, fdir: Raster, dirmap=DIRMAP) -> Raster:
        return self._made(terrain.cell_distances(self._z(dem), *self._flow(fdir), dirmap), "dist")

    def cell_slopes(self, dem: Raster, fdir: Raster, dirmap=DIRMAP) -> Raster:
        return self._made(terrain.cell_slopes(self._z(dem), *self._flow(fdir), dirmap), "slope")

    # inputs

    def _as(self, raster: Raster | None, name: str) -> DataFrame | None:
        return None if raster is None else self.view(raster).cells.select("row", "col", F.col(raster.value).alias(name))

    def _z(self, dem: Raster) -> DataFrame:
        return self._as(dem, "z").withColumn("z", F.col("z").cast("double"))

    def _on(self, mask: Raster) -> DataFrame:
        """The cells of a mask: those with a value that is neither null, false nor 0."""
        return self.view(mask).cells.where(F.coalesce(F.col(mask.value).cast("boolean"), F.lit(False))).select("row", "col")

    def _flow(self, fdir: Raster) -> tuple[DataFrame, GridSpec, str]:
        if getattr(fdir, "routing", None) not in ROUTINGS:
            raise ValueError("flow directions are what flowdir gives")
        return self.view(fdir).cells, self.spec, fdir.routing

    def _d8(self, fdir: Raster) -> DataFrame:
        if fdir.routing != "d8":
            raise NotImplementedError("only for D8 flow")
        return self._flow(fdir)[0]

    @staticmethod
    def _either(algorithm: str) -> None:
        if algorithm not in ("iterative", "recursive"):
            raise ValueError(f"algorithm must be 'iterative' or 'recursive', not {algorithm!r}")

    def _made(self, cells: DataFrame, value: str, like: Raster | None = None, nodata: float | None = None) -> Raster:
        if nodata is None:
            nodata = like.spec.nodata if like else self.spec.nodata
        return Raster(cells, replace(self.spec, nodata=nodata), value)
