"""Derived rasters, polygons, GeoJSON and the façade's options, against small models written here."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_raster import cells

from thalweg.grid import Grid, Raster
from thalweg.operators import derived, vector, view
from thalweg.sources import geojson
from thalweg.spec import GridSpec


def test_classes_and_histogram(spark):
    v = [0.0, 0.1, 0.1, 0.25, 0.9, 1.0, None]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert [r[0] for r in df.select(derived.class_of("v", [0.1, 0.5])).collect()] == [0, 1, 1, 1, 2, 2, None]
    counts, edges = np.histogram(v[:-1], bins=4, range=(0, 1))
    got = {r["bin"]: (r["lower"], r["n"]) for r in derived.histogram(df, "v", 4, 0.0, 1.0).collect()}
    assert got == {k: (edges[k], n) for k, n in enumerate(counts) if n}
    assert derived.histogram(df.where("false"), "v", 4).count() == 0


def test_blur_mirrors_at_the_rim(spark):
    z = (np.random.default_rng(1).random((13, 12)) < 0.2).astype(float)
    df, spec = cells(spark, z)
    d = np.arange(-4, 5)
    k = np.exp(-d * d / 2.0) / np.exp(-d * d / 2.0).sum()
    wide = np.pad(z, 4, mode="symmetric")
    want = sum(k[i] * k[j] * wide[i : i + 13, j : j + 12] for i in range(9) for j in range(9))
    got = {(r["row"], r["col"]): r["z"] for r in derived.blurred(df, spec, 1.0).collect()}
    assert all(math.isclose(got.get(at, 0.0), want[at], abs_tol=1e-12) for at in np.ndindex(z.shape))
    with pytest.raises(ValueError):
        derived.blurred(df, spec, 5.0)


def burned(rings, shape):
    """Cells whose centres the rings hold by the even-odd rule."""
    out = np.zeros(shape, int)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            for r, c in np.ndindex(shape):
                if (y1 > r + 0.5) != (y2 > r + 0.5) and c + 0.5 < (x2 - x1) * (r + 0.5 - y1) / (y2 - y1) + x1:
                    out[r, c] ^= 1
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_polygons_hold_their_cells_alone(spark, tmp_path, connectivity):
    z = np.random.default_rng(connectivity).integers(0, 2, (11, 9)).astype(float)
    z[4, 4] = np.nan
    df, spec = cells(spark, z)
    shapes = vector.polygons(df, spec, connectivity=connectivity)
    seen = np.zeros(z.shape, int)
    for r in shapes.collect():
        g = json.loads(r["geometry"])
        parts = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
        assert connectivity == 8 or g["type"] == "Polygon"
        own = sum(burned(p, z.shape) for p in parts)  # holes lie within the outer ring of their part
        assert own.sum() == r["n_cells"] and own.max() == 1 and (z[own == 1] == r["value"]).all()
        seen += own
    assert (seen == ~np.isnan(z)).all()
    geojson.to_geojson(shapes.select(F.col("label").alias("sid"), "value", "geometry"), str(tmp_path / "g"))
    back = geojson.read_geojson(spark, str(tmp_path / "g"), "sid long, value double")
    again = view.rasterize(back.select("sid", "value", geojson.rings().alias("rings")), spec, fill=-1.0)
    got = {(r["row"], r["col"]): r["z"] for r in again.collect()}
    assert got == {at: -1.0 if np.isnan(z[at]) else z[at] for at in np.ndindex(z.shape)}


def test_polygons_of_masked_cells_and_of_nothing(spark):
    df, spec = cells(spark, np.ones((5, 5)))
    ring = [(r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)]
    got = vector.polygons(df, spec, mask=spark.createDataFrame(ring, "row long, col int"))
    one = got.select("n_cells", "geometry", vector.area_of().alias("area")).collect()
    assert len(one) == 1 and one[0]["n_cells"] == 24 and one[0]["area"] == 24.0 and len(json.loads(one[0]["geometry"])["coordinates"]) == 2
    assert vector.polygons(df.where("false"), spec).count() == 0


def test_rasterize_options(spark):
    ring = lambda x0, x1: [{"x": x, "y": y} for x, y in ((x0, x0), (x1, x0), (x1, x1), (x0, x1))]
    shapes = spark.createDataFrame([(1, [ring(0.0, 8.0), ring(2.0, 4.0)])], "sid int, rings array<array<struct<x:double,y:double>>>")
    spec = GridSpec(10, 10)
    some = spark.createDataFrame([(0, 0), (3, 3), (9, 9)], "row long, col int")
    out = view.rasterize(shapes, spec, fill=7, default_value=3, dtype="int", band=3)
    assert dict(out.dtypes)["z"] == "int" and out.where("z = 3").count() == 60 and out.where("z = 7").count() == 40
    assert [tuple(r) for r in view.rasterize(shapes, spec, mask=some).where("z = 1").collect()] == [(0, 0, 1.0)]
    other = Grid(spark, spec).rasterize(shapes, out_shape=(4, 5), affine=(2.0, 0.0, 0.0, 0.0, 2.0, 0.0))
    assert other.spec.nrows == 4 and other.cells.where("z = 1").count() == 15


def test_view_options_and_arguments(spark):
    z = np.arange(30.0).reshape(5, 6)
    df, spec = cells(spark, z)
    grid, dem = Grid(spark, spec), Raster(df, spec)
    on = Raster(df.withColumn("z", F.col("z") > 9), spec)
    seen = grid.view(dem, input_mask=on, nodata=-1.0, dtype="int")
    assert seen.spec.nodata == -1.0 and dict(seen.cells.dtypes)["z"] == "int" and seen.cells.where("z is null").count() == 10
    small = grid.view(dem, shape=(2, 3), affine=(2.0, 0.0, 0.0, 0.0, 2.0, 0.0))
    assert sorted(r["z"] for r in small.cells.collect()) == [0.0, 2.0, 4.0, 12.0, 14.0, 16.0]
    assert dem.on(small.spec).congruent(small) and dem.on(small.spec).cells.exceptAll(small.cells).isEmpty()
    with pytest.raises(ValueError):
        grid.view(dem, input_mask=small)
    fdir = grid.flowdir(dem, nodata_out=0.0)
    assert fdir.spec.nodata == 0.0
    assert grid.accumulation(fdir, nodata_out=-5.0, algorithm="recursive").spec.nodata == -5.0
    inside = grid.catchment(3, 1, fdir, pour_value=0, xytype="index").cells
    assert inside.where("not catchment").select("row", "col").collect() == [(1, 3)]
    with pytest.raises(ValueError):
        grid.accumulation(fdir, algorithm="other")
    with pytest.raises(NotImplementedError):
        grid.distance_to_outlet(3, 1, fdir, method="longest", xytype="index")


def test_coordinates_and_axes(spark):
    spec = GridSpec(3, 4, (2.0, 0.0, 1.0, 0.0, -2.0, 9.0))
    df, _ = cells(spark, np.zeros((3, 4)))
    for r in view.coordinates(df, spec).collect():
        assert (r["x"], r["y"]) == spec.xy(r["row"], r["col"])
    y, x = view.axes(spark, spec)
    assert [r["y"] for r in y.orderBy("row").collect()] == [9.0, 7.0, 5.0] and [r["x"] for r in x.orderBy("col").collect()] == [1.0, 3.0, 5.0, 7.0]
    with pytest.raises(ValueError):
        view.axes(spark, GridSpec(3, 4, (2.0, 0.5, 1.0, 0.0, -2.0, 9.0)))
