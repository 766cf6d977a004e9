"""The façade: rasters are brought onto the grid in view; sinks and sources; cells that shapes touch."""

import numpy as np
import pytest

from thalweg.grid import Grid, Raster
from thalweg.operators import hydro, terrain, view
from thalweg.spec import GridSpec


@pytest.fixture
def dem(spark):
    z = np.random.default_rng(5).normal(size=(12, 15)) + 0.5 * np.arange(12)[:, None]
    rows = [(r, c, float(v)) for (r, c), v in np.ndenumerate(z)]
    return Raster(spark.createDataFrame(rows, "row long, col int, z double"), GridSpec(12, 15, (1.0, 0.0, 0.0, 0.0, -1.0, 12.0), nodata=-9999.0))


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_methods_give_what_operators_give(spark, dem):
    grid = Grid.from_raster(dem)
    assert grid.shape == (12, 15) and grid.size == 180 and grid.bbox == (0.0, 0.0, 15.0, 12.0) and grid.extent == (0.0, 15.0, 0.0, 12.0)
    for routing in ("d8", "dinf", "mfd"):
        fdir = grid.flowdir(dem, routing)
        slope = terrain.cell_slopes(dem.cells, fdir.cells, dem.spec, routing)
        assert rows(grid.cell_slopes(dem, fdir).cells, "row", "col", "slope") == rows(slope, "row", "col", "slope")
    d8 = grid.flowdir(dem)
    acc = hydro.accumulation(d8.cells, dem.spec)
    assert rows(grid.accumulation(d8).cells, "row", "col", "acc") == rows(acc, "row", "col", "acc")
    mask = grid.accumulation(d8).mapped("acc > 3")
    deep = grid.inundation(d8, dem, mask, 0.5)
    hand = {(r["row"], r["col"]): r["hand"] for r in grid.compute_hand(d8, dem, mask).cells.collect()}
    assert {(r["row"], r["col"]): r["depth"] for r in deep.cells.collect()} == {k: 0.5 - v for k, v in hand.items() if v < 0.5}
    assert grid.extract_river_network(d8, mask).count() == grid.extract_profiles(d8, mask).count()
    assert grid.stream_order(d8, mask).cells.count() >= mask.where("acc").cells.count() - 2 * 27


def test_window_and_mask(spark, dem):
    grid = Grid.from_raster(dem)
    grid.clip_to(Raster(dem.cells.where("row between 2 and 6 and col between 3 and 9 and row + col != 9"), dem.spec), (1, 0, 20, 0))
    assert grid.spec == dem.spec.window(2, 2, 5, 28)
    seen = grid.view(dem).cells
    assert seen.count() == 5 * 28  # beyond the data too
    want = rows(dem.cells.where("row between 2 and 6 and col between 3 and 9 and row + col != 9").selectExpr("row - 2 as row", "col - 2 as col", "z"), "row", "col", "z")
    assert rows(seen.where("z is not null"), "row", "col", "z") == want


def test_resampled_when_lines_differ(spark, dem):
    grid = Grid(spark, GridSpec(6, 7, (2.0, 0.0, 0.25, 0.0, -2.0, 11.75)))
    own = rows(grid.view(dem, "linear").cells, "row", "col", "z")
    assert own == rows(view.view(dem.cells, dem.spec, grid.spec, "linear"), "row", "col", "z")
    with pytest.raises(ValueError):
        grid.accumulation(Grid.from_raster(dem).flowdir(dem))


def test_errors(spark, dem):
    grid = Grid.from_raster(dem)
    with pytest.raises(ValueError):
        grid.flowdir(dem, "d9")
    with pytest.raises(ValueError):
        grid.accumulation(dem)
    with pytest.raises(NotImplementedError):
        grid.stream_order(grid.flowdir(dem, "mfd"), dem)
    with pytest.raises(TypeError):
        grid.view(dem.cells)
    with pytest.raises(TypeError):
        Grid.from_raster(3)


def test_files(spark, dem, tmp_path):
    grid = Grid.from_raster(dem)
    grid.to_ascii(dem, str(tmp_path / "a"))
    grid.to_raster(dem, str(tmp_path / "a.tif"), dtype="float64")
    again = Grid.from_ascii(spark, str(tmp_path / "a"))
    assert again.spec == Grid.from_raster(str(tmp_path / "a.tif"), spark).spec == dem.spec
    for back in (again.read_ascii(str(tmp_path / "a")), again.read_raster(str(tmp_path / "a.tif"))):
        assert rows(back.cells, "row", "col", "z") == rows(dem.cells, "row", "col", "z")


def test_all_touched(spark):
    """Against points spread finely over the shape's sides, and the plain rule for its inside."""
    ring = [(1.3, 1.2), (8.6, 2.9), (4.2, 7.7)]
    shapes = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring], 5.0)], "sid int, ring array<struct<x:double,y:double>>, value double")
    spec = GridSpec(10, 10, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
    t = np.linspace(0, 1, 20001)[:, None]
    sides = np.concatenate([(1 - t) * np.array(a) + t * np.array(b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)])
    touched = {(int(y), int(x)) for x, y in np.floor(sides)}
    inside = {(r["row"], r["col"]) for r in view.rasterize(shapes, spec).where("z = 5").collect()}
    both = {(r["row"], r["col"]) for r in view.rasterize(shapes, spec, all_touched=True).where("z = 5").collect()}
    assert both == inside | touched and touched - inside
