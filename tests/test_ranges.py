"""GeoTIFFs read by ranges: many tasks a file, masks by polygon, floating-point predictor; mosaics written by tasks."""

import os
import random
import struct
import zlib

import numpy as np
import pytest

from thalweg.sources import geotiff
from thalweg.spec import GridSpec

SPEC = GridSpec(90, 110, (0.5, 0.0, 3.0, 0.0, -0.25, 40.0), "EPSG:4326", -9999.0)


@pytest.fixture(scope="module")
def cells(spark):
    return spark.range(SPEC.size).selectExpr("id div 110 as row", "cast(id % 110 as int) as col", "if(id % 31 = 0, null, cast(id % 977 as double) / 8) as z").cache()


def table(df):
    return {(r["row"], r["col"]): r["z"] for r in df.collect()}


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b):
                odd = not odd
    return odd


def test_one_file_is_many_tasks(spark, cells, tmp_path, monkeypatch):
    path = str(tmp_path / "a.tif")
    geotiff.to_raster(cells, SPEC, path, block=16)
    monkeypatch.setattr(geotiff, "TASK_CELLS", 1000)
    back, own = geotiff.read_raster(spark, path)
    assert own == SPEC and back.rdd.getNumPartitions() == 10
    assert table(back) == table(cells)


@pytest.mark.parametrize("seed", [1, 2])
def test_mask_geometry(spark, cells, tmp_path, seed):
    rng = random.Random(seed)
    path = str(tmp_path / "a.tif")
    geotiff.to_raster(cells, SPEC, path, block=16)
    outer = [(rng.uniform(3, 58), rng.uniform(18, 40)) for _ in range(7)]
    hole = [(20.0, 25.0), (24.0, 25.0), (22.0, 30.0)]
    shape = {"type": "Polygon", "coordinates": [outer + outer[:1], hole]}
    back, _ = geotiff.read_raster(spark, path, mask_geometry=[shape])
    want = {}
    for (r, c), z in table(cells).items():
        x, y = SPEC.xy(r + 0.5, c + 0.5)
        want[r, c] = z if inside(x, y, [outer, hole]) else None
    assert table(back) == want and 100 < sum(z is not None for z in want.values()) < 9000
    window = (*SPEC.xy(60, 20), *SPEC.xy(10, 80))
    part, small = geotiff.read_raster(spark, path, mask_geometry=shape, window=window)
    assert table(part) == {(r - 10, c - 20): z for (r, c), z in want.items() if 10 <= r < 60 and 20 <= c < 80}


def test_blocks_outside_are_not_read(spark, cells, tmp_path):
    path = str(tmp_path / "a.tif")
    geotiff.to_raster(cells, SPEC, path, block=16)
    content = bytearray(open(path, "rb").read())
    layout = geotiff.Layout(geotiff.parse(bytes(content)))
    row, col, _, _, offset, n = layout.block(0)
    content[offset : offset + n] = b"\xff" * n  # it could not be decoded
    open(path, "wb").write(content)
    x, y = SPEC.xy(50, 50)
    shape = {"type": "Polygon", "coordinates": [[(x - 9, y - 6), (x + 9, y - 6), (x + 9, y + 6), (x - 9, y + 6)]]}
    back, _ = geotiff.read_raster(spark, path, mask_geometry=shape)
    assert back.where("z is not null").count() > 1000 and back.count() == SPEC.size
    with pytest.warns(UserWarning, match="no cell"), pytest.raises(Exception, match="."):
        geotiff.read_raster(spark, path, mask_geometry={"type": "Polygon", "coordinates": [[(500, 500), (501, 500), (500, 501)]]})[0].collect()
    with pytest.raises(ValueError, match="polygons"):
        geotiff.rings_of({"type": "Point", "coordinates": [0, 0]})


@pytest.mark.parametrize("dtype", ["<f4", ">f8"])
@pytest.mark.parametrize("samples", [1, 2])
def test_floating_point_predictor(dtype, samples):
    rng = np.random.default_rng(3)
    kind = np.dtype(dtype)
    data = rng.normal(size=(5, 7, samples)).astype(kind)
    rows = []
    for row in data.reshape(5, -1).astype(kind.newbyteorder(">")):
        planes = np.frombuffer(row.tobytes(), np.uint8).reshape(-1, kind.itemsize).T.reshape(-1).astype(np.int64)
        planes = np.concatenate([planes[:samples], planes[samples:] - planes[:-samples]]) % 256
        rows.append(planes.astype(np.uint8).tobytes())
    raw = zlib.compress(b"".join(rows))
    order = "<" if dtype[0] == "<" else ">"
    fields = [(256, 4, 7), (257, 4, 5), (258, 3, kind.itemsize * 8), (259, 3, 8), (273, 4, 8), (277, 3, samples), (278, 4, 5), (279, 4, len(raw)), (317, 3, 3), (339, 3, 3)]
    at = 8 + len(raw)
    listed = b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "I", v) if k == 4 else struct.pack(order + "HH", v, 0)) for t, k, v in fields)
    content = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + raw + struct.pack(order + "H", len(fields)) + listed + b"\0" * 4
    for band in range(samples):
        (_, _, got), = geotiff.blocks(content, band + 1)
        assert np.array_equal(got, data[:, :, band])


def test_mosaic(spark, cells, tmp_path):
    folder = str(tmp_path / "m")
    holes = cells.where("row < 64 or col < 64")
    assert geotiff.to_mosaic(holes, SPEC, folder, side=64, block=16) == 3
    assert sorted(os.listdir(folder)) == ["0_0.tif", "0_1.tif", "1_0.tif"]
    back, own = geotiff.read_raster(spark, folder + "/*.tif")
    assert own == SPEC
    assert table(back) == table(holes)
    with pytest.raises(ValueError, match="multiples"):
        geotiff.to_mosaic(cells, SPEC, folder, side=60, block=16)
