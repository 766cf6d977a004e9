"""Sources and sinks: round trips, and files made by hand."""

import struct
import zlib

import numpy as np
import pytest

from thalweg.sources import geotiff
from thalweg.sources.ascii import read_ascii, to_ascii
from thalweg.spec import GridSpec


def made(spark, z, affine=(0.5, 0.0, 10.0, 0.0, -0.5, 40.0), nodata=-9999.0, crs="EPSG:4326"):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "row long, col int, z double"), GridSpec(*z.shape, affine, crs, nodata)


def rows(df):
    return sorted((r["row"], r["col"], r["z"]) for r in df.where("z is not null").collect())


@pytest.fixture
def z():
    out = np.random.default_rng(1).normal(size=(40, 70)).round(6)
    out[3, 5] = out[39, 69] = np.nan
    return out


def test_ascii_file(spark, tmp_path):
    path = tmp_path / "g.asc"
    path.write_text("ncols 3\nnrows 2\nxllcorner 1\nyllcorner 2\ncellsize 0.5\nNODATA_value -1\n1 2 3\n4 -1 6e0\n\n")
    cells, spec = read_ascii(spark, str(path))
    assert rows(cells) == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 2, 6.0)]
    assert cells.count() == 6 and spec == GridSpec(2, 3, (0.5, 0.0, 1.0, 0.0, -0.5, 3.0), "EPSG:4326", -1.0)


def test_ascii_in_many_splits(spark, tmp_path, z):
    cells, spec = made(spark, z)
    to_ascii(cells, spec, str(tmp_path / "out"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        back, own = read_ascii(spark, str(tmp_path / "out"))
        assert rows(back) == rows(cells) and back.count() == z.size and own == spec
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ascii_needs_square_cells(spark, tmp_path, z):
    cells, spec = made(spark, z, (0.5, 0.0, 0.0, 0.0, -0.25, 0.0))
    with pytest.raises(ValueError):
        to_ascii(cells, spec, str(tmp_path / "no"))


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("affine", [(0.5, 0.0, 10.0, 0.0, -0.5, 40.0), (0.5, 0.1, 10.0, 0.2, -0.5, 40.0)])
def test_raster_round_trip(spark, tmp_path, z, compress, affine):
    cells, spec = made(spark, z, affine, crs="EPSG:3857")
    path = str(tmp_path / "a.tif")
    geotiff.to_raster(cells.where("row < 20"), spec, path, block=16, compress=compress)
    back, own = geotiff.read_raster(spark, path)
    assert own == spec and rows(back) == rows(cells.where("row < 20")) and back.count() == z.size


def test_raster_window_and_mosaic(spark, tmp_path, z):
    cells, spec = made(spark, z)
    west, east = cells.where("col < 32"), cells.where("col >= 32").selectExpr("row", "col - 32 as col", "z")
    geotiff.to_raster(west, spec.window(0, 0, 40, 32), str(tmp_path / "m" / "1.tif"), block=16)
    geotiff.to_raster(east, spec.window(0, 32, 40, 38), str(tmp_path / "m" / "2.tif"), block=16)
    back, own = geotiff.read_raster(spark, str(tmp_path / "m" / "*.tif"))
    assert own == spec and rows(back) == rows(cells)
    part, small = geotiff.read_raster(spark, str(tmp_path / "m" / "*.tif"), window=(*spec.xy(30, 20), *spec.xy(10, 50)))
    assert small == spec.window(10, 20, 20, 30)
    assert rows(part) == rows(cells.where("row between 10 and 29 and col between 20 and 49").selectExpr("row - 10 as row", "col - 20 as col", "z"))


def packed(codes):
    """LZW codes as a writer packs them; ``codes`` starts with a clear and is short enough for 9 bits."""
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_lzw():
    assert geotiff.unpack_lzw(packed([256, 7, 258, 258, 8, 257])) == bytes([7, 7, 7, 7, 7, 8])


@pytest.mark.parametrize("order", ["<", ">"])
def test_bands_in_strips_with_predictor(order):
    """Three chunky bands, two strips, horizontal differences."""
    data = np.random.default_rng(2).integers(0, 60000, (5, 4, 3)).astype(np.uint16)
    strips = []
    for part in (data[:3], data[3:]):
        diff = np.diff(part.astype(np.int64), axis=1, prepend=0).astype(np.uint16)
        strips.append(zlib.compress(diff.astype(order + "u2").tobytes()))
    offsets = [8, 8 + len(strips[0])]
    end = offsets[1] + len(strips[1])
    tags = [(256, 4, [4]), (257, 4, [5]), (258, 3, [16, 16, 16]), (259, 3, [8]), (273, 4, offsets), (277, 3, [3]), (278, 4, [3]), (279, 4, [len(s) for s in strips]), (317, 3, [2])]
    spare, body, more = end + 2 + 12 * len(tags) + 4, struct.pack(order + "H", len(tags)), b""
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        body += struct.pack(order + "HHI", tag, kind, len(values))
        body += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", spare + len(more))
        more += raw if len(raw) > 4 else b""
    content = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, end) + b"".join(strips) + body + b"\0" * 4 + more
    for band in (1, 2, 3):
        found = np.concatenate([v for _, _, v in geotiff.blocks(content, band)])
        assert (found == data[:, :, band - 1]).all()
    with pytest.raises(ValueError):
        list(geotiff.blocks(content, 4))


def lzw(data):
    """A writer of LZW codes, as wide as its table asks for; it clears the table when that is full."""
    bits, width, table, seen = [], 9, {bytes([i]): i for i in range(256)}, b""
    put = lambda code: bits.append(f"{code:0{width}b}")
    put(256)
    size = 258
    for i in range(len(data)):
        more = seen + data[i : i + 1]
        if more in table:
            seen = more
            continue
        put(table[seen])
        table[more], size = size, size + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        seen = data[i : i + 1]
    put(table[seen])
    size += 1
    width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


@pytest.mark.parametrize("n", [1, 300, 5000, 60000])
def test_lzw_of_wider_codes(n):
    data = np.random.default_rng(n).integers(0, 40, n).astype(np.uint8).tobytes()
    assert geotiff.unpack_lzw(lzw(data)) == data


def test_big_file():
    spec, block = GridSpec(20, 30, (0.5, 0.0, 1.0, 0.0, -0.5, 9.0), "EPSG:32614", -1.0), 16
    tile = [np.full((16, 16), k, "<f4").tobytes() for k in range(4)]
    offsets = [16 + 1024 * k for k in range(4)]
    end = 16 + 4 * 1024
    content = struct.pack("<2sHHHQ", b"II", 43, 8, 0, end) + b"".join(tile) + geotiff.directory(spec, np.dtype("<f4"), block, False, offsets, [1024] * 4, True, end)
    assert geotiff.grid_of(geotiff.parse(content)) == spec
    found = [(r, c, v.shape, set(v.ravel())) for r, c, v in geotiff.blocks(content)]
    assert found == [(0, 0, (16, 16), {0.0}), (0, 16, (16, 14), {1.0}), (16, 0, (4, 16), {2.0}), (16, 16, (4, 14), {3.0})]


def test_planar_bands():
    tags = [(256, 4, 2), (257, 4, 2), (258, 3, 8), (277, 3, 2), (278, 4, 2), (284, 3, 2)]
    data = bytes(range(8))
    at = 16
    lists = struct.pack("<2I", 24 + 16, 28 + 16) + struct.pack("<2I", 4, 4)
    start = at + len(lists) + 8 + len(data)
    body = struct.pack("<H", 8)
    for tag, kind, n, v in sorted([(t, k, 1, v) for t, k, v in tags] + [(273, 4, 2, at), (279, 4, 2, at + 8)]):
        body += struct.pack("<HHII", tag, kind, n, v)
    content = (struct.pack("<2sHI", b"II", 42, start).ljust(16, b"\0") + lists).ljust(40, b"\0") + data
    content = content.ljust(start, b"\0") + body + b"\0" * 4
    assert [next(geotiff.blocks(content, b))[2].tolist() for b in (1, 2)] == [[[0, 1], [2, 3]], [[4, 5], [6, 7]]]
