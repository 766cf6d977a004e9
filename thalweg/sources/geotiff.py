"""GeoTIFF rasters, read and written with the standard library and NumPy.

A raster may be one file or many of the same cell size (a mosaic). Tasks read the files' heads, each a few short ranges; what they
list of blocks (tiles or strips) is dealt out, and each block is read by its range and decoded where it is needed. So a large file is
many tasks' work, and blocks that no cell is asked of are never read.
"""

from __future__ import annotations

import re
import struct
import uuid
import warnings
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions.crs import transform_point
from thalweg.plans.loops import pinned
from thalweg.spec import GridSpec

# The format's field types (size, struct code) and the tags in use.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, TRANSFORM, GEOKEYS, NODATA = 33550, 33922, 34264, 34735, 42113


#: Reads so many bytes from an offset on.
Reader = Callable[[int, int], bytes]


def reader_of(content: bytes) -> Reader:
    return lambda at, n: content[at : at + n]


def opened(path: str):
    """A file for random access, on any file system that Arrow knows by the path's scheme."""
    system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{path}")
    return system.open_input_file(name)


def parse(content: bytes | Reader) -> dict:
    """The first image's tags, with ``order``: the byte order."""
    read = content if callable(content) else reader_of(content)
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", head, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    step, lead, room = (20, 8, 8) if big else (12, 2, 4)
    n = struct.unpack(order + ("Q" if big else "H"), read(at, lead))[0]
    listed = read(at + lead, n * step)
    tags: dict = {"order": order}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), listed, k * step)
        size, code = TYPES.get(kind, (1, "s"))
        raw = listed[(k + 1) * step - room : (k + 1) * step]
        if size * count > room:
            raw = read(struct.unpack(order + ("Q" if big else "I"), raw)[0], size * count)
        if code == "s":
            tags[tag] = raw[:count].rstrip(b"\0").decode("latin-1")
        else:
            tags[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", raw)
    return tags


def grid_of(tags: dict) -> GridSpec:
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in tags:
        sx, sy = tags[SCALE][:2]
        i, j, _, x, y, _ = tags[TIEPOINT][:6]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        affine = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    keys = tags.get(GEOKEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    epsg = codes.get(3072) or codes.get(2048) or 4326
    nodata = float(tags[NODATA].strip()) if tags.get(NODATA, "").strip() else float("nan")
    return GridSpec(tags[HEIGHT][0], tags[WIDTH][0], tuple(float(v) for v in affine), f"EPSG:{epsg}", nodata)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's variable-length codes, highest bit first; 256 clears the table, 257 ends."""
    out, table, last, width, held, bits = [], [], None, 9, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], None, 9
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


class Layout:
    """Where the blocks of a band are in a file, and how to decode them."""

    def __init__(self, tags: dict, band: int = 1):
        self.height, self.width = tags[HEIGHT][0], tags[WIDTH][0]
        samples = tags.get(SAMPLES, (1,))[0]
        if not 1 <= band <= samples:
            raise ValueError(f"there are {samples} bands, not a band {band}")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
        self.dtype = np.dtype(f"{tags['order']}{kind}{tags[BITS][0] // 8}")
        self.tiled = TILE_OFFSETS in tags
        self.bw, self.bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if self.tiled else (self.width, min(tags.get(ROWS_PER_STRIP, (self.height,))[0], self.height))
        self.offsets, self.counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if self.tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
        self.across, self.down = -(-self.width // self.bw), -(-self.height // self.bh)
        apart = tags.get(PLANAR, (1,))[0] == 2 and samples > 1
        self.depth = 1 if apart or samples == 1 else samples
        self.first = (band - 1) * self.across * self.down if apart else 0
        self.sample = 0 if self.depth == 1 else band - 1
        self.compression, self.predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
        if self.compression not in (1, 5, 8, 32946):
            raise ValueError(f"compression {self.compression} isn't supported")
        if self.predictor not in (1, 2, 3) or self.predictor == 3 and kind != "f":
            raise ValueError(f"predictor {self.predictor} isn't supported")

    def block(self, k: int) -> tuple[int, int, int, int, int, int]:
        """row, col, end row, end col (in the raster), offset and bytes of the k-th block."""
        row, col = k // self.across * self.bh, k % self.across * self.bw
        return row, col, min(row + self.bh, self.height), min(col + self.bw, self.width), self.offsets[self.first + k], self.counts[self.first + k]

    def decode(self, raw: bytes, row: int, col: int) -> np.ndarray:
        """The values of the block at (row, col); a block without bytes is zeros."""
        rows = self.bh if self.tiled else min(self.bh, self.height - row)
        if not raw:
            data = np.zeros((rows, self.bw), self.dtype)
        else:
            raw = raw if self.compression == 1 else unpack_lzw(raw) if self.compression == 5 else zlib.decompress(raw)
            if self.predictor == 3:  # bytes in planes from the highest on, each row a running sum
                size = self.dtype.itemsize
                planes = np.frombuffer(raw, np.uint8, rows * self.bw * self.depth * size).reshape(rows, -1, self.depth).cumsum(axis=1, dtype=np.uint8)
                data = np.ascontiguousarray(planes.reshape(rows, size, -1).transpose(0, 2, 1)).view(f">f{size}").reshape(rows, self.bw, self.depth)
            else:
                data = np.frombuffer(raw, self.dtype, rows * self.bw * self.depth).reshape(rows, self.bw, self.depth)
            if self.predictor == 2:
                data = np.cumsum(data, axis=1, dtype=self.dtype.newbyteorder("="))
            data = data[:, :, self.sample]
        return data[: self.height - row, : self.width - col]


def blocks(content: bytes | Reader, band: int = 1, wanted: tuple[int, int, int, int] | None = None):
    """(row, col, values) of each tile or strip of ``band`` that meets ``wanted`` (row, col, end row, end column)."""
    read = content if callable(content) else reader_of(content)
    layout = Layout(parse(read), band)
    for k in range(layout.across * layout.down):
        row, col, end, right, offset, count = layout.block(k)
        if wanted and (row >= wanted[2] or col >= wanted[3] or end <= wanted[0] or right <= wanted[1]):
            continue
        yield row, col, layout.decode(read(offset, count) if count else b"", row, col)


INSIDE, OUTSIDE, CROSSED = "inside", "outside", "crossed"


class Mask:
    """The cells whose centres lie in a shape, by the even-odd rule over all its rings (lists of (x, y))."""

    def __init__(self, rings: list[list[tuple[float, float]]], spec: GridSpec):
        a, b, c, d, e, f = spec.inverse()
        starts, ends = [], []
        for ring in rings:
            p = np.array([(a * x + b * y + c, d * x + e * y + f) for x, y, *_ in ring], dtype=float).reshape(-1, 2)
            starts.append(p)
            ends.append(np.roll(p, -1, axis=0))
        self.p, self.q = np.concatenate([*starts, np.zeros((0, 2))]), np.concatenate([*ends, np.zeros((0, 2))])

    def of(self, row: int, col: int, end: int, right: int) -> np.ndarray:
        """Which cells of a block are inside: crossings of each row's middle, and their parity from the left."""
        out = np.zeros((end - row, right - col + 1), dtype=np.int64)
        for (x, y), (u, v) in zip(self.p.tolist(), self.q.tolist(), strict=True):
            if y == v:
                continue
            low, high = min(y, v), max(y, v)
            r = np.arange(max(row, int(np.ceil(low - 0.5))), min(end, int(np.ceil(high - 0.5))))  # low <= r + 1/2 < high
            if len(r):
                at = x + (r + 0.5 - y) * (u - x) / (v - y)
                np.add.at(out, (r - row, np.clip(np.ceil(at - 0.5).astype(np.int64), col, right) - col), 1)
        return out.cumsum(axis=1)[:, :-1] % 2 == 1

    def kind(self, row: int, col: int, end: int, right: int) -> str:
        """Whether a block lies inside, outside, or is crossed by a side."""
        mid, half = np.array([(col + right) / 2, (row + end) / 2]), np.array([(right - col) / 2, (end - row) / 2])
        centre, reach = (self.p + self.q) / 2 - mid, np.abs(self.p - self.q) / 2
        side = self.q - self.p
        across = np.abs(side[:, 0] * centre[:, 1] - side[:, 1] * centre[:, 0]) <= half[0] * np.abs(side[:, 1]) + half[1] * np.abs(side[:, 0])
        if ((np.abs(centre) <= half + reach).all(axis=1) & across).any():
            return CROSSED
        return INSIDE if self.of(row, col, row + 1, col + 1)[0, 0] else OUTSIDE


def rings_of(geometry) -> list[list[tuple[float, float]]]:
    """The rings of GeoJSON polygons: one, several, or what features hold."""
    if isinstance(geometry, (list, tuple)):
        return [r for g in geometry for r in rings_of(g)]
    geometry = geometry.get("geometry", geometry)
    if geometry["type"] == "GeometryCollection":
        return rings_of(geometry["geometries"])
    if geometry["type"] not in ("Polygon", "MultiPolygon"):
        raise ValueError(f"a mask is made of polygons, not of a {geometry['type']}")
    return [list(r) for part in ([geometry["coordinates"]] if geometry["type"] == "Polygon" else geometry["coordinates"]) for r in part]


def _outside(row: int, col: int, end: int, right: int, dr: int, dc: int, frame: tuple[int, int, int, int]) -> bool:
    return row + dr >= frame[2] or col + dc >= frame[3] or end + dr <= frame[0] or right + dc <= frame[1]


def read_raster(spark: SparkSession, path: str, *, band: int = 1, window: tuple[float, float, float, float] | None = None, window_crs: str | None = None, nodata: float | None = None, mask_geometry=None, value: str = "z") -> tuple[DataFrame, GridSpec]:
    """row, col, ``value`` (null where nodata) of the raster at ``path`` (a file, a folder or a pattern) and its spec.

    ``window`` is (xmin, ymin, xmax, ymax), in ``window_crs`` if given: only blocks that meet it are decoded. The files of a
    mosaic have one cell size and system, and don't overlap. With ``mask_geometry`` (GeoJSON polygons in the raster's system) cells whose
    centres lie outside are null, and blocks outside aren't read; a mask without cells is left out with a warning.
    Arrow has to know the path's file system.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def heads(batches):
        for batch in batches:
            specs = []
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    specs.append(grid_of(parse(lambda at, n, f=file: f.read_at(n, at))))
            yield pa.RecordBatch.from_pylist([{**{n: v for n, v in zip("abcdef", s.affine, strict=True)}, "nrows": s.nrows, "ncols": s.ncols, "crs": s.crs, "nodata": s.nodata} for s in specs], HEAD)

    h = files.mapInArrow(heads, ", ".join(f"{n} double" for n in "abcdef") + ", nrows long, ncols long, crs string, nodata double")
    east, north = F.sum(F.signum("a")) >= 0, F.sum(F.signum("e")) < 0
    end_x, end_y = F.col("c") + F.col("a") * F.col("ncols"), F.col("f") + F.col("e") * F.col("nrows")
    s = h.agg(
        F.count("*").alias("n"), *[F.min(x).alias(x) for x in ("a", "b", "d", "e", "crs", "nodata")], F.max("a").alias("a1"), F.max("e").alias("e1"), F.max("crs").alias("crs1"), F.max(F.abs("b") + F.abs("d")).alias("turn"),
        F.when(east, F.min("c")).otherwise(F.max("c")).alias("c"), F.when(east, F.max(end_x)).otherwise(F.min(end_x)).alias("x"),
        F.when(north, F.max("f")).otherwise(F.min("f")).alias("f"), F.when(north, F.min(end_y)).otherwise(F.max(end_y)).alias("y"), F.max("nrows").alias("nrows"), F.max("ncols").alias("ncols"),
    ).head()
    if not s["n"]:
        raise ValueError(f"{path} has no files")
    if s["n"] > 1 and (s["turn"] or s["crs"] != s["crs1"] or abs(s["a"] - s["a1"]) > 1e-9 * abs(s["a"]) or abs(s["e"] - s["e1"]) > 1e-9 * abs(s["e"])):
        raise ValueError("the files of a mosaic have one cell size and coordinate system and aren't rotated")
    nrows, ncols = (s["nrows"], s["ncols"]) if s["n"] == 1 else (round((s["y"] - s["f"]) / s["e"]), round((s["x"] - s["c"]) / s["a"]))
    whole = GridSpec(nrows, ncols, (s["a"], s["b"], s["c"], s["d"], s["e"], s["f"]), s["crs"], s["nodata"] if nodata is None else float(nodata))
    r0, c0, r1, c1 = 0, 0, nrows, ncols
    if window is not None:
        x0, y0, x1, y1 = window
        at = [transform_point(x, y, window_crs or whole.crs, whole.crs) for x in (x0, x1) for y in (y0, y1)]
        i = whole.inverse()
        cols, rows = [i[0] * x + i[1] * y + i[2] for x, y in at], [i[3] * x + i[4] * y + i[5] for x, y in at]
        r0, r1, c0, c1 = max(0, round(min(rows))), min(nrows, round(max(rows))), max(0, round(min(cols))), min(ncols, round(max(cols)))
        if r0 >= r1 or c0 >= c1:
            raise ValueError("the window is outside the raster")
    spec = whole.window(r0, c0, r1 - r0, c1 - c0)

    frame = (r0, c0, r1, c1)
    mask = Mask(rings_of(mask_geometry), whole) if mask_geometry else None

    def listed(batches):
        """A row for each block of a file that has cells in the frame: where it is, and what the mask makes of it."""
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    tags = parse(lambda at, n, f=file: f.read_at(n, at))
                own, layout = grid_of(tags), Layout(tags, band)
                dr = 0 if own.affine[4] == 0 else round((own.affine[5] - whole.affine[5]) / own.affine[4])
                dc = 0 if own.affine[0] == 0 else round((own.affine[2] - whole.affine[2]) / own.affine[0])
                rows = []
                for k in range(layout.across * layout.down):
                    row, col, end, right, offset, count = layout.block(k)
                    if not _outside(row, col, end, right, dr, dc, frame):
                        kind = mask.kind(row + dr, col + dc, end + dr, right + dc) if mask else INSIDE
                        rows.append({"path": name, "row": row, "col": col, "dr": dr, "dc": dc, "height": end - row, "width": right - col, "offset": offset, "bytes": count, "nodata": own.nodata, "kind": kind})
                yield pa.RecordBatch.from_pylist(rows, BLOCK)

    found = pinned(files.mapInArrow(listed, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'double' if f.type == pa.float64() else 'long'}" for f in BLOCK)), "blocks")

    def places(b):
        """Rows and columns of the block's cells in the frame, as slices of the block and as numbers from the frame's corner."""
        row, col = b["row"] + b["dr"], b["col"] + b["dc"]
        top, left, bottom, right = max(row, r0), max(col, c0), min(row + b["height"], r1), min(col + b["width"], c1)
        return top, left, bottom, right, slice(top - row, bottom - row), slice(left - col, right - col)

    if mask and found.where(F.col("kind") == INSIDE).isEmpty():

        def held(batches):
            for batch in batches:
                any_ = [bool(mask.of(*places(b)[:4]).any()) for b in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(any_)], ["held"])

        if found.where(F.col("kind") == CROSSED).mapInArrow(held, "held boolean").where("held").isEmpty():
            warnings.warn("the mask holds no cell and is left out", stacklevel=2)
            mask, found = None, found.withColumn("kind", F.lit(INSIDE))
    shown = mask  # what the tasks get

    def run(batches):
        name, file, layout = None, None, None
        for batch in batches:
            for b in batch.to_pylist():
                top, left, bottom, right, rows, cols = places(b)
                if b["kind"] == OUTSIDE:
                    v = np.full((bottom - top, right - left), np.nan)
                else:
                    if b["path"] != name:
                        name, file = b["path"], opened(b["path"])
                        layout = Layout(parse(lambda at, n, f=file: f.read_at(n, at)), band)
                    v = layout.decode(file.read_at(b["bytes"], b["offset"]) if b["bytes"] else b"", b["row"], b["col"])[rows, cols].astype(np.float64)
                    if b["kind"] == CROSSED:
                        v[~shown.of(top, left, bottom, right)] = np.nan
                rr, cc = np.mgrid[top - r0 : bottom - r0, left - c0 : right - c0]
                v = v.ravel()
                none = b["nodata"] if nodata is None else float(nodata)
                yield pa.RecordBatch.from_arrays([pa.array(rr.ravel().astype(np.int64)), pa.array(cc.ravel().astype(np.int32)), pa.array(v, mask=np.isnan(v) | (v == none))], ["row", "col", "z"])

    cells = found.agg(F.sum(F.when(F.col("kind") != OUTSIDE, F.col("height") * F.col("width")).otherwise(0))).head()[0] or 0
    dealt = found.repartitionByRange(max(1, min(100_000, -(-cells // TASK_CELLS))), "path", "offset")
    return dealt.mapInArrow(run, "row long, col int, z double").withColumnRenamed("z", value), spec


#: Cells that a task decodes.
TASK_CELLS = 1 << 22
BLOCK = pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("row", "col", "dr", "dc", "height", "width", "offset", "bytes")], ("nodata", pa.float64()), ("kind", pa.string())])
HEAD = pa.schema([*[(n, pa.float64()) for n in "abcdef"], ("nrows", pa.int64()), ("ncols", pa.int64()), ("crs", pa.string()), ("nodata", pa.float64())])


def directory(spec: GridSpec, dtype: np.dtype, block: int, compress: bool, offsets: list[int], counts: list[int], big: bool, start: int) -> bytes:
    """The image file directory, to be put at ``start``."""
    a, b, c, d, e, f = spec.affine
    code = int(spec.crs.split(":")[1]) if spec.crs.upper().startswith("EPSG:") else 4326
    model, key = (2, 2048) if code in (4326, 4269) else (1, 3072)
    long = 16 if big else 4
    fields = [
        (WIDTH, 4, [spec.ncols]), (HEIGHT, 4, [spec.nrows]), (BITS, 3, [dtype.itemsize * 8]), (COMPRESSION, 3, [8 if compress else 1]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]),
        (TILE_WIDTH, 4, [block]), (TILE_HEIGHT, 4, [block]), (TILE_OFFSETS, long, offsets), (TILE_COUNTS, long, counts), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[dtype.kind]]),
    ]
    if b or d or a < 0 or e > 0:
        fields += [(TRANSFORM, 12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    else:
        fields += [(SCALE, 12, [a, -e, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, c, f, 0.0])]
    fields += [(GEOKEYS, 3, [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, key, 0, 1, code]), (NODATA, 2, f"{spec.nodata:.17g}".encode() + b"\0")]
    fields.sort(key=lambda x: x[0])
    room = 8 if big else 4
    spare = start + (8 if big else 2) + len(fields) * (20 if big else 12) + room
    out, more = struct.pack("<Q" if big else "<H", len(fields)), b""
    for tag, kind, values in fields:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
        out += struct.pack("<HHQ" if big else "<HHI", tag, kind, len(values))
        if len(raw) <= room:
            out += raw.ljust(room, b"\0")
        else:
            out += struct.pack("<Q" if big else "<I", spare + len(more))
            more += raw + b"\0" * (-len(raw) % 8)
    return out + b"\0" * room + more


def to_raster(cells: DataFrame, spec: GridSpec, path: str, *, value: str = "z", dtype: str = "float64", block: int = 256, compress: bool = True) -> None:
    """Write one tiled GeoTIFF to ``path``, on any file system of the session. Null and missing cells are nodata.

    Tiles are encoded in the executors. The file's index (16 bytes a tile) and one tile at a time pass through the
    driver. Over 4 GB it is a BigTIFF.
    """
    if block % 16:
        raise ValueError("the sides of blocks are multiples of 16")
    spark, kind = cells.sparkSession, np.dtype("<" + np.dtype(dtype).str[1:]) if np.dtype(dtype).itemsize > 1 else np.dtype(dtype)
    across, down, fill = -(-spec.ncols // block), -(-spec.nrows // block), spec.nodata

    def encode(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        data = np.full((block, block), fill).astype(kind)
        data[part["row"].to_numpy() % block, part["col"].to_numpy() % block] = part["v"].to_numpy().astype(kind)
        raw = data.tobytes()
        return pd.DataFrame({"tile": [key[0]], "data": [zlib.compress(raw) if compress else raw]})

    inside = cells.where(F.col("row").between(0, spec.nrows - 1) & F.col("col").between(0, spec.ncols - 1) & F.col(value).isNotNull())
    tile = (F.floor(F.col("row") / block) * across + F.floor(F.col("col") / block)).cast("long")
    made = inside.select(tile.alias("tile"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v")).groupBy("tile").applyInPandas(encode, "tile long, data binary")
    made = pinned(made, "tiles")
    sizes = {r["tile"]: r["n"] for r in made.select("tile", F.length("data").alias("n")).toLocalIterator()}
    empty = np.full((block, block), fill).astype(kind).tobytes()
    empty = zlib.compress(empty) if compress else empty
    counts = [sizes.get(t, len(empty)) for t in range(across * down)]
    big = sum(sizes.values()) + len(empty) + 40 * len(counts) > (1 << 32) - (1 << 16)
    at = lead = 16 if big else 8
    offsets = [0] * len(counts)
    for t in sorted(sizes):
        offsets[t], at = at, at + sizes[t]
    if len(sizes) < len(counts):  # tiles without data share one block
        offsets = [o or at for o in offsets]
        at += len(empty)
    at += -at % 8
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)))
        done = lead
        for r in made.orderBy("tile").select("data").toLocalIterator():
            stream.write(bytearray(r["data"]))
            done += len(r["data"])
        if len(sizes) < len(counts):
            stream.write(bytearray(empty))
            done += len(empty)
        stream.write(bytearray(b"\0" * (at - done) + directory(spec, kind, block, compress, offsets, counts, big, at)))
    finally:
        stream.close()


def to_mosaic(cells: DataFrame, spec: GridSpec, folder: str, *, value: str = "z", dtype: str = "float64", side: int = 2048, block: int = 256, compress: bool = True) -> int:
    """Write a mosaic of GeoTIFFs of ``side`` x ``side`` cells to ``folder`` (a new one, on a file system that Arrow knows), and return
    how many. Null and missing cells are nodata; where a file would have no cell with data, there is none.

    Tasks write each file under a name of their own attempt and tell it; the driver then moves those that were told to their
    final names and takes the rest away, so tasks that are run twice or lost leave nothing behind. No cell passes the driver."""
    if block % 16 or side % block:
        raise ValueError("the sides of blocks are multiples of 16, and those of files multiples of blocks'")
    kind = np.dtype("<" + np.dtype(dtype).str[1:]) if np.dtype(dtype).itemsize > 1 else np.dtype(dtype)
    folder = folder.rstrip("/")
    begun = f"{folder}/_attempts-{uuid.uuid4().hex}"

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * side, int(key[1]) * side
        own = spec.window(r0, c0, min(side, spec.nrows - r0), min(side, spec.ncols - c0))
        across, down = -(-own.ncols // block), -(-own.nrows // block)
        data = np.full((down * block, across * block), spec.nodata).astype(kind)
        data[part["row"].to_numpy() - r0, part["col"].to_numpy() - c0] = part["v"].to_numpy().astype(kind)
        made = [data[r : r + block, c : c + block].tobytes() for r in range(0, down * block, block) for c in range(0, across * block, block)]
        made = [zlib.compress(x) for x in made] if compress else made
        counts = [len(x) for x in made]
        big = sum(counts) + 40 * len(counts) > (1 << 32) - (1 << 16)
        offsets = (np.cumsum([0, *counts[:-1]]) + (16 if big else 8)).tolist()
        end = offsets[-1] + counts[-1]
        at = end + -end % 8
        head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
        name = f"{key[0]}_{key[1]}-{uuid.uuid4().hex}.tif"
        system, at_path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", begun) if ":" in begun else f"file://{begun}")
        system.create_dir(at_path)
        with system.open_output_stream(f"{at_path}/{name}") as out:
            for x in (head, *made, b"\0" * (at - end), directory(own, kind, block, compress, offsets, counts, big, at)):
                out.write(x)
        return pd.DataFrame({"name": [name], "final": [f"{key[0]}_{key[1]}.tif"]})

    inside = cells.where(F.col("row").between(0, spec.nrows - 1) & F.col("col").between(0, spec.ncols - 1) & F.col(value).isNotNull())
    at = [F.floor(F.col("row") / side).cast("long").alias("r"), F.floor(F.col("col") / side).cast("long").alias("c")]
    told = inside.select(*at, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v")).groupBy("r", "c").applyInPandas(write, "name string, final string")
    told = pinned(told, "written")
    spark = cells.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for r in told.toLocalIterator():  # names only
        if not system.rename(hadoop(f"{begun}/{r['name']}"), hadoop(f"{folder}/{r['final']}")):
            raise OSError(f"{folder}/{r['final']} could not be put in place")
        n += 1
    system.delete(hadoop(begun), True)
    return n
