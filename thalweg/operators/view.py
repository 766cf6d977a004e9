"""Views of a raster on another grid, clipping, snapping and vectors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thalweg.functions.crs import transform
from thalweg.functions.geometry import cell_id
from thalweg.operators.condition import connected_labels
from thalweg.plans.loops import pinned
from thalweg.spec import GridSpec


def _corner(spec: GridSpec) -> tuple[Column, Column]:
    """(x, y) of the corner of the cell at row, col."""
    a, b, c, d, e, f = spec.affine
    col, row = F.col("col").cast("double"), F.col("row").cast("double")
    return F.lit(a) * col + F.lit(b) * row + F.lit(c), F.lit(d) * col + F.lit(e) * row + F.lit(f)


def _source(spec: GridSpec, target: GridSpec) -> tuple[Column, Column]:
    """Fractional (row, col) in ``spec`` of the target's cells."""
    x, y = transform(*_corner(target), target.crs, spec.crs)
    a, b, c, d, e, f = spec.inverse()
    return F.lit(d) * x + F.lit(e) * y + F.lit(f), F.lit(a) * x + F.lit(b) * y + F.lit(c)


def view(cells: DataFrame, spec: GridSpec, target: GridSpec, interpolation: str = "nearest", value: str = "z") -> DataFrame:
    """row, col, ``value`` on the target grid; null where the data doesn't reach. Nearest goes half to even; linear blends four
    cells, those beyond the last row or column counting as the last; it is null where one that counts has no data."""
    if interpolation not in ("nearest", "linear"):
        raise ValueError(f"interpolation must be 'nearest' or 'linear', not {interpolation!r}")
    if spec.congruent(target):
        return cells.select("row", "col", value)
    grid = cells.sparkSession.range(target.size).select(F.floor(F.col("id") / target.ncols).cast("long").alias("row"), F.pmod("id", F.lit(target.ncols)).cast("int").alias("col"))
    sr, sc = _source(spec, target)
    at = grid.select("row", "col", sr.alias("sr"), sc.alias("sc"))
    data = cells.select(F.col("row").cast("long").alias("r"), F.col("col").cast("int").alias("c"), F.col(value).alias("v"))
    if interpolation == "nearest":
        # what has no place, or is too far off for an integer, meets no cell
        near = lambda at, own: F.rint(F.least(F.greatest(F.coalesce(at, -1.0 - F.col(own)), F.lit(1.0 - 2**31)), F.lit(2**31 - 1.0)))
        at = at.select("row", "col", near("sr", "row").cast("long").alias("r"), near("sc", "col").cast("int").alias("c"))
        return at.join(data, ["r", "c"], "left").select("row", "col", F.col("v").alias(value))
    inside = (F.col("sr") >= 0) & (F.col("sr") < spec.nrows) & (F.col("sc") >= 0) & (F.col("sc") < spec.ncols)
    r, c = F.floor("sr").cast("long"), F.floor("sc").cast("int")
    tr, tc = F.when(r >= spec.nrows - 1, 0.0).otherwise(F.col("sr") - r), F.when(c >= spec.ncols - 1, 0.0).otherwise(F.col("sc") - c)
    down, right = F.least(r + 1, F.lit(spec.nrows - 1)), F.least(c + 1, F.lit(spec.ncols - 1))
    corner = lambda rr, cc, w: F.struct(rr.cast("long").alias("r"), cc.cast("int").alias("c"), w.alias("w"))
    four = F.array(corner(r, c, (1 - tr) * (1 - tc)), corner(r, right, (1 - tr) * tc), corner(down, c, tr * (1 - tc)), corner(down, right, tr * tc))
    ask = at.where(inside).select("row", "col", F.explode(four).alias("x")).select("row", "col", "x.*")
    missing = F.max(((F.col("w") > 0) & F.col("v").isNull()).cast("int"))
    mixed = ask.join(data, ["r", "c"], "left").groupBy("row", "col").agg(F.when(missing == 0, F.sum(F.col("w") * F.col("v"))).alias(value))
    return grid.join(mixed, ["row", "col"], "left").select("row", "col", value)


def clip_to(cells: DataFrame, spec: GridSpec, pad: tuple[int, int, int, int] = (0, 0, 0, 0), value: str = "z") -> tuple[DataFrame, GridSpec]:
    """The smallest window with all data, padded (left, bottom, right, top), and its grid; one aggregation finds it."""
    low = cells.where(F.col(value).isNotNull()).agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).head()
    if low[0] is None:
        return cells.select("row", "col", value), spec
    left, bottom, right, top = pad
    r0, r1, c0, c1 = low[0] - top, low[1] + bottom, low[2] - left, low[3] + right
    out = cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return out.select((F.col("row") - r0).cast("long").alias("row"), (F.col("col") - c0).cast("int").alias("col"), value), spec.window(r0, c0, r1 - r0 + 1, c1 - c0 + 1)


def nearest_cell(points: DataFrame, spec: GridSpec, snap: str = "corner") -> DataFrame:
    """``points`` (x, y) with the ``col`` and ``row`` of the nearest corner (half to even) or of the cell that holds them."""
    a, b, c, d, e, f = spec.inverse()
    col, row = F.lit(a) * F.col("x") + F.lit(b) * F.col("y") + F.lit(c), F.lit(d) * F.col("x") + F.lit(e) * F.col("y") + F.lit(f)
    near = {"corner": F.rint, "center": F.floor}[snap]
    return points.withColumn("col", near(col).cast("int")).withColumn("row", near(row).cast("long"))


def snap_to_mask(mask: DataFrame, points: DataFrame, spec: GridSpec, box: int = 16) -> DataFrame:
    """``points`` (pid, x, y) with ``sx``, ``sy`` and ``dist`` of the nearest cell (its corner) of ``mask`` (row, col); of equals the
    first by row, then column.

    The mask's cells make a pyramid of boxes that hold any, four times as wide on each level. A point goes down from the box that holds
    all, on each level to the boxes that may be nearer than what another one holds for certain: as many rounds as the logarithm of the
    grid's width, however far the nearest cell is.
    """
    a, b, c, d, e, f = spec.affine
    corners = [spec.xy(r, q) for r in (0, spec.nrows) for q in (0, spec.ncols)]
    (x0, x1), (y0, y1) = [(min(v), max(v)) for v in zip(*corners, strict=True)]
    col, row = F.col("col").cast("double"), F.col("row").cast("double")
    cells = mask.select("row", "col", (F.lit(a) * col + F.lit(b) * row + F.lit(c)).alias("sx"), (F.lit(d) * col + F.lit(e) * row + F.lit(f)).alias("sy"))
    w, h = box * (abs(a) + abs(b)), box * (abs(d) + abs(e))
    cells = cells.withColumn("bx", F.floor((F.col("sx") - x0) / w)).withColumn("by", F.floor((F.col("sy") - y0) / h))
    ends = [F.min("lx").alias("lx"), F.max("hx").alias("hx"), F.min("ly").alias("ly"), F.max("hy").alias("hy")]
    leaves = cells.groupBy("bx", "by").agg(F.min("sx").alias("lx"), F.max("sx").alias("hx"), F.min("sy").alias("ly"), F.max("sy").alias("hy"))
    levels = [pinned(leaves, "boxes")]
    across = 1 + int(max((x1 - x0) / w, (y1 - y0) / h))
    while across > 1:
        up = [F.floor(F.col(k) / 4).alias(k) for k in ("bx", "by")]
        levels.append(levels[-1].groupBy(*up).agg(*ends))
        across = -(-across // 4)
    own = Window.partitionBy("pid", "x", "y")
    square = lambda u, v: u * u + v * v
    at = points.select("pid", "x", "y", F.lit(0).cast("long").alias("bx"), F.lit(0).cast("long").alias("by"))
    for level in reversed(levels[:-1]):
        x, y = F.col("x"), F.col("y")
        near = square(F.greatest(F.col("lx") - x, x - F.col("hx"), F.lit(0.0)), F.greatest(F.col("ly") - y, y - F.col("hy"), F.lit(0.0)))
        far = square(F.greatest(F.abs(x - F.col("lx")), F.abs(x - F.col("hx"))), F.greatest(F.abs(y - F.col("ly")), F.abs(y - F.col("hy"))))
        below = level.select(F.floor(F.col("bx") / 4).alias("ux"), F.floor(F.col("by") / 4).alias("uy"), F.col("bx").alias("nx"), F.col("by").alias("ny"), "lx", "hx", "ly", "hy")
        met = at.join(below, (F.col("bx") == F.col("ux")) & (F.col("by") == F.col("uy"))).select("pid", "x", "y", F.col("nx").alias("bx"), F.col("ny").alias("by"), near.alias("near"), far.alias("far"))
        at = met.withColumn("least", F.min("far").over(own)).where(F.col("near") <= F.col("least") * (1 + 1e-9)).select("pid", "x", "y", "bx", "by")
    dist = F.sqrt(square(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")))
    best = at.join(cells, ["bx", "by"]).groupBy("pid", "x", "y").agg(F.min(F.struct(dist.alias("dist"), "row", "col", "sx", "sy")).alias("m"))
    return best.where("m.dist is not null").select("pid", "x", "y", "m.sx", "m.sy", "m.dist")


def rasterize(shapes: DataFrame, spec: GridSpec, fill: float = 0.0, all_touched: bool = False, default_value: float = 1.0, mask: DataFrame | None = None, dtype: str = "double", band: int = 64) -> DataFrame:
    """row, col, ``z``: the value of the last shape (sid, ``ring``: array of (x, y) structs, or ``rings``: an array of such; value, else
    ``default_value``) that holds the cell's centre by the even-odd rule over all its rings, else ``fill``. With ``all_touched`` a shape
    also has the cells that its sides touch; with ``mask`` (row, col) only its cells are burned.

    Each side is dealt to bands of rows, and met by the rows that it crosses. A row's crossings of a shape, in order, are where it enters and leaves it, so the work
    is that of the crossings and of the cells inside.
    """
    a, b, c, d, e, f = spec.inverse()
    rings = F.col("rings") if "rings" in shapes.columns else F.array("ring")
    value = F.col("value") if "value" in shapes.columns else F.lit(default_value)

    def sides_of(r: Column) -> Column:
        last = lambda i: F.get(r, F.when(i == 0, F.size(r) - 1).otherwise(i - 1))
        return F.transform(r, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), last(i)["x"].alias("xj"), last(i)["y"].alias("yj")))

    at = lambda x, y: (F.lit(a) * F.col(x) + F.lit(b) * F.col(y) + F.lit(c), F.lit(d) * F.col(x) + F.lit(e) * F.col(y) + F.lit(f))
    least = lambda p, q, r: F.floor(F.array_min(F.transform(F.flatten(rings), lambda s: F.lit(p) * s["x"] + F.lit(q) * s["y"] + F.lit(r))))
    sides = shapes.select("sid", value.cast(dtype).alias("value"), least(a, b, c).alias("c_least"), least(d, e, f).alias("r_least"), F.explode(F.flatten(F.transform(rings, sides_of))).alias("s")).select("sid", "value", "c_least", "r_least", "s.*")
    (u1, v1), (u2, v2) = at("x", "y"), at("xj", "yj")
    sides = sides.select("*", u1.alias("u"), v1.alias("v"), u2.alias("uj"), v2.alias("vj")).where("u is not null and v is not null and uj is not null and vj is not null")
    turned = bool(spec.affine[1] or spec.affine[3])
    if turned:  # rows are no lines of equal y there, so cells are the units
        sides = sides.withColumns({"x": F.col("u"), "y": F.col("v"), "xj": F.col("uj"), "yj": F.col("vj")})
    (dx, x0), (dy, y0) = ((1.0, 0.0), (1.0, 0.0)) if turned else ((spec.affine[0], spec.affine[2]), (spec.affine[4], spec.affine[5]))
    low, high = F.least("v", "vj"), F.greatest("v", "vj")

    def in_rows(df: DataFrame, first: Column, last: Column) -> DataFrame:
        first, last = F.greatest(first, F.lit(0)).cast("long"), F.least(last, F.lit(spec.nrows - 1)).cast("long")
        dealt = df.withColumns({"r0": first, "r1": last}).where("r0 <= r1").withColumn("__b", F.explode(F.sequence(F.floor(F.col("r0") / band), F.floor(F.col("r1") / band)))).repartition("sid", "__b")
        return dealt.withColumn("row", F.explode(F.sequence(F.greatest("r0", F.col("__b") * band), F.least("r1", F.col("__b") * band + band - 1))))

    py = (F.col("row") + 0.5) * dy + y0
    across = in_rows(sides, F.floor(low - 0.5), F.ceil(high - 0.5)).where((F.col("y") > py) != (F.col("yj") > py))
    cross = (F.col("xj") - F.col("x")) * (py - F.col("y")) / (F.col("yj") - F.col("y")) + F.col("x")
    middle = lambda k: (k + 0.5) * dx + x0
    before = lambda k: (middle(k) < F.col("cross")) if dx > 0 else (middle(k) >= F.col("cross"))  # noqa: E731  whether a column comes before the crossing
    near = F.ceil((F.col("cross") - x0) / dx - 0.5)
    across = across.select("sid", "value", "row", cross.alias("cross")).withColumn("k", near)
    k = F.when(~before(F.col("k") - 1), F.col("k") - 1).when(before(F.col("k")), F.col("k") + 1).otherwise(F.col("k"))  # rounding may be one off
    spans = across.select("sid", "value", "row", F.least(F.greatest(k, F.lit(0)), F.lit(spec.ncols)).cast("int").alias("k")).groupBy("sid", "value", "row").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("ks") - 2, F.lit(2)), lambda i: F.struct(F.get("ks", i).alias("a"), F.get("ks", i + 1).alias("b")))
    filled = spans.where(F.size("ks") >= 2).select("sid", "value", "row", F.explode(pairs).alias("p")).where("p.a < p.b")
    burned = filled.select("sid", "value", "row", F.explode(F.sequence(F.col("p.a"), F.col("p.b") - 1)).alias("col"))
    if all_touched:
        # of a row, the columns that a side spans while it is in it, and one beside; then a side and a cell are apart if they are along a
        # row, along a column or across the side
        met = in_rows(sides, F.greatest(F.ceil(low) - 1, F.col("r_least")), F.floor(high))
        slope = F.when(F.col("vj") != F.col("v"), (F.col("uj") - F.col("u")) / (F.col("vj") - F.col("v")))
        ends = [F.col("u") + slope * (F.least(F.greatest(F.col("row") + h, low), high) - F.col("v")) for h in (0, 1)]
        first, last = F.coalesce(F.least(*ends), F.least("u", "uj")), F.coalesce(F.greatest(*ends), F.greatest("u", "uj"))
        met = met.withColumns({"c0": F.greatest(F.floor(first) - 1, F.col("c_least"), F.lit(0)).cast("int"), "c1": F.least(F.floor(last) + 1, F.lit(spec.ncols - 1)).cast("int")}).where("c0 <= c1")
        met = met.withColumn("col", F.explode(F.sequence("c0", "c1")))
        hu, hv = (F.col("u") - F.col("uj")) / 2, (F.col("v") - F.col("vj")) / 2
        du, dv = (F.col("u") + F.col("uj")) / 2 - (F.col("col") + 0.5), (F.col("v") + F.col("vj")) / 2 - (F.col("row") + 0.5)
        touches = (F.abs(du) <= F.abs(hu) + 0.5) & (F.abs(dv) <= F.abs(hv) + 0.5) & (F.abs(du * hv - dv * hu) <= (F.abs(hu) + F.abs(hv)) * 0.5)
        burned = burned.unionByName(met.where(touches).select("sid", "value", "row", "col"))
    hit = burned.groupBy("row", "col").agg(F.max_by("value", "sid").alias("z"))
    if mask is not None:
        hit = hit.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")
    grid = shapes.sparkSession.range(spec.size).select(F.floor(F.col("id") / spec.ncols).cast("long").alias("row"), F.pmod("id", F.lit(spec.ncols)).cast("int").alias("col"))
    return grid.join(hit, ["row", "col"], "left").select("row", "col", F.coalesce("z", F.lit(fill).cast(dtype)).alias("z"))


def polygonize(cells: DataFrame, spec: GridSpec, value: str = "z", connectivity: int = 4) -> DataFrame:
    """``label``, ``value``, ``n_cells`` and ``edges`` (boundary sides, as sorted (x0, y0, x1, y1) corners) of the regions of equal values,
    connected by sides (4) or by sides and corners (8)."""
    data = cells.where(F.col(value).isNotNull())
    labels = connected_labels(data.select("row", "col", value), spec, value, connectivity)
    own = data.select(cell_id(spec, F.col("row"), F.col("col")).alias("id"), "row", "col", F.col(value).alias("v")).join(labels, "id")
    sides = [(-1, 0, (0, 0, 0, 1)), (0, 1, (0, 1, 1, 1)), (1, 0, (1, 1, 1, 0)), (0, -1, (1, 0, 0, 0))]
    a, b, c, d, e, f = spec.affine

    def xy(dr: int, dc: int) -> list[Column]:
        r, q = F.col("row") + dr, F.col("col") + dc
        return [F.lit(a) * q + F.lit(b) * r + F.lit(c), F.lit(d) * q + F.lit(e) * r + F.lit(f)]

    made = [F.struct((F.col("row") + dr).alias("nr"), (F.col("col") + dc).alias("nc"), F.array(*xy(p[0], p[1]), *xy(p[2], p[3])).alias("side")) for dr, dc, p in sides]
    out = own.select("label", "v", F.explode(F.array(*made)).alias("m")).select("label", "v", "m.*")
    beside = own.select(F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("label").alias("other"))
    outer = out.join(beside, ["nr", "nc"], "left").where(F.col("other").isNull() | (F.col("other") != F.col("label"))).groupBy("label").agg(F.sort_array(F.collect_list("side")).alias("edges"))
    return own.groupBy("label").agg(F.first("v").alias("value"), F.count("*").alias("n_cells")).join(outer, "label")


def to_crs(cells: DataFrame, spec: GridSpec, crs: str, interpolation: str = "nearest", value: str = "z") -> tuple[DataFrame, GridSpec]:
    """The raster on a grid of the same shape that spans its outline in another coordinate system. Points without a place there, such as
    those beyond a pole, are left out of the outline, and cells of the new grid that lead to none of the old one have no data."""
    spark, ends = cells.sparkSession, lambda n: F.explode(F.array(F.lit(0), F.lit(n)))
    edge = spark.range(spec.ncols + 1).select(ends(spec.nrows).alias("row"), F.col("id").alias("col")).unionByName(spark.range(spec.nrows + 1).select(F.col("id").alias("row"), ends(spec.ncols).alias("col")))
    x, y = transform(*_corner(spec), spec.crs, crs)
    there = lambda c: F.when((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.col(c))
    x0, x1, y0, y1 = edge.select(x.alias("x"), y.alias("y")).agg(*[f(there(c)) for c in ("x", "y") for f in (F.min, F.max)]).head()
    if x0 is None:
        raise ValueError(f"no point of the grid's outline has a place in {crs}")
    dx, dy = (x1 - x0) / spec.ncols, (y1 - y0) / spec.nrows
    east, north = spec.affine[0] >= 0, spec.affine[4] < 0
    affine = (dx if east else -dx, 0.0, x0 if east else x1, 0.0, -dy if north else dy, y1 if north else y0)
    target = replace(spec, crs=crs, affine=affine)
    return view(cells, spec, target, interpolation, value), target


def coordinates(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """``cells`` with ``x`` and ``y`` of their corners, on the grid's affine transform."""
    a, b, c, d, e, f = spec.affine
    col, row = F.col("col").cast("double"), F.col("row").cast("double")
    return cells.withColumn("x", F.lit(a) * col + F.lit(b) * row + F.lit(c)).withColumn("y", F.lit(d) * col + F.lit(e) * row + F.lit(f))


def axes(spark: SparkSession, spec: GridSpec) -> tuple[DataFrame, DataFrame]:
    """(row, y) and (col, x) of the lines of a grid that isn't rotated."""
    if spec.affine[1] or spec.affine[3]:
        raise ValueError("a rotated grid has no axes")
    y = spark.range(spec.nrows).select(F.col("id").alias("row"), (F.lit(spec.affine[4]) * F.col("id") + F.lit(spec.affine[5])).alias("y"))
    x = spark.range(spec.ncols).select(F.col("id").cast("int").alias("col"), (F.lit(spec.affine[0]) * F.col("id") + F.lit(spec.affine[2])).alias("x"))
    return y, x
