"""ESRI ASCII grids: six header lines, then a line of values per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thalweg.spec import GridSpec


def read_ascii(spark: SparkSession, path: str, *, skiprows: int = 6, crs: str = "EPSG:4326", value: str = "z") -> tuple[DataFrame, GridSpec]:
    """row, col, ``value`` (null where nodata) of the grid at ``path`` (a file, or a folder whose files in order of name make
    one), and its spec. The first six lines are ncols, nrows, x and y of the lower left corner, cell size and nodata.

    Lines are read in splits, in parallel. A line's number is its place in its split and the lines of the splits before
    it, of which there is one row a split. Blank lines may only stand at the end.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    splits = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    first = splits.orderBy("file", "block").select("file", "block").head()
    if first is None:
        raise ValueError(f"{path} has no lines")
    head = lines.where((F.col("file") == first["file"]) & (F.col("block") == first["block"])).orderBy("place").select("value").head(6)
    fields = [r["value"].split()[1] for r in head]
    ncols, nrows = int(fields[0]), int(fields[1])
    xll, yll, size, nodata = (float(x) for x in fields[2:6])
    spec = GridSpec(nrows, ncols, (size, 0.0, xll, 0.0, -size, yll + nrows * size), crs, nodata)
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"])
    row = F.col("place") - F.col("first") + F.col("before") - F.lit(skiprows)
    rows = numbered.select(row.cast("long").alias("row"), F.trim("value").alias("line")).where((F.col("row") >= 0) & (F.col("line") != ""))
    cells = rows.select("row", F.posexplode(F.split("line", r"\s+")).alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("v"))
    is_data = ~(F.isnan("v") | (F.col("v") == F.lit(nodata)))
    return cells.select("row", "col", F.when(is_data, F.col("v")).alias(value)), spec


def to_ascii(cells: DataFrame, spec: GridSpec, path: str, *, value: str = "z", delimiter: str = " ", integer: bool = False) -> None:
    """Write the grid as text to the folder ``path``: its part files in order of name are an ASCII grid.

    Cells that are null or missing are written as nodata. A row of the grid is a line and so lies in one task.
    """
    if abs(abs(spec.affine[0]) - abs(spec.affine[4])) > 1e-12 * abs(spec.affine[0]):
        raise ValueError("the cells of an ASCII grid are square")
    if spec.affine[1] or spec.affine[3]:
        raise ValueError("an ASCII grid isn't rotated")
    spark = cells.sparkSession
    nodata = str(int(spec.nodata)) if integer else repr(float(spec.nodata))
    box = spec.bbox
    names = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "NODATA_value")
    header = "\n".join(f"{k}{' ' * 9}{v}" for k, v in zip(names, (spec.ncols, spec.nrows, box[0], box[1], spec.dx, nodata), strict=True))
    v = F.col(value).cast("long" if integer else "double").cast("string")
    inside = cells.where(F.col("row").between(0, spec.nrows - 1) & F.col("col").between(0, spec.ncols - 1) & F.col(value).isNotNull())
    held = inside.groupBy(F.col("row").cast("long").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), v))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(spec.ncols - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(nodata)))
    rows = spark.range(spec.nrows).withColumnRenamed("id", "row").join(held, "row", "left").select("row", F.array_join(filled, delimiter).alias("line"))
    top = spark.createDataFrame([(-1, header)], "row long, line string")
    rows.unionByName(top).orderBy("row").select("line").write.mode("errorifexists").text(path)
