"""Conditioning of elevations: depressions and flats, solved inside tiles and then between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.functions.geometry import cell_id, on_rim
from thalweg.plans.loops import pinned
from thalweg.plans.stencil import with_neighbours
from thalweg.plans.tiles import fewest_steps, least_greatest
from thalweg.spec import GridSpec


def fill_depressions(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """row, col, z raised to the least level at which water reaches the first or last cell with data of some row or column.

    The level of a cell is the least, over all paths to such a seed, of the greatest elevation on the path. Cells that no seed
    reaches keep their elevation; null and NaN have no data.
    """
    valid = cells.where(F.col("z").isNotNull() & ~F.isnan(F.col("z").cast("double"))).select("row", "col", "z")
    ends = lambda by, at: valid.groupBy(by).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    r, c = ends("row", "col"), ends("col", "row")
    seeds = r.select("row", F.explode(F.array("lo", "hi")).alias("col")).unionByName(c.select(F.explode(F.array("lo", "hi")).alias("row"), "col")).distinct()
    ground = pinned(valid.join(seeds.withColumn("seed", F.lit(True)), ["row", "col"], "left").select("row", "col", F.col("z").alias("v"), F.when(F.col("seed"), F.col("z")).alias("s")), "ground")
    level = least_greatest(ground, spec)
    ids = cells.withColumn("id", cell_id(spec, F.col("row"), F.col("col")))
    return ids.join(level, "id", "left").select("row", "col", F.when(F.col("z").isNotNull(), F.coalesce("level", "z")).alias("z"))


def detect_depressions(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """row, col, ``depression``: filling raises the cell."""
    filled = fill_depressions(cells, spec).withColumnRenamed("z", "f")
    return cells.join(filled, ["row", "col"]).select("row", "col", F.coalesce(F.col("f") > F.col("z"), F.lit(False)).alias("depression"))


def connected_labels(marked: DataFrame, spec: GridSpec, value: str | None = None, connectivity: int = 8) -> DataFrame:
    """id and ``label`` (the least id) of the 8-connected (or 4-connected) regions of ``marked`` (row, col); with ``value`` (a
    number, NaN is no data), of equal values."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    own = cell_id(spec, F.col("row"), F.col("col"))
    cells = marked.select("row", "col", (F.col(value) if value else F.lit(1)).cast("double").alias("v"), own.alias("s"))
    return least_greatest(cells.where(~F.isnan("v")), spec, True, connectivity).select("id", F.col("level").cast("long").alias("label"))


def resolve_flats(cells: DataFrame, spec: GridSpec, eps: float = 1e-5) -> DataFrame:
    """row, col, z with flats inclined by ``eps`` times twice the steps from lower ground and the steps from higher ground."""
    ns = [f"n{k}" for k in range(8)]
    inner = ~on_rim(spec, F.col("row"), F.col("col"))
    a = with_neighbours(cells)
    lower, higher = F.least(*ns) < F.col("z"), F.greatest(*ns) > F.col("z")
    pit = F.least(*ns) > F.col("z")
    flat = F.coalesce(inner & ~lower & ~pit, F.lit(False))
    a = pinned(a.select("row", "col", "z", cell_id(spec, F.col("row"), F.col("col")).alias("id"), flat.alias("flat"), (flat & F.coalesce(higher, F.lit(False))).alias("high"), (~inner | lower).alias("out")), "flats")
    flats = a.where("flat")
    if flats.isEmpty():
        return cells.select("row", "col", "z")
    labels = connected_labels(flats, spec)
    away = fewest_steps(flats.select("row", "col", F.lit(1.0).alias("v"), F.lit(True).alias("enter"), F.when(F.col("high"), 1.0).alias("s")), spec).join(labels, "id")
    top = away.groupBy("label").agg(F.max("n").alias("top"))
    away = away.join(top, "label").select("id", (F.col("top") - F.col("n")).alias("from"))
    # lower edges: neighbours as high that drain
    beside = F.array(*[F.col(f"f{k}") for k in range(8)])
    low = with_neighbours(a.select("row", "col", "z", "out", F.when(F.col("flat"), F.col("z")).alias("fz")), "fz", "f").where(F.col("out") & F.exists(beside, lambda f: F.coalesce(f == F.col("z"), F.lit(False))))
    ways = flats.select("row", "col", F.col("z").alias("v"), F.lit(True).alias("enter"), F.lit(None).cast("double").alias("s")).unionByName(low.select("row", "col", F.col("z").alias("v"), F.lit(False).alias("enter"), F.lit(1.0).alias("s")))
    towards = fewest_steps(ways, spec).withColumnRenamed("n", "to")
    out = a.join(away, "id", "left").join(towards, "id", "left")
    return out.select("row", "col", (F.col("z") + F.lit(eps) * (2 * F.coalesce("to", F.lit(0.0)) + F.coalesce("from", F.lit(0.0)))).alias("z"))
