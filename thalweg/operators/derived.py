"""What is derived from rasters of other operators: classes, histograms, overlays, burned channels and mean directions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions.geometry import DIRMAP, STEPS
from thalweg.operators import hydro
from thalweg.plans.loops import pinned
from thalweg.spec import GridSpec


def class_of(value: str | Column, bounds: list[float]) -> Column:
    """How many of the ascending ``bounds`` are not above the value; null for null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.isNotNull(), sum(((v >= F.lit(float(b))).cast("int") for b in bounds), F.lit(0)))


def histogram(values: DataFrame, value: str, bins: int, low: float = 0.0, high: float | None = None) -> DataFrame:
    """``bin``, ``lower`` (its bound) and ``n`` of the bins that hold something, of ``bins`` equal ones from ``low`` to ``high`` (else
    the greatest value and 1e-5 more). Nulls and what lies outside are not counted; the last bin holds its upper bound."""
    held = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v"))
    top = F.lit(float(high)) if high is not None else F.col("__top")
    if high is None:  # one row
        held = held.join(F.broadcast(held.agg((F.max("__v") + 1e-5).alias("__top"))))
    width = (top - F.lit(float(low))) / bins
    inside = held.where((F.col("__v") >= low) & (F.col("__v") <= top))
    at = F.least(F.floor((F.col("__v") - F.lit(float(low))) / width), F.lit(bins - 1)).cast("int")
    return inside.groupBy(at.alias("bin"), width.alias("__w")).agg(F.count("*").alias("n")).select("bin", (F.col("bin") * F.col("__w") + low).alias("lower"), "n")


def overlay(cells: DataFrame, cover: DataFrame, value: str, kind: str = "z") -> DataFrame:
    """For each ``kind`` of ``cover`` (row, col, ``kind``; on the same grid): ``n`` cells, and the ``mean`` of their ``value``. Cells without
    a kind count under null."""
    joined = cells.select("row", "col", value).join(cover.select("row", "col", F.col(kind).alias("kind")), ["row", "col"], "left")
    return joined.groupBy("kind").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def blurred(cells: DataFrame, spec: GridSpec, sigma: float, value: str = "z") -> DataFrame:
    """row, col, ``value`` smoothed by a Gaussian cut off at four deviations, the grid mirrored at its rim. Cells that are missing or
    null count as 0, and only cells that something reaches are returned: a sparse mask stays sparse."""
    reach = int(4 * sigma + 0.5)
    if reach >= min(spec.nrows, spec.ncols):
        raise ValueError("the filter is wider than the grid")
    weight = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    share = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / sum(weight)).alias("w")) for d, w in zip(range(-reach, reach + 1), weight, strict=True)])
    out = cells.where(F.col(value).isNotNull() & (F.col(value) != 0)).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("__v"))
    for at, n in (("row", spec.nrows), ("col", spec.ncols)):
        other = "col" if at == "row" else "row"
        mirrored = out.select(F.explode(F.array(F.col(at), -1 - F.col(at), 2 * n - 1 - F.col(at))).alias(at), other, "__v").where(F.col(at).between(-reach, n - 1 + reach))
        sent = mirrored.select(at, other, "__v", F.explode(share).alias("x")).select((F.col(at) + F.col("x.d")).alias(at), other, (F.col("__v") * F.col("x.w")).alias("__v"))
        out = sent.where(F.col(at).between(0, n - 1)).groupBy(at, other).agg(F.sum("__v").alias("__v"))
    return out.select("row", F.col("col").cast("int").alias("col"), F.col("__v").alias(value))


def burn(cells: DataFrame, channels: DataFrame, depth: float, spec: GridSpec | None = None, sigma: float | None = None) -> DataFrame:
    """row, col, z lowered by ``depth`` on ``channels`` (row, col). With ``sigma`` the banks slope: the blurred channels, those
    themselves at the blur's greatest value, times the depth."""
    on = channels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), F.lit(1.0).alias("__m")).distinct()
    if sigma is not None:
        soft = pinned(blurred(on, spec, sigma, "__m"), "blurred")
        most = soft.agg(F.max("__m").alias("__top"))  # one row
        on = soft.withColumnRenamed("__m", "__s").join(on, ["row", "col"], "left").join(F.broadcast(most)).select("row", "col", F.when(F.col("__m").isNotNull(), F.col("__top")).otherwise(F.col("__s")).alias("__m"))
    return cells.join(on, ["row", "col"], "left").select("row", "col", (F.col("z") - F.lit(float(depth)) * F.coalesce("__m", F.lit(0.0))).alias("z"))


def accumulated_angle(flow: DataFrame, spec: GridSpec, *, dirmap=DIRMAP) -> DataFrame:
    """row, col, ``x``, ``y`` (sums of the unit steps, east and north, of a cell's D8 flow and of all that flows into it) and
    ``angle``, their direction in radians counter-clockwise from east, of sums to nine places."""
    step = lambda k, along: -STEPS[k][0] / math.hypot(*STEPS[k]) if along == "y" else STEPS[k][1] / math.hypot(*STEPS[k])
    part = lambda along: F.coalesce(*[F.when(F.col("fdir") == c, F.lit(step(k, along))) for k, c in enumerate(dirmap)], F.lit(0.0)).alias("w")
    x, y = (hydro.accumulation(flow, spec, weights=flow.select("row", "col", part(a)), dirmap=dirmap).select("row", "col", F.col("acc").alias(a)) for a in ("x", "y"))
    near = lambda c: F.round(c, 9) + F.lit(0.0)
    return x.join(y, ["row", "col"]).select("row", "col", "x", "y", F.atan2(near("y"), near("x")).alias("angle"))
