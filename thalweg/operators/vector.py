"""Polygons with rings from regions of equal values."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.functions.geometry import cell_id
from thalweg.operators.condition import connected_labels
from thalweg.spec import GridSpec


def _rings(sides: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Rings of corners (row, col) of directed sides with the region on their right; where four sides meet, a ring stays with its cell."""
    ways: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c, p, q in sorted(sides, reverse=True):
        ways.setdefault((r, c), []).append((p, q))
    found = []
    while ways:
        start = min(ways)
        at, step, ring = start, None, []
        while at in ways:
            ends = ways[at]
            right = (at[0] + step[1], at[1] - step[0]) if step else None
            to = ends.pop(ends.index(right) if right in ends else -1)
            if not ends:
                del ways[at]
            turned = (to[0] - at[0], to[1] - at[1])
            if turned != step:
                ring.append(at)
            at, step = to, turned
            if at == start and (start not in ways or not ring):
                break
        found.append(ring)
    return found


def _area(ring: list[tuple[int, int]]) -> float:
    """Positive for outer rings, negative for holes."""
    return sum(q[0] * p[1] - p[0] * q[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def _holds(ring: list[tuple[int, int]], r: float, c: float) -> bool:
    odd = False
    for (r1, c1), (r2, c2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (r1 > r) != (r2 > r) and c < c1 + (c2 - c1) * (r - r1) / (r2 - r1):
            odd = not odd
    return odd


def polygons(cells: DataFrame, spec: GridSpec, value: str = "z", connectivity: int = 4, mask: DataFrame | None = None) -> DataFrame:
    """``label`` (the least cell id), ``value``, ``n_cells`` and ``geometry`` (GeoJSON: outer rings, holes within them) of the regions of
    equal values, connected by sides (4) or by sides and corners (8; parts that meet in corners make a MultiPolygon).

    With ``mask`` (row, col) only its cells. Cells without data are in no region. A region's outline is one value and so is put
    together in one task, from its outer sides alone.
    """
    data = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("v"))
    if mask is not None:
        data = data.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")
    labels = connected_labels(data, spec, "v", connectivity)
    own = data.select(cell_id(spec, F.col("row"), F.col("col")).alias("id"), "row", "col", "v").join(labels, "id")
    # sides with the cell on their right: the step to the neighbour, and the corners
    sides = [(-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0)]
    made = [F.struct((F.col("row") + s[0]).alias("nr"), (F.col("col") + s[1]).alias("nc"), *[(F.col(a) + d).cast("long").alias(n) for n, a, d in zip(("r0", "c0", "r1", "c1"), ("row", "col", "row", "col"), s[2:], strict=True)]) for s in sides]
    beside = own.select(F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("label").alias("other"))
    outer = own.select("label", F.explode(F.array(*made)).alias("m")).select("label", "m.*").join(beside, ["nr", "nc"], "left").where(F.col("other").isNull() | (F.col("other") != F.col("label")))
    xy = spec.xy

    def shape(sides) -> str:
        rings = _rings([(x["r0"], x["c0"], x["r1"], x["c1"]) for x in sides])
        parts = [[r] for r in rings if _area(r) > 0]
        for hole in (r for r in rings if _area(r) < 0):
            (r1, c1), (r2, c2) = hole[:2]
            d = 2 * (abs(r2 - r1) + abs(c2 - c1))
            # a point of the region beside the hole's first side
            r, c = r1 + (r2 - r1) / d + (c2 - c1) / d, c1 + (c2 - c1) / d - (r2 - r1) / d
            next(p for p in parts if len(parts) == 1 or _holds(p[0], r, c)).append(hole)
        out = [[[xy(*at) for at in [*ring, ring[0]]] for ring in part] for part in parts]
        return json.dumps({"type": "Polygon", "coordinates": out[0]} if len(out) == 1 else {"type": "MultiPolygon", "coordinates": out})

    def run(batches):
        for pdf in batches:
            yield pdf.assign(geometry=pdf["sides"].map(shape))[["label", "geometry"]]

    outline = outer.groupBy("label").agg(F.collect_list(F.struct("r0", "c0", "r1", "c1")).alias("sides"))
    shapes = outline.mapInPandas(run, "label long, geometry string")
    return own.groupBy("label").agg(F.first("v").alias("value"), F.count("*").alias("n_cells")).join(shapes, "label")


def area_of(geometry: str = "geometry"):
    """The area of a GeoJSON Polygon as a column: outer ring less holes."""
    rings = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<double>>>")
    cross = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), F.lit(0.0), lambda t, i: t + F.get(F.get(r, i), F.lit(0)) * F.get(F.get(r, i + 1), F.lit(1)) - F.get(F.get(r, i + 1), F.lit(0)) * F.get(F.get(r, i), F.lit(1)))
    return F.abs(F.aggregate(rings, F.lit(0.0), lambda t, r: t + cross(r))) / 2
