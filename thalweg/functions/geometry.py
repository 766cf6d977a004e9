"""Neighbours, distances and angles of a cell as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from thalweg.spec import GridSpec

# Neighbours in the order N, NE, E, SE, S, SW, W, NW, as (row, column) steps, and the default codes.
STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
DIRMAP = (64, 128, 1, 2, 4, 8, 16, 32)
# The eight facets east of north-east and on, counter-clockwise; neighbours as places in STEPS.
FACETS = [(2, 1, 0, 1), (0, 1, 1, -1), (0, 7, 1, 1), (6, 7, 2, -1), (6, 5, 2, 1), (4, 5, 3, -1), (4, 3, 3, 1), (2, 3, 4, -1)]
#: Receivers of an angle: sector s lies between SECTORS[s] and SECTORS[s + 1], counter-clockwise from east.
SECTORS = [2, 1, 0, 7, 6, 5, 4, 3]


def distances(spec: GridSpec) -> list[float]:
    d = math.sqrt(spec.dx**2 + spec.dy**2)
    return [spec.dy, d, spec.dx, d, spec.dy, d, spec.dx, d]


def cell_id(spec: GridSpec, row: Column, col: Column) -> Column:
    return row.cast("long") * spec.ncols + col


def on_rim(spec: GridSpec, row: Column, col: Column) -> Column:
    return (row == 0) | (col == 0) | (row == spec.nrows - 1) | (col == spec.ncols - 1)


def step_id(spec: GridSpec, row: Column, col: Column, k: int) -> Column:
    """Id of the k-th neighbour; null off the grid."""
    dr, dc = STEPS[k]
    inside = (row + dr).between(0, spec.nrows - 1) & (col + dc).between(0, spec.ncols - 1)
    return F.when(inside, cell_id(spec, row + dr, col + dc))


def facet(e0: Column, e1: Column, e2: Column, d1: float, d2: float) -> tuple[Column, Column]:
    """Angle and slope of the steepest descent within one triangular facet."""
    s1, s2 = (e0 - e1) / d1, (e1 - e2) / d2
    r, s = F.atan2(s2, s1), F.hypot(s1, s2)
    diagonal, edge = math.atan2(d2, d1), math.sqrt(d1**2 + d2**2)
    r2 = F.when(r < 0, 0.0).when(r > diagonal, diagonal).otherwise(r)
    return r2, F.when(r < 0, s1).when(r > diagonal, (e0 - e2) / edge).otherwise(s)
