"""A grid's place in the world: affine transform, shape, coordinate system and nodata. Cells are DataFrames beside it."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class GridSpec:
    """``x = a*col + b*row + c``, ``y = d*col + e*row + f`` for the upper left corner of a cell."""

    nrows: int
    ncols: int
    affine: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    crs: str = "EPSG:4326"
    nodata: float = 0.0

    @property
    def dx(self) -> float:
        return abs(self.affine[0])

    @property
    def dy(self) -> float:
        return abs(self.affine[4])

    @property
    def size(self) -> int:
        return self.nrows * self.ncols

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        (x0, y0), (x1, y1) = self.xy(0, 0), self.xy(self.nrows, self.ncols)
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)

    @property
    def extent(self) -> tuple[float, float, float, float]:
        b = self.bbox
        return b[0], b[2], b[1], b[3]

    def xy(self, row: float, col: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.affine
        return a * col + b * row + c, d * col + e * row + f

    def inverse(self) -> tuple[float, float, float, float, float, float]:
        a, b, c, d, e, f = self.affine
        det = a * e - b * d
        if not det:
            raise ValueError("the affine transform has no inverse")
        return e / det, -b / det, (b * f - e * c) / det, -d / det, a / det, (d * c - a * f) / det

    def nearest_cell(self, x: float, y: float, snap: str = "corner") -> tuple[int, int]:
        """(col, row) of a point: the nearest corner, half to even, or the cell that holds it (snap "center")."""
        if snap not in ("corner", "center"):
            raise ValueError(f"snap must be 'corner' or 'center', not {snap!r}")
        a, b, c, d, e, f = self.inverse()
        col, row = a * x + b * y + c, d * x + e * y + f
        return (round(col), round(row)) if snap == "corner" else (math.floor(col), math.floor(row))

    def congruent(self, other: GridSpec) -> bool:
        """Same place, shape and coordinate system, whatever the nodata."""
        return (self.affine, self.nrows, self.ncols, self.crs) == (other.affine, other.nrows, other.ncols, other.crs)

    def window(self, row: int, col: int, nrows: int, ncols: int) -> GridSpec:
        """The grid of ``nrows`` by ``ncols`` cells whose first is (row, col) of this one."""
        x, y = self.xy(row, col)
        a, b, _, d, e, _ = self.affine
        return replace(self, nrows=nrows, ncols=ncols, affine=(a, b, x, d, e, y))
