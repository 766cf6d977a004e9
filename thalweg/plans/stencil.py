"""The 3 x 3 neighbourhood of every cell of a dense grid, tile by tile after one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and columns of a tile; a thirtieth of the cells are sent to a second one.
TILE = 128
KEYS = ["__tr", "__tc"]


def _tile(at: Column) -> Column:
    return F.floor(at / TILE).cast("int")


def in_tile(cells: DataFrame) -> DataFrame:
    """``cells`` with the tile that each lies in."""
    return cells.select("*", _tile(F.col("row")).alias("__tr"), _tile(F.col("col")).alias("__tc"), F.lit(True).alias("__own"))


def in_tiles(cells: DataFrame) -> DataFrame:
    """``cells`` with the tile that each lies in (``__own``) and, as further rows, those that it lies beside."""
    beside = lambda at: F.sequence(_tile(F.greatest(at - 1, F.lit(0))), _tile(at + 1))
    many = cells.select("*", F.explode(beside(F.col("row"))).alias("__tr")).select("*", F.explode(beside(F.col("col"))).alias("__tc"))
    return many.select("*", ((F.col("__tr") == _tile(F.col("row"))) & (F.col("__tc") == _tile(F.col("col")))).alias("__own"))


def by_tile(tiled: DataFrame) -> DataFrame:
    """The one shuffle: what is grouped or ordered within tiles after it stays where it is."""
    return tiled.repartition(*KEYS)


def around(tiled: DataFrame, value: str = "z", prefix: str = "n") -> DataFrame:
    """Cells dealt ``by_tile`` with ``n0`` to ``n7``; cells beside a tile leave."""
    across = Window.partitionBy(*KEYS, "row").orderBy("col")
    down = Window.partitionBy(*KEYS, "col").orderBy("row")
    one = tiled.withColumn("__w", F.lag(value).over(across)).withColumn("__e", F.lead(value).over(across))
    three = F.struct(F.col("__w").alias("w"), F.col(value).alias("c"), F.col("__e").alias("e"))
    two = one.withColumn("__t", three).withColumn("__n", F.lag("__t").over(down)).withColumn("__s", F.lead("__t").over(down))
    named = {0: "__n.c", 1: "__n.e", 2: "__e", 3: "__s.e", 4: "__s.c", 5: "__s.w", 6: "__w", 7: "__n.w"}
    own = [c for c in tiled.columns if c not in (*KEYS, "__own")]
    return two.where("__own").select(*own, *[F.col(c).alias(f"{prefix}{k}") for k, c in named.items()])


def with_neighbours(cells: DataFrame, value: str = "z", prefix: str = "n") -> DataFrame:
    """``cells`` (row, col, ``value``; every position of the grid once) with ``n0`` to ``n7``: the values of the neighbours in
    the order N, NE, E, SE, S, SW, W, NW, null off the grid or without data.

    A tile has the same number of cells however large or narrow the grid is.
    """
    return around(by_tile(in_tiles(cells)), value, prefix)
