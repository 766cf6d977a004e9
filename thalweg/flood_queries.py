"""Queries of flood spreading over rasters made of ``embeddings``, and the SQL that they are compared with, which has tables of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators import flood


def _r(c: str):
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(c)


def _rain(cells: DataFrame) -> DataFrame:
    """0.25 to 1 of rain, by the place."""
    return cells.select("row", "col", ((1 + F.pmod(F.col("row") + F.col("col"), F.lit(4))) / 4).alias("depth"))


def flood_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.queries import raster

    return flood.basins(*raster(spark, sf_dir, "steps")).select("row", "col", "basin")


def flood_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.queries import raster

    cells, spec = raster(spark, sf_dir, "noise")
    return flood.passes(flood.basins(cells, spec), spec)


def flood_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested depressions with the level at which each spills, where to, and what it holds until then."""
    from thalweg.queries import raster

    cells, spec = raster(spark, sf_dir, "ramp")
    ground = flood.basins(cells, spec)
    tree = flood.hierarchy(flood.passes(ground, spec), spec)
    full = flood.capacities(ground, tree, spec).where("parent is not null")
    return full.select("node", "parent", "level", "x", "y", "drop", _r("capacity"))


def flood_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of water after rain; the grid is closed."""
    from thalweg.queries import raster

    cells, spec = raster(spark, sf_dir, "ramp")
    return flood.flood(cells, _rain(cells), spec).where("depth > 1e-6").select("row", "col", _r("level"), _r("depth"))


def flood_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain and water that stands, which are the same."""
    from thalweg.queries import raster

    cells, spec = raster(spark, sf_dir, "noise")
    rain = _rain(cells)
    stands = flood.flood(cells, rain, spec).agg(flood.total(F.col("depth")).alias("stands"))
    return rain.agg(F.sum("depth").alias("rain")).join(F.broadcast(stands)).select(_r("rain"), _r("stands"))


def queries():
    return {q.__name__: q for q in (flood_basins, flood_passes, flood_hierarchy, flood_depths, flood_volume)}


def _ground(name: str) -> str:
    """SQL tables: at (id, z), p (id, the next cell or null), ground (id, basin, row, col, z)."""
    from thalweg.queries import _NB, _OFFS, _cells

    return f"""WITH RECURSIVE {_cells(name)}, {_OFFS}, {_NB},
w AS (SELECT mc + 1 AS n FROM g),
steep AS (SELECT row, col, nr * n AS r, nc AS c FROM nb, w WHERE z > zn QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY (z - zn) / dist DESC, k) = 1),
flat AS (SELECT row, col, min(nr * n + nc) AS f FROM nb, w WHERE z = zn GROUP BY row, col),
p AS (SELECT c.row * n + c.col AS id, c.row, c.col, c.z, coalesce(s.r + s.c, CASE WHEN f < c.row * n + c.col THEN f END) AS p
      FROM w, cells c LEFT JOIN steep s USING (row, col) LEFT JOIN flat USING (row, col)),
walk AS (SELECT id, id AS at, p FROM p UNION ALL SELECT w.id, q.id, q.p FROM walk w JOIN p q ON q.id = w.p),
ground AS (SELECT p.id, walk.at AS basin, p.row, p.col, p.z FROM walk JOIN p USING (id) WHERE walk.p IS NULL)"""


_PASSES = """,
met AS (SELECT least(a.basin, b.basin) AS lo, greatest(a.basin, b.basin) AS hi, greatest(a.z, b.z) AS level, a.id AS x, b.id AS y
        FROM ground a JOIN nb ON nb.row = a.row AND nb.col = a.col CROSS JOIN w JOIN ground b ON b.id = nb.nr * w.n + nb.nc WHERE b.id > a.id AND a.basin <> b.basin),
passes AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lo, hi ORDER BY level, x, y) = 1)"""

# passes from the lowest up, one a round: lists of each basin's group and of each group's top node
_TREE = """,
leaf AS (SELECT basin, row_number() OVER (ORDER BY basin) AS i FROM (SELECT DISTINCT basin FROM ground)),
edge AS (SELECT row_number() OVER (ORDER BY level, x, y) AS n, lo, hi, level, x, y, a.i AS i, b.i AS j,
                -(x * 8 + 1 + CASE WHEN y - x = w.n THEN 4 WHEN y - x = w.n + 1 THEN 3 WHEN y - x = w.n - 1 THEN 5 ELSE 2 END) AS eid
         FROM passes JOIN leaf a ON a.basin = lo JOIN leaf b ON b.basin = hi CROSS JOIN w),
turn AS (
  SELECT 0::BIGINT AS n, list(i ORDER BY i) AS grp, list(basin ORDER BY i) AS top, NULL::BIGINT AS a, NULL::BIGINT AS b FROM leaf
  UNION ALL
  SELECT e.n, CASE WHEN grp[i] = grp[j] THEN grp ELSE list_transform(grp, lambda v: CASE WHEN v = grp[i] THEN grp[j] ELSE v END) END,
         CASE WHEN grp[i] = grp[j] THEN top ELSE list_transform(top, lambda v, k: CASE WHEN k = grp[j] THEN eid ELSE v END) END,
         CASE WHEN grp[i] <> grp[j] THEN top[grp[i]] END, CASE WHEN grp[i] <> grp[j] THEN top[grp[j]] END
  FROM turn JOIN edge e ON e.n = turn.n + 1),
tree AS (SELECT unnest([a, b]) AS node, eid AS parent, level, x, y, unnest([hi, lo]) AS drop FROM turn JOIN edge USING (n) WHERE a IS NOT NULL),
anc AS (SELECT basin, basin AS node FROM leaf UNION ALL SELECT basin, parent FROM anc JOIN tree USING (node)),
caps AS (SELECT node, parent, level, x, y, drop, sum(greatest(level - z, 0)) AS capacity FROM tree JOIN anc USING (node) JOIN ground USING (basin) GROUP BY ALL)"""

# passes from the highest down: water that is over on one side goes to the basin across, as much as that side lacks
_WATER = """,
mine AS (SELECT basin, i, sum((1 + (row + col) % 4) / 4.0::DOUBLE)::DOUBLE AS rain FROM ground JOIN leaf USING (basin) GROUP BY basin, i),
held_by AS (SELECT node, list(i) AS leaves FROM anc JOIN leaf USING (basin) GROUP BY node),
pairs AS (SELECT row_number() OVER (ORDER BY a.level DESC, a.x DESC, a.y DESC) AS n, a.parent, a.node AS na, b.node AS nb, a.capacity AS ca, b.capacity AS cb,
                 ha.leaves AS la, hb.leaves AS lb, da.i AS da, db.i AS db
          FROM caps a JOIN caps b ON a.parent = b.parent AND a.node < b.node JOIN held_by ha ON ha.node = a.node JOIN held_by hb ON hb.node = b.node
          JOIN leaf da ON da.basin = a.drop JOIN leaf db ON db.basin = b.drop),
flow AS (
  SELECT 0::BIGINT AS n, list(rain ORDER BY i) AS q, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS over, NULL::DOUBLE AS back FROM mine
  UNION ALL
  SELECT n, list_transform(q, lambda v, k: v + CASE WHEN k = da THEN over ELSE 0 END + CASE WHEN k = db THEN back ELSE 0 END), x, y, over, back
  FROM (SELECT *, least(greatest(x - ca, 0), greatest(cb - y, 0)) AS over, least(greatest(y - cb, 0), greatest(ca - x, 0)) AS back
        FROM (SELECT p.n, f.q, p.ca, p.cb, p.da, p.db, list_sum(list_transform(p.la, lambda i: f.q[i])) AS x, list_sum(list_transform(p.lb, lambda i: f.q[i])) AS y
              FROM flow f JOIN pairs p ON p.n = f.n + 1))),
water AS (SELECT na AS node, least(ca, x + back) AS held FROM flow JOIN pairs USING (n) UNION ALL SELECT nb, least(cb, y + over) FROM flow JOIN pairs USING (n)
          UNION ALL SELECT node, (SELECT sum(rain) FROM mine) FROM held_by WHERE node NOT IN (SELECT node FROM tree)),
wet AS (SELECT water.node, held FROM water LEFT JOIN pairs ON parent = water.node WHERE parent IS NULL OR held >= ca + cb),
pool AS (SELECT basin, max_by(anc.node, coalesce((k.level, k.x, k.y), (1e300, 0, 0))) AS pool FROM anc JOIN wet USING (node) LEFT JOIN caps k USING (node) GROUP BY basin),
inside AS (SELECT pool.pool, wet.held, id, row, col, z FROM ground JOIN pool USING (basin) JOIN wet ON wet.node = pool.pool WHERE held > 0),
run AS (SELECT *, count(*) OVER u AS k, sum(z) OVER u AS s FROM inside WINDOW u AS (PARTITION BY pool ORDER BY z, id ROWS UNBOUNDED PRECEDING)),
surface AS (SELECT pool, (any_value(held) + sum(z)) / count(*) AS level FROM run WHERE k * z - s < held GROUP BY pool)"""


def oracle_sql() -> dict[str, str]:
    six = "round({0}, 6) + 0.0 AS {0}"
    return {
        "flood_basins": _ground("steps") + " SELECT row, col, basin FROM ground",
        "flood_passes": _ground("noise") + _PASSES + " SELECT lo, hi, level, x, y FROM passes",
        "flood_hierarchy": _ground("ramp") + _PASSES + _TREE + f" SELECT node, parent, level, x, y, drop, {six.format('capacity')} FROM caps",
        "flood_depths": _ground("ramp") + _PASSES + _TREE + _WATER + " SELECT row, col, round(level, 6) + 0.0 AS level, round(level - z, 6) + 0.0 AS depth FROM inside JOIN surface USING (pool) WHERE level - z > 1e-6",
        "flood_volume": _ground("noise") + " SELECT round(sum((1 + (row + col) % 4) / 4.0::DOUBLE), 6) + 0.0 AS rain, rain AS stands FROM ground",
    }
