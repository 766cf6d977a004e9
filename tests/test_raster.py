"""Raster operators against small models written here, on grids made by hand and by chance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import condition, hydro, terrain, view
from thalweg.spec import GridSpec

STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
CODES = [64, 128, 1, 2, 4, 8, 16, 32]


def cells(spark, z):
    rows = [(r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(np.asarray(z, dtype=float))]
    return spark.createDataFrame(rows, "row long, col int, z double"), GridSpec(*np.shape(z))


def array(df, name, shape, fill=np.nan):
    out = np.full(shape, fill)
    for r in df.collect():
        out[r["row"], r["col"]] = fill if r[name] is None else r[name]
    return out


def d8(z):
    out, to = np.zeros(z.shape, int), {}
    for (r, c), v in np.ndenumerate(z):
        best, k = -math.inf, None
        for j, (dr, dc) in enumerate(STEPS):
            if 0 <= r + dr < z.shape[0] and 0 <= c + dc < z.shape[1]:
                s = (v - z[r + dr, c + dc]) / math.hypot(dr, dc)
                if s > best:
                    best, k = s, j
        out[r, c] = CODES[k] if best > 0 else (-1 if best == 0 else -2)
        if best > 0:
            to[r, c] = (r + STEPS[k][0], c + STEPS[k][1])
    return out, to


@pytest.fixture(scope="module")
def ground():
    rng = np.random.default_rng(5)
    return np.round(rng.random((9, 7)) * 8 + np.arange(9)[:, None], 1)


def test_d8_and_its_graph(spark, ground):
    df, spec = cells(spark, ground)
    flow = terrain.flowdir_d8(df, spec).cache()
    want, to = d8(ground)
    assert (array(flow, "fdir", ground.shape) == want).all()
    acc, ridge = np.ones(ground.shape), np.zeros(ground.shape)
    for at in sorted(to, key=lambda x: -ground[x]):
        acc[to[at]] += acc[at]
        ridge[to[at]] = max(ridge[to[at]], ridge[at] + 1)
    assert (array(hydro.accumulation(flow, spec), "acc", ground.shape) == acc).all()
    assert (array(hydro.distance_to_ridge(flow, spec), "dist", ground.shape) == ridge).all()
    inner = acc.copy()
    inner[[0, -1], :] = inner[:, [0, -1]] = 0
    r, c = np.unravel_index(inner.argmax(), inner.shape)
    want = {}
    for at in np.ndindex(ground.shape):
        n, x = 0, at
        while x in to and x != (r, c):
            x, n = to[x], n + 1
        if x == (r, c):
            want[at] = n
    got = {(x["row"], x["col"]): x["dist"] for x in hydro.distance_to_outlet(c, r, flow, spec, xytype="index").collect()}
    assert got == want
    with pytest.raises(ValueError):
        hydro.catchment(99, 99, flow, spec, xytype="index")


def test_pits_flats_and_depressions(spark, ground):
    df, spec = cells(spark, [[3, 3, 3, 3], [3, 1, 3, 3], [3, 3, 2, 3], [3, 3, 3, 3]])
    assert [(x["row"], x["col"]) for x in terrain.detect_pits(df, spec).where("pit").collect()] == [(1, 1)]
    assert array(terrain.fill_pits(df, spec), "z", (4, 4))[1, 1] == 2
    assert (array(condition.fill_depressions(df, spec), "z", (4, 4)) == 3).all()
    flat, spec = cells(spark, [[5, 5, 5, 5, 5], [5, 2, 2, 2, 1], [5, 5, 5, 5, 5]])
    assert {(x["row"], x["col"]) for x in terrain.detect_flats(flat, spec).where("flat").collect()} == {(1, 1), (1, 2)}
    again = condition.resolve_flats(flat, spec)
    assert terrain.detect_flats(again, spec).where("flat").isEmpty()


def test_routes_share_everything(spark, ground):
    df, spec = cells(spark, ground)
    mfd = terrain.flowdir_mfd(df, spec)
    assert all(abs(x["s"] - 1) < 1e-12 for x in mfd.groupBy("row", "col").agg(F.sum("prop").alias("s")).collect())
    acc = hydro.accumulation(mfd, spec, "mfd")
    sinks = acc.join(mfd, ["row", "col"], "left_anti").agg(F.sum("acc")).head()[0]
    assert abs(sinks - ground.size) < 1e-9
    angle = terrain.flowdir_dinf(df, spec)
    assert angle.where("angle > 6.2832 or (angle < 0 and angle not in (-1, -2))").isEmpty()


def test_views(spark, ground):
    df, spec = cells(spark, ground)
    assert view.view(df, spec, spec).count() == ground.size
    half = GridSpec(9, 7, (1.0, 0.0, 0.5, 0.0, 1.0, 0.0))
    got = array(view.view(df, spec, half, "linear"), "z", ground.shape)
    assert np.allclose(got[:, :-1], (ground[:, :-1] + ground[:, 1:]) / 2)
    holes = ground.copy()
    holes[:2], holes[:, :3] = np.nan, np.nan
    part, at = view.clip_to(cells(spark, holes)[0], spec)
    assert (at.nrows, at.ncols, at.affine[2], at.affine[5]) == (7, 4, 3.0, 2.0) and part.count() == 28
    assert spec.nearest_cell(2.5, 3.5) == (2, 4) and spec.nearest_cell(2.9, 3.5, "center") == (2, 3)
    empty = df.where("false")
    assert terrain.detect_pits(empty, spec).isEmpty()


def regions(z, steps):
    """Of the regions of equal values: the least cell's id, the value, the number of cells and the boundary sides."""
    found, seen = [], set()
    for at in np.ndindex(z.shape):
        if at in seen or math.isnan(z[at]):
            continue
        own, todo = {at}, [at]
        while todo:
            r, c = todo.pop()
            for dr, dc in steps:
                to = (r + dr, c + dc)
                if 0 <= to[0] < z.shape[0] and 0 <= to[1] < z.shape[1] and to not in own and z[to] == z[at]:
                    own.add(to)
                    todo.append(to)
        seen |= own
        sides = sum((r + dr, c + dc) not in own for r, c in own for dr, dc in STEPS[::2])
        found.append((at[0] * z.shape[1] + at[1], z[at], len(own), sides))
    return sorted(found)


def test_polygonize(spark):
    z = np.random.default_rng(3).integers(0, 3, (9, 7)).astype(float)
    z[2, 3] = z[5, 5] = np.nan
    df, spec = cells(spark, z)
    got = lambda **kw: sorted((x["label"], x["value"], x["n_cells"], len(x["edges"])) for x in view.polygonize(df, spec, **kw).collect())
    assert got() == regions(z, STEPS[::2]) and got(connectivity=8) == regions(z, STEPS) and got() != got(connectivity=8)
    with pytest.raises(ValueError):
        view.polygonize(df, spec, connectivity=6)


def test_polygonize_query_takes_the_whole_raster(spark, tmp_path):
    from thalweg import queries

    v = np.random.default_rng(4).normal(0, 0.12, (70, 5))
    spark.createDataFrame([(r, [float(x) for x in row]) for r, row in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(x) for x in queries.polygonize(spark, str(tmp_path)).collect())
    assert got == regions(np.floor(8 * v), STEPS[::2])


def test_cycles_of_dinfinity_edges_are_turned_in_order(spark):
    from thalweg.operators.hydro import break_cycles
    from thalweg.plans.loops import peeled

    def turned(rows, size):
        e = spark.createDataFrame([(a, b, 0, p) for a, b, p in rows], "id long, dst long, k int, prop double")
        return sorted((r["id"], r["dst"], r["prop"]) for r in break_cycles(e, size).collect())

    two = [(1, 2, 0.4), (1, 9, 0.6), (2, 1, 0.7), (2, 3, 0.3), (3, 2, 0.5), (3, 8, 0.5)]
    # 2 no longer leads to 1 but twice to 3; then 3, which leads to 2, is turned to 8
    assert turned(two, 1) == sorted([(1, 2, 0.4), (1, 9, 0.6), (2, 3, 0.7), (2, 3, 0.3), (3, 8, 0.5), (3, 8, 0.5)])
    assert turned([(1, 2, 1.0), (2, 1, 1.0), (0, 1, 1.0)], 1) == [(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    three = [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 0.5), (3, 7, 0.5)]
    assert turned(three, 1) == sorted(three)
    assert turned(three, 2) == sorted([(1, 2, 1.0), (2, 3, 1.0), (3, 7, 0.5), (3, 7, 0.5)])
    # cells on a cycle never send on; what leads to them arrives
    amounts = spark.createDataFrame([(i, 1.0) for i in range(5)], "id long, s double")
    steps = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0)], "src long, dst long, m double")
    assert {r["id"]: r["s"] for r in peeled(amounts, steps).collect()} == {0: 1.0, 1: 2.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_doubling_hands_cycles_to_peeling(spark):
    from thalweg.plans.loops import doubled_max, doubled_sum, roots

    nodes = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 4), (4, None)], "id long, p long")
    sums = doubled_sum(nodes.selectExpr("id", "p", "1.0D as s", "1.0D as m"))
    assert {r["id"]: r["s"] for r in sums.collect()} == {0: 1.0, 1: 2.0, 2: 1.0, 3: 1.0, 4: 2.0}
    most = doubled_max(nodes.selectExpr("id", "p", "1.0D as c"))
    assert {r["id"]: r["r"] for r in most.collect()} == {0: 0.0, 1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0}
    assert {r["id"]: r["root"] for r in roots(nodes.selectExpr("id", "p", "1.0D as d")).collect()} == {3: 4, 4: 4}


def test_stream_order_and_networks_by_brute_force(spark):
    import json

    from thalweg.operators import hydro, terrain
    from thalweg.spec import GridSpec

    rng = np.random.default_rng(12)
    rows, cols = 14, 11
    z = rng.random((rows, cols)) + 0.4 * np.arange(rows)[:, None]
    spec = GridSpec(rows, cols, (1.0, 0.0, 0.0, 0.0, -1.0, float(rows)))
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(rows) for c in range(cols)], "row long, col int, z double")
    flow = terrain.flowdir_d8(cells, spec).cache()
    acc = {r["row"] * cols + r["col"]: r["acc"] for r in hydro.accumulation(flow, spec).collect()}
    mask = {i for i, a in acc.items() if a > 2 and 0 < i // cols < rows - 1 and 0 < i % cols < cols - 1}
    down = {r["id"]: r["p"] for r in terrain.d8_edges(flow, spec).collect() if r["id"] in mask}
    fed = {i: [u for u, p in down.items() if p == i] for i in set(down) | {p for p in down.values() if p is not None}}
    extra = {i: len(u) + (down.get(i) is None) for i, u in fed.items()}

    def order(i):
        above = [order(u) for u in fed[i]]
        return 1 if not above else max(above) + (min(above) == max(above) and extra[i] > 1)

    on = spark.createDataFrame([(i // cols, i % cols) for i in mask], "row long, col int")
    got = {r["row"] * cols + r["col"]: r["ord"] for r in hydro.stream_order(flow, on, spec).collect()}
    assert got == {i: order(i) for i in fed} and max(got.values()) > 1
    # segments: from the largest head down, each walk goes on until it meets a cell that was walked
    want, walked = [], set()
    for head in sorted((i for i in fed if not fed[i] and down.get(i) is not None), reverse=True):
        at, line = head, [head]
        while down.get(at) is not None:
            at = down[at]
            line.append(at)
            if extra[at] > 1 or down.get(at) is None:
                want.append(line)
                if at in walked:
                    break
                line = [at]
                walked.add(at)
    found = sorted(hydro.segments(flow, on, spec).collect(), key=lambda r: r["number"])
    assert [r["cells"] for r in found] == want and [r["number"] for r in found] == list(range(len(want)))
    shapes = {r["number"]: json.loads(r["geometry"])["coordinates"] for r in hydro.extract_river_network(flow, on, spec).collect()}
    assert shapes == {k: [[float(i % cols), float(rows - i // cols)] for i in line] for k, line in enumerate(want)}
    heads = {line[0]: k for k, line in enumerate(want)}
    first = {line[-1]: k for k, line in reversed(list(enumerate(want)))}
    assert {r["number"]: r["next"] for r in hydro.extract_profiles(flow, on, spec).collect()} == {k: heads.get(line[-1], first[line[-1]]) for k, line in enumerate(want)}


def test_linear_view_beside_nodata(spark):
    spec = GridSpec(3, 3, (1.0, 0.0, 0.0, 0.0, -1.0, 3.0))
    cells = spark.createDataFrame([(r, c, None if (r, c) == (0, 0) else 10.0) for r in range(3) for c in range(3)], "row long, col int, z double")
    half = GridSpec(2, 2, (1.0, 0.0, 0.5, 0.0, -1.0, 2.5))
    assert {(r["row"], r["col"]): r["z"] for r in view.view(cells, spec, half, "linear").collect()} == {(0, 0): None, (0, 1): 10.0, (1, 0): 10.0, (1, 1): 10.0}


@pytest.mark.parametrize("tile", [3, 4, 128])
def test_neighbours_across_tiles(spark, monkeypatch, tile):
    from thalweg.plans import stencil

    monkeypatch.setattr(stencil, "TILE", tile)
    z = np.random.default_rng(8).random((9, 13))
    z[4, 4] = z[8, 0] = np.nan
    df, spec = cells(spark, z)
    got = {(r["row"], r["col"]): tuple(r[f"n{k}"] for k in range(8)) for r in stencil.with_neighbours(df).collect()}
    at = lambda r, c: None if not (0 <= r < 9 and 0 <= c < 13) or math.isnan(z[r, c]) else float(z[r, c])
    assert got == {(r, c): tuple(at(r + dr, c + dc) for dr, dc in STEPS) for r, c in np.ndindex(z.shape)}
    flow, to = terrain.flowdir_d8(df, spec).cache(), d8(np.where(np.isnan(z), np.inf, z))[1]
    dh = {(r["row"], r["col"]): r["dh"] for r in terrain.cell_dh(df, flow, spec).collect()}
    rim = lambda r, c: r in (0, 8) or c in (0, 12)
    drop = lambda p: 0.0 if rim(*p) or p not in to else float(z[p] - z[to[p]])
    assert dh == {p: None if math.isnan(z[p]) else drop(p) for p in np.ndindex(z.shape)}
    with pytest.raises(ValueError):
        terrain.cell_dh(df, flow, spec, "d9")


def test_one_shuffle_for_slopes(spark, ground):
    df, spec = cells(spark, ground)
    flow = spark.createDataFrame(terrain.flowdir_d8(df, spec).collect(), "row long, col int, fdir int")
    plan = terrain.cell_slopes(df, flow, spec)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_snap_to_mask_by_pyramid(spark):
    import math
    import random
    import time

    from thalweg.operators import view

    rng = random.Random(2)
    for spec, n in ((GridSpec(70, 50, (0.5, 0, 3.0, 0, -0.25, 9.0)), 40), (GridSpec(40, 40, (1.0, 0.3, -5, 0.2, -1.1, 4.0)), 100)):
        mask = sorted({(rng.randrange(spec.nrows), rng.randrange(spec.ncols)) for _ in range(n)})
        x0, y0, x1, y1 = spec.bbox
        points = [(i, rng.uniform(x0 - 2, x1 + 2), rng.uniform(y0 - 2, y1 + 2)) for i in range(50)] + [(50, None, 1.0)]
        got = {r["pid"]: (r["sx"], r["sy"]) for r in view.snap_to_mask(spark.createDataFrame(mask, "row long, col int"), spark.createDataFrame(points, "pid int, x double, y double"), spec, box=4).collect()}
        want = {i: spec.xy(*min(mask, key=lambda m, x=x, y=y: (math.dist((x, y), spec.xy(*m)), *m))) for i, x, y in points[:50]}
        assert {i: pytest.approx(p) for i, p in got.items()} == want
    far = spark.createDataFrame([(63999, 63999)], "row long, col int")
    began = time.time()
    assert view.snap_to_mask(far, spark.createDataFrame([(1, 0.0, 0.0)], "pid int, x double, y double"), GridSpec(64000, 64000)).head()["sx"] == 63999
    assert time.time() - began < 60


@pytest.mark.parametrize("side", [8, 256])
def test_forests_by_tiles(spark, side):
    import random

    from thalweg.plans import loops, paths

    rng = random.Random(side)
    spec = GridSpec(20, 19)
    rank = [rng.random() for _ in range(spec.size)]
    rows = []
    for i in range(spec.size):
        r, c = divmod(i, spec.ncols)
        lower = [j for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= r + a < spec.nrows and 0 <= c + b < spec.ncols and rank[j := (r + a) * spec.ncols + c + b] < rank[i]]
        if i % 41:
            rows.append((i, rng.choice(lower) if lower else None, float(rng.randint(0, 3)), rng.choice([1.0, 0.5])))
    nodes = spark.createDataFrame(rows, "id long, p long, d double, m double").cache()
    same = lambda a, b: sorted(tuple(r) for r in a.collect()) == [pytest.approx(x) for x in sorted(tuple(r) for r in b.collect())]
    assert same(paths.forest_roots(nodes, spec, side), loops.roots(nodes))
    own = nodes.selectExpr("id", "p", "d as s", "m")
    assert same(paths.forest_sums(own, spec, side), loops.doubled_sum(own))
    cost = nodes.selectExpr("id", "p", "d as c")
    assert same(paths.forest_most(cost, spec, side), loops.doubled_max(cost))


def test_forests_with_cycles(spark):
    from thalweg.plans import loops, paths

    nodes = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, None, 1.0), (5, 4, 1.0), (9, 5, 1.0)], "id long, p long, d double")
    spec = GridSpec(3, 6)
    for side in (2, 64):
        assert sorted(map(tuple, paths.forest_roots(nodes, spec, side).collect())) == sorted(map(tuple, loops.roots(nodes).collect()))
        own = nodes.selectExpr("id", "p", "d as s", "1.0D as m")
        assert sorted(map(tuple, paths.forest_sums(own, spec, side).collect())) == sorted(map(tuple, loops.doubled_sum(own).collect()))
