"""Coordinate systems: a published point, the meridian's arc by quadrature, and round trips as columns and as numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_raster import cells

from thalweg.functions.crs import transform, transform_point
from thalweg.operators import view
from thalweg.spec import GridSpec


def test_published_point():
    x, y = transform_point(-79.387139, 43.642567, "EPSG:4326", "EPSG:32617")
    assert abs(x - 630084) < 1 and abs(y - 4833438) < 1


@pytest.mark.parametrize("lat", [-70.0, -10.0, 0.0, 45.0, 80.0])
def test_northing_is_the_arc_of_the_meridian(lat):
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    at = np.linspace(0, math.radians(lat), 20001)
    arc = np.trapezoid(6378137.0 * (1 - e2) / (1 - e2 * np.sin(at) ** 2) ** 1.5, at)
    x, y = transform_point(9.0, lat, "EPSG:4326", "EPSG:32732" if lat < 0 else "EPSG:32632")
    assert abs(x - 500000) < 1e-6 and abs(y - 0.9996 * arc - (1e7 if lat < 0 else 0)) < 1e-3


def test_round_trips_as_columns_and_numbers(spark):
    points = [(-79.4, 43.6), (-83.0, 5.0), (-78.2, 71.0)]
    df = spark.createDataFrame(points, "x double, y double")
    for crs in ("EPSG:32617", "EPSG:3857"):
        there = transform(F.col("x"), F.col("y"), "EPSG:4326", crs)
        got = df.select("x", "y", there[0].alias("u"), there[1].alias("v"))
        back = transform(F.col("u"), F.col("v"), crs, "EPSG:4326")
        for r in got.select("*", back[0].alias("p"), back[1].alias("q")).collect():
            assert abs(r["p"] - r["x"]) < 1e-8 and abs(r["q"] - r["y"]) < 1e-8
            assert np.allclose(transform_point(r["x"], r["y"], "EPSG:4326", crs), (r["u"], r["v"]), rtol=0, atol=1e-6)
    x, y = transform_point(-8837000.0, 5400000.0, "EPSG:3857", "EPSG:32617")
    assert np.allclose(transform_point(x, y, "EPSG:32617", "EPSG:3857"), (-8837000.0, 5400000.0), atol=1e-3)
    with pytest.raises(ValueError):
        transform_point(0.0, 0.0, "EPSG:4326", "EPSG:32699")


def test_raster_in_a_zone(spark):
    z = np.random.default_rng(0).random((20, 15))
    df, _ = cells(spark, z)
    spec = GridSpec(20, 15, (0.01, 0.0, -80.0, 0.0, -0.01, 44.0))
    got, target = view.to_crs(df, spec, "EPSG:32617")
    assert (target.nrows, target.ncols) == (20, 15)
    for r in got.collect():
        x, y = transform_point(*target.xy(r["row"], r["col"]), "EPSG:32617", "EPSG:4326")
        at = round((44.0 - y) / 0.01), round((x + 80.0) / 0.01)
        inside = 0 <= at[0] < 20 and 0 <= at[1] < 15
        assert r["z"] == (z[at] if inside else None)


def beyond_the_pole(spark, crs, pole=()):
    """A raster from 89.05 degrees south to 20 degrees beyond the pole, and where its rows before the pole have their corners."""
    nr, nc = 420, 3
    z = np.random.default_rng(1).random((nr, nc))
    spec = GridSpec(nr, nc, (0.05, 0.0, -97.0, 0.0, -0.05, -89.05))
    got, target = view.to_crs(cells(spark, z)[0], spec, crs)
    outline = [transform_point(*spec.xy(r, c), "EPSG:4326", crs) for r in range(19) for c in range(nc + 1)] + [*pole]
    assert np.allclose((target.affine[2], target.affine[5]), (min(p[0] for p in outline), max(p[1] for p in outline)), rtol=1e-12)
    rows = got.collect()
    assert (target.nrows, target.ncols, len(rows)) == (nr, nc, nr * nc)
    for r in rows:
        x, y = transform_point(*target.xy(r["row"], r["col"]), crs, "EPSG:4326")
        at = round((-89.05 - y) / 0.05), round((x + 97.0) / 0.05)
        inside = 0 <= at[0] < nr and 0 <= at[1] < nc
        assert r["z"] == (z[at] if inside else None)
    return target, outline, {r["z"] for r in rows} - {None}, z


def test_mercator_of_a_raster_beyond_the_pole(spark):
    """The pole and what is beyond it have no place there; every row before it has."""
    target, outline, found, z = beyond_the_pole(spark, "EPSG:3857")
    assert np.isclose(target.xy(target.nrows, 0)[1], min(p[1] for p in outline), rtol=1e-12)
    assert found >= set(z[:19].ravel())
    spec = GridSpec(3, 2, (1.0, 0.0, 0.0, 0.0, -1.0, -100.0))
    with pytest.raises(ValueError, match="no point"):
        view.to_crs(cells(spark, z[:3, :2])[0], spec, "EPSG:3857")


def test_zone_of_a_raster_beyond_the_pole(spark):
    """The pole itself has a place there, and what is beyond it isn't folded back."""
    pole = 500000.0, -0.9996 * 10001965.729  # the meridian's quarter
    target, _, found, z = beyond_the_pole(spark, "EPSG:32614", [pole])
    assert abs(target.xy(target.nrows, 0)[1] - pole[1]) < 1e-2
    assert found and found <= set(z[:20].ravel())
    df = spark.createDataFrame([(-97.0, lat) for lat in (-80.0, -100.0, 90.5, -367.0)], "x double, y double")
    for crs in ("EPSG:32614", "EPSG:3857", "EPSG:5070"):
        u, v = transform(F.col("x"), F.col("y"), "EPSG:4326", crs)
        assert [r["p"] is None for r in df.select((u + v).alias("p")).collect()] == [False, True, True, True]
        with pytest.raises(ValueError, match="beyond a pole"):
            transform_point(-97.0, -100.0, "EPSG:4326", crs)


CLARKE = "+proj=longlat +ellps=clrk66"


@pytest.mark.parametrize(
    ("definition", "point", "want"),
    [
        ("+proj=lcc +lat_1=33 +lat_2=45 +lat_0=23 +lon_0=-96 +ellps=clrk66", (-75, 35), (1894410.9, 1564649.5)),
        ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", (-75, 35), (1885472.7, 1535925.0)),
        ("+proj=tmerc +lon_0=-75 +k_0=0.9996 +ellps=clrk66", (-73.5, 40.5), (127106.5, 4484124.4)),
    ],
)
def test_published_points_of_projections(definition, point, want):
    got = transform_point(*point, CLARKE, definition)
    assert np.allclose(got, want, rtol=0, atol=0.06)
    assert np.allclose(transform_point(*got, definition, CLARKE), point, rtol=0, atol=2e-8)


@pytest.mark.parametrize("crs", ["EPSG:2154", "EPSG:3577", "EPSG:5070", "EPSG:4267", "+proj=lcc +lat_1=45 +lat_0=45 +lon_0=2 +k_0=0.9998 +x_0=1000 +units=us-ft +ellps=intl +towgs84=-87,-98,-121", "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +towgs84=375,-111,431", "+proj=aea +lat_1=20 +lat_2=20 +a=6370997 +b=6370997"])
def test_projections_round_as_columns_and_numbers(spark, crs):
    points = [(-3.0, 48.0), (1.5, 51.0), (4.0, 41.5)] if crs != "EPSG:3577" else [(130.0, -20.0), (150.0, -35.0)]
    df = spark.createDataFrame(points, "x double, y double")
    there = transform(F.col("x"), F.col("y"), "EPSG:4326", crs)
    got = df.select("x", "y", there[0].alias("u"), there[1].alias("v"))
    back = transform(F.col("u"), F.col("v"), crs, "EPSG:4326")
    for r in got.select("*", back[0].alias("p"), back[1].alias("q")).collect():
        assert abs(r["p"] - r["x"]) < 1e-7 and abs(r["q"] - r["y"]) < 1e-7
        assert np.allclose(transform_point(r["x"], r["y"], "EPSG:4326", crs), (r["u"], r["v"]), rtol=0, atol=1e-5)


def test_conics_keep_what_they_promise():
    """On the standard parallels lengths are true; Albers keeps areas everywhere and Lambert angles."""
    e2 = 6.69437999014e-3
    for kind, lats in (("lcc", (33.0, 45.0, 39.0, 60.0)), ("aea", (33.0, 45.0, 39.0, 60.0))):
        crs = f"+proj={kind} +lat_1=33 +lat_2=45 +lat_0=23 +lon_0=-96 +datum=WGS84"
        for lat in lats:
            h = 1e-5
            p = [transform_point(-80 + i * h, lat + j * h, "EPSG:4326", crs) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))]
            w = 1 - e2 * math.sin(math.radians(lat)) ** 2
            east = math.dist(p[0], p[1]) / (2 * math.radians(h) * 6378137 * math.cos(math.radians(lat)) / math.sqrt(w))
            north = math.dist(p[2], p[3]) / (2 * math.radians(h) * 6378137 * (1 - e2) / w**1.5)
            assert abs(east - north if kind == "lcc" else east * north - 1) < 1e-6
            if lat in (33.0, 45.0):
                assert abs(east - 1) < 1e-6


def test_what_has_no_formula():
    for crs in ("EPSG:9999", "+proj=laea +lat_0=52", "+proj=lcc +lat_1=1 +gamma=3", "+proj=tmerc +ellps=airy +towgs84=1,2,3,4,0,0,0"):
        with pytest.raises(ValueError, match="no formula|three shifts"):
            transform_point(0.0, 0.0, "EPSG:4326", crs)
