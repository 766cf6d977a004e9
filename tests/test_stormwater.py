"""Reaches, what drains to them, and a model's sections as text."""

import glob
import re

import numpy as np
from pyspark.sql import functions as F
from test_raster import cells as raster_cells

from thalweg.operators import hydro, stormwater, terrain
from thalweg.plans.loops import pinned


def test_reaches_and_sections(spark, tmp_path):
    rng = np.random.default_rng(5)
    z = rng.random((24, 18)) * 0.5 + np.arange(24)[::-1, None] * 0.6 + abs(np.arange(18) - 8.5)[None, :] * 0.4
    cells, spec = raster_cells(spark, z)
    flow = pinned(terrain.flowdir_d8(cells, spec), "flow")
    acc = pinned(hydro.accumulation(flow, spec), "acc")
    mask = acc.where("acc > 8").select("row", "col")
    reaches, drained = stormwater.reach_cells(flow, cells, mask, spec)
    held = {c: r["number"] for r in reaches.collect() for c in r["cells"][:-1]}
    p = {r["id"]: r["p"] for r in terrain.d8_edges(flow, spec).select("id", "p").collect()}
    rim = {r * 18 + c for r in range(24) for c in range(18) if r in (0, 23) or c in (0, 17)}
    channel = {r["row"] * 18 + r["col"] for r in mask.collect()} - rim
    want = {}
    for i in range(24 * 18):
        at = i
        while at is not None and at not in channel:
            at = None if at in rim else p.get(at)
        if at in held:
            want[i] = held[at]
    assert {r["row"] * 18 + r["col"]: r["reach"] for r in drained.collect()} == want
    table = stormwater.reach_table(flow, cells, mask, spec, acc)
    rows = {r["reach"]: r for r in table.collect()}
    assert sum(r["area"] for r in rows.values()) == len(want) * spec.dx * spec.dy
    flat = z.ravel()
    for r in reaches.collect():
        t, path = rows[r["number"]], r["cells"]
        far = sum(np.hypot((a // 18 - b // 18) * spec.dy, (a % 18 - b % 18) * spec.dx) for a, b in zip(path, path[1:], strict=False))
        assert np.isclose(t["length"], far) and np.isclose(t["drop"], flat[path[0]] - flat[path[-1]]) and np.isclose(t["width"], t["area"] / (far / 2))
    made = stormwater.sections(table, spec, junctions={"maxdepth": 5})
    path = str(tmp_path / "model")
    stormwater.write_sections(made, path, title="A title", series=[("0:00", 2.0)])
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))
    parts = re.split(r"^\[(\w+)\]\n", text, flags=re.MULTILINE)
    found = {parts[i]: parts[i + 1].strip("\n").split("\n") for i in range(1, len(parts), 2)}
    assert list(found) == ["TITLE", "OPTIONS", *(n.upper() for n in stormwater.COLUMNS), "TIMESERIES"]
    assert found["TITLE"] == ["A title"] and found["TIMESERIES"] == ["STEP_INPUT 0:00 2.0"]
    names = {line.split()[0] for s in ("JUNCTIONS", "OUTFALLS") for line in found[s]}
    links = [line.split() for line in found["CONDUITS"]]
    assert len(links) == len(rows) and {x for line in links for x in line[1:3]} <= names and len(found["COORDINATES"]) == len(names)
    assert all(line.split()[2] == "5" for line in found["JUNCTIONS"])
    areas = sum(float(line.split()[3]) for line in found["SUBCATCHMENTS"])
    assert np.isclose(areas * stormwater.HECTARE, len(want) * spec.dx * spec.dy)
    assert made["xsections"].where(F.col("geom_1") <= 1.1).isEmpty()
