"""Operators along flow paths: accumulation, catchments, distances, height above drainage, streams.

D8 rasters are forests and are solved tile by tile, then between tiles by pointer doubling. Accumulation and distance to ridge of D-infinity
and MFD rasters, graphs without cycles, are solved tile by tile too, then between tiles by peeling; the rest go by rounds that
carry only what changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions.geometry import DIRMAP, cell_id, on_rim
from thalweg.operators.terrain import d8_edges, edges
from thalweg.plans.graphs import graph_carried
from thalweg.plans.loops import pinned, relaxed, roots
from thalweg.plans.paths import forest_most, forest_roots, forest_sums
from thalweg.spec import GridSpec

INF = float("inf")


def _id(spec: GridSpec) -> Column:
    return cell_id(spec, F.col("row"), F.col("col"))


def ranked(rows: DataFrame, *by: str | Column, parts: int = 0) -> DataFrame:
    """``rows`` with ``place``: their number in the order of ``by``, from 0. Ranges are numbered each on their own, and then moved by
    the sizes of those before them (a row for each range)."""
    by = [F.col(c) if isinstance(c, str) else c for c in by]
    spark = rows.sparkSession
    dealt = pinned(rows.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).withColumn("__i", F.monotonically_increasing_id()), "ranked")
    part, inside = F.shiftright("__i", 33), F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return dealt.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn("place", F.col("__b") + inside).drop("__p", "__i", "__b")


def _back(values: DataFrame, spec: GridSpec, *columns: str) -> DataFrame:
    return values.select(F.floor(F.col("id") / spec.ncols).cast("long").alias("row"), F.pmod("id", F.lit(spec.ncols)).cast("int").alias("col"), *columns)


def _weights(flow: DataFrame, spec: GridSpec, routing: str, weights: DataFrame | None) -> DataFrame:
    """id, ``w`` of every cell: 1 where D8 and D-infinity have data (MFD: everywhere), unless weights are given."""
    if weights is not None:
        return weights.select(_id(spec).alias("id"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    value = {"d8": "fdir", "dinf": "angle"}.get(routing)
    if value is None:
        return flow.sparkSession.range(spec.size).select("id", F.lit(1.0).alias("w"))
    return flow.select(_id(spec).alias("id"), F.when(F.col(value).isNull(), 0.0).otherwise(1.0).alias("w"))


def break_cycles(e: DataFrame, cycle_size: int = 1) -> DataFrame:
    """Edges (id, dst, k, prop) of a D-infinity raster without the cycles of up to ``cycle_size`` + 1 cells that it can make.

    Cells are taken by ascending id; from each the edges are followed for as many steps, over cells not taken yet, and an edge
    that leads back to it is turned to the other receiver of the cell it leaves. Shares stay, and so does an edge of a cell with
    one receiver. Only cells on such cycles are looked at, each connected group of them in order.
    """
    hops = e.select(F.col("id").alias("start"), F.array("id").alias("path"), F.col("dst").alias("at"))
    on = None
    for step in range(cycle_size):
        # only from the smallest id of a cycle on
        hops = hops.where("at > start").join(e.select(F.col("id").alias("at"), F.col("dst").alias("to")), "at").select("start", F.array_append("path", F.col("at")).alias("path"), F.col("to").alias("at"))
        hops = pinned(hops.where(~F.array_contains(F.slice("path", 2, cycle_size + 1), F.col("at"))), "hops") if step + 1 < cycle_size else hops
        back = hops.where("at = start").select("start", F.explode("path").alias("id"))
        on = back if on is None else on.unionByName(back)
    on = pinned(on.distinct(), "cycles")
    if on.isEmpty():
        return e
    pairs = on.select(F.col("start").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    labels = relaxed(on.select("id", F.col("id").cast("double").alias("v")), both).select("id", F.col("v").cast("long").alias("label"))
    group = labels.join(e.select("id", "dst"), "id")

    def turned(pdf):
        receivers: dict[int, list[int]] = {}
        for i, d in zip(pdf["id"].tolist(), pdf["dst"].tolist(), strict=True):
            receivers.setdefault(i, []).append(d)
        first = {i: list(d) for i, d in receivers.items()}
        taken = set()

        def follow(start: int, at: int, steps: int) -> None:
            for j, d in enumerate(list(receivers.get(at, ()))):
                if d == start and at != start:
                    receivers[at][j] = receivers[at][1 - j] if len(receivers[at]) == 2 else d
                elif steps and d not in taken and d in receivers and d != at:
                    follow(start, d, steps - 1)

        for i in sorted(receivers):
            follow(i, i, cycle_size)
            taken.add(i)
        rows = [(i, a, b) for i in receivers for a, b in zip(first[i], receivers[i], strict=True) if a != b]
        return type(pdf)(rows, columns=["id", "dst", "now"]).astype("int64")

    changes = pinned(group.groupBy("label").applyInPandas(turned, "id long, dst long, now long"), "turned")
    return e.join(changes, ["id", "dst"], "left").select("id", F.coalesce("now", "dst").alias("dst"), "k", "prop")


def accumulation(flow: DataFrame, spec: GridSpec, routing: str = "d8", *, weights: DataFrame | None = None, efficiency: DataFrame | None = None, dirmap=DIRMAP, cycle_size: int = 1) -> DataFrame:
    """row, col, ``acc``: the weight of a cell and of all that flows into it. ``efficiency`` (row, col, e) scales what leaves a cell."""
    if routing == "d8" and weights is None and efficiency is None:
        one, none = F.lit(1.0), F.lit(0.0)
        nodes = d8_edges(flow, spec, dirmap).select("id", "p", one.alias("s"), one.alias("m"))
        nodes = nodes.unionByName(flow.where("fdir is null").select(_id(spec).alias("id"), F.lit(None).cast("long").alias("p"), none.alias("s"), one.alias("m")))
        return _back(forest_sums(nodes, spec).withColumnRenamed("s", "acc"), spec, "acc")
    w = _weights(flow, spec, routing, weights)
    if efficiency is not None:
        w = w.join(efficiency.select(_id(spec).alias("id"), F.col("e").cast("double").alias("m")), "id", "left")
    else:
        w = w.withColumn("m", F.lit(1.0))
    w = w.select("id", "w", F.coalesce("m", F.lit(1.0)).alias("m"))
    if routing == "d8":
        nodes = w.join(d8_edges(flow, spec, dirmap).select("id", "p"), "id", "left").select("id", "p", F.col("w").alias("s"), "m")
        return _back(forest_sums(nodes, spec).withColumnRenamed("s", "acc"), spec, "acc")
    e = edges(flow, spec, routing, dirmap)
    if routing == "dinf":
        e = break_cycles(pinned(e, "edges"), cycle_size)
    e = e.join(w.select("id", "m"), "id").select(F.col("id").alias("src"), "dst", (F.col("prop") * F.col("m")).alias("m"))
    return _back(graph_carried(w.select("id", F.col("w").alias("s")), e, spec).withColumnRenamed("s", "acc"), spec, "acc")


def _pour(spec: GridSpec, x: float, y: float, xytype: str, snap: str) -> int:
    if xytype in ("coordinate", "label"):
        b = spec.bbox
        if not (b[0] <= x <= b[2] and b[1] <= y <= b[3]):
            raise ValueError("the pour point is outside the grid")
        col, row = spec.nearest_cell(x, y, snap)
    elif xytype == "index":
        col, row = int(x), int(y)
    else:
        raise ValueError(f"xytype must be 'coordinate', 'label' or 'index', not {xytype!r}")
    if not (0 <= row < spec.nrows and 0 <= col < spec.ncols):
        raise ValueError("the pour point is outside the grid")
    return row * spec.ncols + col


def _to_pour(flow: DataFrame, spec: GridSpec, dirmap, pour: int, rim: bool) -> DataFrame:
    """Pointers that end at the pour point, and, if asked, at the rim."""
    stop = F.col("id") == pour
    if rim:
        stop = stop | on_rim(spec, F.col("row"), F.col("col"))
    return d8_edges(flow, spec, dirmap).select("id", F.when(~stop, F.col("p")).alias("p"))


def catchment(x: float, y: float, flow: DataFrame, spec: GridSpec, routing: str = "d8", *, xytype: str = "coordinate", snap: str = "corner", dirmap=DIRMAP) -> DataFrame:
    """row, col of the cells whose flow reaches the pour point, itself included; other cells of the rim are never among them."""
    pour = _pour(spec, x, y, xytype, snap)
    if routing == "d8":
        return _back(forest_roots(_to_pour(flow, spec, dirmap, pour, True).withColumn("d", F.lit(0.0)), spec).where(F.col("root") == pour), spec)
    e = edges(flow, spec, routing, dirmap).select(F.col("dst").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"))
    e = e.where(~on_rim(spec, F.floor(F.col("dst") / spec.ncols), F.pmod("dst", F.lit(spec.ncols))))
    start = flow.sparkSession.createDataFrame([(pour, 0.0)], "id long, v double")
    return _back(relaxed(start, e), spec)


def distance_to_outlet(x: float, y: float, flow: DataFrame, spec: GridSpec, routing: str = "d8", *, weights: DataFrame | None = None, xytype: str = "coordinate", snap: str = "corner", dirmap=DIRMAP) -> DataFrame:
    """row, col, ``dist`` of the cells that reach the pour point: the least sum of weights of the cells on the way, the pour
    point's own left out. Cells that don't reach it are not returned (their distance is infinite)."""
    pour = _pour(spec, x, y, xytype, snap)
    w = _weights(flow, spec, routing, weights)
    if routing == "d8":
        nodes = _to_pour(flow, spec, dirmap, pour, False)  # its cells have data, so each weighs 1
        nodes = nodes.withColumn("d", F.lit(1.0)) if weights is None else nodes.join(w, "id").select("id", "p", F.col("w").alias("d"))
        return _back(forest_roots(nodes, spec).where(F.col("root") == pour).withColumnRenamed("d", "dist"), spec, "dist")
    e = edges(flow, spec, routing, dirmap)
    if routing == "mfd":
        e = e.where(~on_rim(spec, F.floor(F.col("id") / spec.ncols), F.pmod("id", F.lit(spec.ncols))))
    e = e.join(w, "id").select(F.col("dst").alias("src"), F.col("id").alias("dst"), "w")
    start = flow.sparkSession.createDataFrame([(pour, 0.0)], "id long, v double")
    return _back(relaxed(start, e).withColumnRenamed("v", "dist"), spec, "dist")


def distance_to_ridge(flow: DataFrame, spec: GridSpec, routing: str = "d8", *, weights: DataFrame | None = None, dirmap=DIRMAP, cycle_size: int = 1) -> DataFrame:
    """row, col, ``dist``: the greatest sum of weights on a path from a ridge cell, whose own weight is left out."""
    w = _weights(flow, spec, routing, weights)
    if routing == "d8":
        e = d8_edges(flow, spec, dirmap).select("id", "p").join(w.select(F.col("id").alias("p"), F.col("w").alias("c")), "p", "left").select("id", "p", F.coalesce("c", F.lit(0.0)).alias("c"))
        return _back(forest_most(e, spec).withColumnRenamed("r", "dist"), spec, "dist")
    e = edges(flow, spec, routing, dirmap)
    if routing == "dinf":
        e = break_cycles(pinned(e, "edges"), cycle_size)
    e = e.join(w.select(F.col("id").alias("dst"), "w"), "dst").select(F.col("id").alias("src"), "dst", F.col("w").alias("m"))
    if weights is not None:  # cells without a weight send nothing
        e = e.join(w.select(F.col("id").alias("src")), "src", "left_semi")
    return _back(graph_carried(w.select("id", F.lit(0.0).alias("s")), e, spec, greatest=True).withColumnRenamed("s", "dist"), spec, "dist")


def compute_hand(flow: DataFrame, cells: DataFrame, mask: DataFrame, spec: GridSpec, routing: str = "d8", *, dirmap=DIRMAP) -> DataFrame:
    """row, col, ``channel`` (id of the nearest channel cell downstream, by steps) and ``hand`` (height above it) of the cells
    that reach one. ``mask`` has the channel cells' row and col; the rim has neither channels nor flow. Of channel cells
    equally near, D-infinity and MFD take the one whose cells come first: channels by descending id, then, step by step, cells by
    the place of the one they lead to, and by their direction from it (N, NE, E, ...)."""
    inner = ~on_rim(spec, F.col("row"), F.col("col"))
    channel = mask.where(inner).select(_id(spec).alias("id")).distinct()
    z = cells.select(_id(spec).alias("id"), "z")
    if routing == "d8":
        e = d8_edges(flow, spec, dirmap).select("id", F.when(inner, F.col("p")).alias("p")).join(channel.withColumn("c", F.lit(True)), "id", "left")
        found = forest_roots(e.select("id", F.when(F.col("c").isNull(), F.col("p")).alias("p"), F.lit(0.0).alias("d")), spec).join(channel.withColumnRenamed("id", "root"), "root", "left_semi").select("id", F.col("root").alias("channel"))
    else:
        e = pinned(edges(flow, spec, routing, dirmap).where(~on_rim(spec, F.floor(F.col("id") / spec.ncols), F.pmod("id", F.lit(spec.ncols)))).select("id", "dst", F.pmod(F.col("k") + 4, F.lit(8)).alias("j")), "edges")
        found = front = pinned(channel.select("id", F.col("id").alias("channel"), (-F.col("id")).alias("place")), "found")
        while True:
            first = F.min(F.struct("place", "j", "channel")).alias("x")
            up = e.join(front.withColumnRenamed("id", "dst"), "dst").groupBy("id").agg(first).join(found.select("id"), "id", "left_anti")
            up = pinned(up.select("id", "x.channel", (F.col("x.place") * 8 + F.col("x.j")).alias("order")), "front")
            if up.isEmpty():
                break
            front = pinned(ranked(up, "order").select("id", "channel", F.col("place")), "front")
            found = pinned(found.unionByName(front), "found")
        found = found.select("id", "channel")
    low = z.select(F.col("id").alias("channel"), F.col("z").alias("zc"))
    return _back(found.join(z, "id").join(low, "channel").select("id", "channel", (F.col("z") - F.col("zc")).alias("hand")), spec, "channel", "hand")


def inundation(hand: DataFrame, spec: GridSpec, depth: float | DataFrame) -> DataFrame:
    """row, col, ``depth`` of water where ``hand`` (of compute_hand) is below that of its channel: one number for all channels,
    or a table (row, col, depth) of which the channel's cell is looked up."""
    if isinstance(depth, DataFrame):
        of = depth.select(_id(spec).alias("channel"), F.col("depth").cast("double").alias("full"))
        wet = hand.join(of, "channel")
    else:
        wet = hand.withColumn("full", F.lit(float(depth)))
    return wet.where("hand < full").select("row", "col", (F.col("full") - F.col("hand")).alias("depth"))


def _channels(flow: DataFrame, mask: DataFrame, spec: GridSpec, dirmap) -> DataFrame:
    """id, ``p``, ``fed`` (cells that flow in, and one more for a sink) of the masked cells and of the cells they leave into."""
    inner = ~on_rim(spec, F.col("row"), F.col("col"))
    on = mask.where(inner).select(_id(spec).alias("id")).distinct()
    e = pinned(d8_edges(flow, spec, dirmap).select("id", "p").join(on, "id", "left_semi"), "channels")
    fed = e.where("p is not null").groupBy(F.col("p").alias("id")).agg(F.count("*").alias("n"))
    nodes = e.select("id").unionByName(fed.select("id")).distinct().join(e, "id", "left").join(fed, "id", "left")
    return pinned(nodes.select("id", "p", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) + F.col("p").isNull().cast("long")).alias("fed")), "channels")


def segments(flow: DataFrame, mask: DataFrame, spec: GridSpec, *, dirmap=DIRMAP) -> DataFrame:
    """``head``, ``tail`` and ``cells`` (ids from head to tail) of the stretches between heads, junctions and sinks, with
    ``number``: heads from the largest id down, each walked until it meets what is numbered."""
    n = _channels(flow, mask, spec, dirmap)
    node = n.select("id", "p", "n", ((F.col("n") == 0) | (F.col("fed") > 1)).alias("node"))
    # each cell's next node down: pointers stop at nodes
    down = roots(node.select("id", F.when(~F.col("node"), F.col("p")).alias("p"), F.lit(1.0).alias("d")))
    start = node.where("node and p is not null").select(F.col("id").alias("head"), F.col("p").alias("id"))
    ends = start.join(down, "id").select("head", F.col("root").alias("tail"), F.col("id").alias("second"), F.col("d").alias("steps"))
    ends = pinned(ends, "segments")
    inside = node.where("not node").select("id").join(down, "id")
    # which segment a cell within one belongs to: the one whose second cell leads to it, known by the walk upwards
    up = roots(node.where("p is not null").select(F.col("p").alias("id"), F.col("id").alias("q")).join(node.where("not node").select("id"), "id", "left_semi").select("id", F.col("q").alias("p"), F.lit(1.0).alias("d")).unionByName(node.where("node").select("id", F.lit(None).cast("long").alias("p"), F.lit(0.0).alias("d"))))
    within = inside.select("id").join(up, "id").select(F.col("root").alias("head"), F.struct(F.col("d").cast("long").alias("at"), "id").alias("x"))
    first = ends.select("head", F.struct(F.lit(0).cast("long").alias("at"), F.col("head").alias("id")).alias("x"))
    last = ends.select("head", F.struct((F.col("steps") + 1).cast("long").alias("at"), F.col("tail").alias("id")).alias("x"))
    lists = within.unionByName(first).unionByName(last).groupBy("head").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["id"]).alias("cells"))
    # the walk that emits a segment starts at the largest head above it
    above = doubled_max_id(node.select("id", "p", F.when(F.col("n") == 0, F.col("id")).otherwise(-1).alias("v")))
    depth = roots(n.select("id", "p", F.lit(1.0).alias("d"))).select(F.col("id").alias("head"), F.col("d").alias("below"))
    keyed = ends.select("head", "tail").join(lists, "head").join(above.select(F.col("id").alias("head"), "v"), "head").join(depth, "head")
    numbers = ranked(keyed.select("head", "v", "below"), F.col("v").desc(), F.col("below").desc()).select("head", F.col("place").cast("int").alias("number"))
    return pinned(keyed.join(numbers, "head").select("number", "head", "tail", "cells"), "segments")


def doubled_max_id(nodes: DataFrame) -> DataFrame:
    """Of ``nodes`` (id, p, v): id and the greatest ``v`` of itself and of all that leads to it."""
    live = pinned(nodes, "most")
    for _ in range(nodes.count().bit_length() + 2):
        up = live.where("p is not null")
        if up.isEmpty():
            break
        gain = up.groupBy(F.col("p").alias("id")).agg(F.max("v").alias("g"))
        to = live.select(F.col("id").alias("p"), F.col("p").alias("q"))
        live = pinned(live.join(gain, "id", "left").join(to, "p", "left").select("id", F.col("q").alias("p"), F.greatest("v", "g").alias("v")), "most")
    if not live.where("p is not null").isEmpty():
        raise ValueError("the flow directions have a cycle")
    return live.select("id", "v")


def extract_river_network(flow: DataFrame, mask: DataFrame, spec: GridSpec, *, dirmap=DIRMAP) -> DataFrame:
    """``number``, ``head``, ``tail`` and ``geometry`` (GeoJSON LineString over the corners of the segment's cells)."""
    a, b, c, d, e, f = spec.affine

    def corner(i: Column) -> Column:
        row, col = F.floor(i / spec.ncols).cast("double"), F.pmod(i, F.lit(spec.ncols)).cast("double")
        return F.array(F.lit(a) * col + F.lit(b) * row + F.lit(c), F.lit(d) * col + F.lit(e) * row + F.lit(f))

    shape = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform("cells", corner).alias("coordinates")))
    return segments(flow, mask, spec, dirmap=dirmap).select("number", "head", "tail", shape.alias("geometry"))


def extract_profiles(flow: DataFrame, mask: DataFrame, spec: GridSpec, *, include_endpoint: bool = True, dirmap=DIRMAP) -> DataFrame:
    """``number``, ``cells`` and ``next`` (the segment that begins where this one ends; a terminal one's first of its sink)."""
    s = segments(flow, mask, spec, dirmap=dirmap)
    starts = s.select(F.col("head").alias("tail"), F.col("number").alias("after"))
    ends = s.groupBy("tail").agg(F.min("number").alias("first"))
    out = s.join(starts, "tail", "left").join(ends, "tail")
    cells = F.col("cells") if include_endpoint else F.slice("cells", 1, F.size("cells") - 1)
    return out.select("number", cells.alias("cells"), F.coalesce("after", "first").alias("next"))


def stream_order(flow: DataFrame, mask: DataFrame, spec: GridSpec, *, dirmap=DIRMAP) -> DataFrame:
    """row, col, ``ord``: Strahler order of the masked cells and of those they leave into. Orders meet at junctions only, so
    the loop runs over segments, a round for each level of the tree; a sink counts as fed once more."""
    n = _channels(flow, mask, spec, dirmap)
    node = n.select("id", "p", "n", "fed", ((F.col("n") == 0) | (F.col("fed") > 1)).alias("node"))
    down = roots(node.select("id", F.when(~F.col("node"), F.col("p")).alias("p"), F.lit(1.0).alias("d")))
    ends = pinned(node.where("node and p is not null").select("id", "p").join(down.select(F.col("id").alias("p"), F.col("root").alias("tail")), "p").select(F.col("id").alias("head"), "tail"), "segments")
    known = front = pinned(node.where("n = 0").select("id", F.lit(1).alias("ord")), "orders")
    while True:
        sent = ends.join(known.withColumnRenamed("id", "head"), "head").groupBy("tail").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("got"))
        ready = node.where("node and n > 0").join(sent, node["id"] == sent["tail"]).where("got = n").join(known.select("id"), "id", "left_anti")
        front = pinned(ready.select("id", (F.col("hi") + ((F.col("lo") == F.col("hi")) & (F.col("fed") > 1)).cast("int")).alias("ord")), "front")
        if front.isEmpty():
            break
        known = pinned(known.unionByName(front), "orders")
    # cells within a segment have the order of the node above them
    up = roots(node.where("p is not null").select(F.col("p").alias("id"), F.col("id").alias("q")).join(node.where("not node").select("id"), "id", "left_semi").select("id", F.col("q").alias("p"), F.lit(1.0).alias("d")).unionByName(node.where("node").select("id", F.lit(None).cast("long").alias("p"), F.lit(0.0).alias("d"))))
    return _back(up.join(known.withColumnRenamed("id", "root"), "root").select("id", "ord"), spec, "ord")
