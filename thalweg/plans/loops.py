"""Loops over DataFrames: lineage cut by tables in the shared folder, and pointer doubling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local master uses
    the warehouse; on a cluster that might be local to a machine, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{base.rstrip('/')}/thalweg/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, name: str = "step") -> DataFrame:
    """``df``, written to the folder in spark.checkpoint.dir (the warehouse where it is unset) and read back, so that a lost
    executor costs no more than one step."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Cycles(ValueError):
    """The pointers have a cycle."""


def _doublings(nodes: DataFrame) -> int:
    """So many doublings outlast every path of a forest of ``nodes``; a pointer that is left then is on or above a cycle."""
    return nodes.count().bit_length() + 1


def roots(nodes: DataFrame) -> DataFrame:
    """Of ``nodes`` (id, p: the next node or null, d: the cost of the step): id, ``root`` (the last node of its path) and
    ``d`` (the cost of the path), after about log2(longest path) rounds. Nodes on or above a cycle have no root."""
    first = pinned(nodes.select("id", "p", F.when(F.col("p").isNull(), 0.0).otherwise(F.col("d")).alias("d")), "roots")
    done = first.where("p is null").select("id", F.col("id").alias("root"), "d")
    live = first.where("p is not null").select("id", "p", "d", F.lit(False).alias("stop"))
    for _ in range(_doublings(first)):
        done = done.unionByName(live.where("stop").select("id", F.col("p").alias("root"), "d"))
        going = live.where("not stop")
        if going.isEmpty():
            return pinned(done, "rooted")
        # a pointer leads to a node that goes on, or to one that knows its root
        to = going.select(F.col("id").alias("p"), F.col("p").alias("q"), F.col("d").alias("e"), F.lit(False).alias("end")).unionByName(done.select(F.col("id").alias("p"), F.col("root").alias("q"), F.col("d").alias("e"), F.lit(True).alias("end")))
        live = pinned(going.join(to, "p").select("id", F.col("q").alias("p"), (F.col("d") + F.col("e")).alias("d"), F.col("end").alias("stop")), "roots")
    return pinned(done, "rooted")


def doubled_sum(nodes: DataFrame, peel: bool = True) -> DataFrame:
    """Of ``nodes`` (id, p, s: own amount, m: share passed on): id and ``s``, the amount with all that reaches it. A round joins
    each node with what points to it, then doubles the pointers. Where there are cycles, ``peeled`` takes over (or, without
    ``peel``, Cycles is raised)."""
    first = live = pinned(nodes.select("id", "p", "s", "m"), "sum")
    for turn in range(_doublings(first) + 1):
        up = live.where("p is not null")
        if up.isEmpty():
            break
        if turn == _doublings(first):
            if not peel:
                raise Cycles
            return peeled(first.select("id", "s"), first.where("p is not null").select(F.col("id").alias("src"), F.col("p").alias("dst"), "m"))
        gain = up.groupBy(F.col("p").alias("id")).agg(F.sum(F.col("m") * F.col("s")).alias("g"))
        to = live.select(F.col("id").alias("p"), F.col("p").alias("q"), F.col("m").alias("n"))
        live = pinned(live.join(gain, "id", "left").join(to, "p", "left").select("id", F.col("q").alias("p"), (F.col("s") + F.coalesce("g", F.lit(0.0))).alias("s"), (F.col("m") * F.coalesce("n", F.lit(1.0))).alias("m")), "sum")
    return live.select("id", "s")


def doubled_max(nodes: DataFrame, peel: bool = True) -> DataFrame:
    """Of ``nodes`` (id, p, c: cost of stepping into p): id and ``r``, the greatest cost of a path that ends there, 0 (or the ``r`` of
    ``nodes``) at least. Where there are cycles, ``peeled`` takes over (or, without ``peel``, Cycles is raised)."""
    own = F.col("r") if "r" in nodes.columns else F.lit(0.0)
    first = live = pinned(nodes.select("id", "p", "c", own.alias("r")), "max")
    for turn in range(_doublings(first) + 1):
        up = live.where("p is not null")
        if up.isEmpty():
            break
        if turn == _doublings(first):
            if not peel:
                raise Cycles
            steps = first.where("p is not null").select(F.col("id").alias("src"), F.col("p").alias("dst"), F.col("c").alias("m"))
            return peeled(first.select("id", F.col("r").alias("s")), steps, greatest=True).withColumnRenamed("s", "r")
        gain = up.groupBy(F.col("p").alias("id")).agg(F.max(F.col("r") + F.col("c")).alias("g"))
        to = live.select(F.col("id").alias("p"), F.col("p").alias("q"), F.col("c").alias("e"))
        live = pinned(live.join(gain, "id", "left").join(to, "p", "left").select("id", F.col("q").alias("p"), (F.col("c") + F.coalesce("e", F.lit(0.0))).alias("c"), F.greatest("r", F.coalesce("g", F.lit(0.0))).alias("r")), "max")
    return live.select("id", "r")


def peeled(amounts: DataFrame, edges: DataFrame, greatest: bool = False) -> DataFrame:
    """Of ``amounts`` (id, s) and ``edges`` (src, dst, m): id and ``s`` with all that reaches it: amounts times shares added, or the
    greatest of amounts plus costs. A node sends on once all that leads to it has, so those on cycles and below keep what has
    reached them by then. A round carries the nodes that wait; those that have sent leave."""
    return _together(list(peel(amounts, edges, greatest)))


def peel(amounts: DataFrame, edges: DataFrame, greatest: bool = False) -> tuple[DataFrame, DataFrame]:
    """As ``peeled``, but those that all has reached, and apart from them those on cycles and below."""
    edges = pinned(edges.select("src", "dst", "m"), "edges")
    need = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    waiting = pinned(amounts.select("id", "s").join(need, "id", "left").select("id", "s", F.coalesce("need", F.lit(0)).alias("need")), "waiting")
    done: list[DataFrame] = [waiting.where("need < 0").select("id", "s")]
    while True:
        ready = waiting.where("need = 0")
        if ready.isEmpty():
            break
        done.append(ready.select("id", "s"))
        if len(done) == 16:
            done = [pinned(_together(done), "done")]
        value = F.max(F.col("s") + F.col("m")) if greatest else F.sum(F.col("s") * F.col("m"))
        sent = ready.join(edges, ready.id == edges.src).groupBy(F.col("dst").alias("id")).agg(value.alias("g"), F.count("*").alias("c"))
        reached = F.greatest("s", "g") if greatest else F.col("s") + F.coalesce("g", F.lit(0.0))
        waiting = pinned(waiting.where("need > 0").join(sent, "id", "left").select("id", reached.alias("s"), (F.col("need") - F.coalesce("c", F.lit(0))).alias("need")), "waiting")
    return _together(done), waiting.select("id", "s")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relaxed(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Of ``start`` (id, v) and ``edges`` (src, dst, w: 0 at least): id and the least ``v`` of ``start`` plus weights on any path to
    it. Only nodes whose value fell send it on, until none does."""
    edges = pinned(edges.select("src", "dst", "w"), "edges")
    known = front = pinned(start.groupBy("id").agg(F.min("v").alias("v")), "known")
    while True:
        sent = front.join(edges, front.id == edges.src).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("v") + F.col("w")).alias("n"))
        joined = sent.join(known, "id", "left")
        front = pinned(joined.where(F.col("v").isNull() | (F.col("n") < F.col("v"))).select("id", F.col("n").alias("v")), "front")
        if front.isEmpty():
            return known
        known = pinned(known.unionByName(front).groupBy("id").agg(F.min("v").alias("v")), "known")
