"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"

#: A key is hot when it holds more than one in HOT_SHARE rows, so there are fewer than HOT_SHARE hot keys
#: whatever the input: a proven bound for broadcasting them.
HOT_SHARE = 1000


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the session has no such setting, a local master (tests) uses a folder under the warehouse; on a cluster that might be
    local to a machine, so it is an error. The folder belongs to one run; it may be deleted once that run's result is written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{base.rstrip('/')}/thalweg/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced(text: Column) -> Column:
    """``text`` with every white space character of the word rule as a blank; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))


def words(text: Column) -> Column:
    """The words of ``text`` in order."""
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")


def unsigned_hex(x: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """Left-join ``rows`` to ``groups`` (one row per non-null ``key``, with its number of rows in ``count``).

    Hot keys (fewer than HOT_SHARE of them, see above) are joined by broadcast and so never meet in one task;
    in the shuffle that joins the rest no key holds more than one row in HOT_SHARE. ``groups`` is read twice
    and should be materialised. Its columns but the key come in place of columns of ``rows`` with the same names.
    """
    total = groups.agg(F.sum(count)).head()[0] or 0
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    names = [c for c in groups.columns if c != key]
    keep = [c for c in rows.columns if c not in names]
    packed = groups.select(F.col(key), F.struct(*names).alias("__g"), is_hot.alias("__hot"))
    hot, rest = packed.where("__hot").select(key, F.col("__g").alias("__h")), packed.where("not __hot").select(key, "__g")
    flagged = rows.select(*keep).join(F.broadcast(hot), key, "left")
    of = lambda df, g: df.select(*keep, *[F.col(f"{g}.{c}").alias(c) for c in names])
    return of(flagged.where(F.col("__h").isNotNull()), "__h").unionByName(of(flagged.where(F.col("__h").isNull()).drop("__h").join(rest, key, "left"), "__g"))
