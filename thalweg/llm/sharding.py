"""Sharding by a two-pass external shuffle, in SQL functions only.

First pass: seeded hashes scatter the records uniformly into buckets that fit in memory. Second pass: each bucket is put
into a fixed order, shuffled by Fisher-Yates (what the built-in ``shuffle`` does) and written. The built-in draws from the
partition's number on, so buckets are dealt to partitions by their own numbers alone: the order doesn't depend on how the
input or the session is partitioned. The shard of a record is the one of highest random weight for its id, so one more shard
takes records only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm.common import join_groups, materialise, scratch_dir

SEED = 20240607
SHARDS = 8
#: Bytes of text that a bucket should hold.
BUCKET_BYTES = 4 << 20
#: Partitions of the second pass, at most; each works through its buckets one after another.
PARTITIONS = 20_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of highest random weight, from 0."""
    weights = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), key) for s in range(shards)])
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def record_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> None:
    """Write all rows and columns of ``docs`` to ``path``, a folder ``__shard=N`` for each shard, with ``__bucket`` and
    ``__at`` (place in its bucket). Within a shard the order is by bucket, then place.

    Null ids share a shard; null texts are kept as such; long texts make their buckets larger. Rows equal in id and text
    share a bucket until they fill one; more of them are spread over as many buckets as they would fill. The order repeats
    for the same rows, but for rows that are spread.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column's name can clash
    size = record_bytes(F.col(f"`{text_col}`"))
    scatter = F.xxhash64(F.lit(seed + 1), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    row = F.struct(scatter.alias("h"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    rows = docs.select(shard_of(F.col(f"`{id_col}`"), shards, seed).alias("__shard"), scatter.alias("h"), row.alias("r"))
    groups = docs.select(scatter.alias("h"), size.alias("b")).groupBy("h").agg(F.sum("b").alias("b"), F.count("*").alias("n"))
    total, full = groups.agg(F.sum("b"), F.max(F.when(F.col("n") > 1, F.col("b")))).head()
    buckets = max(1, -(-(total or 0) // (bucket_bytes * shards)))
    spread = F.lit(0).cast("long")
    if (full or 0) > bucket_bytes:
        crowds = groups.where((F.col("n") > 1) & (F.col("b") > bucket_bytes)).select("h", "n", F.ceil(F.col("b") / bucket_bytes).alias("ways"))
        rows = join_groups(rows, materialise(crowds, "crowds"), "h", "n")
        spread = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("ways")), F.lit(0))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("h"), spread), F.lit(buckets)).cast("int")
    parts = max(1, min(buckets * shards, PARTITIONS))
    dealt = rows.select("__shard", bucket.alias("__bucket"), "r").repartition(parts, "__shard", "__bucket")
    piles = dealt.groupBy("__shard", "__bucket").agg(F.sort_array(F.collect_list("r")).alias("rs")).sortWithinPartitions("__shard", "__bucket")
    mixed = piles.select("__shard", "__bucket", F.posexplode(F.shuffle("rs", seed)).alias("__at", "r"))
    mixed.select(*[F.col(f"r.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)], "__bucket", "__at", "__shard").write.partitionBy("__shard").parquet(path)


def read_slots(files: DataFrame) -> DataFrame:
    """What ``write_shards`` wrote, with ``__slot``: its place in its shard, gapless from 0."""
    sizes = files.groupBy("__shard", "__bucket").agg((F.max("__at") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__shard", "__bucket", before.alias("__before"))
    return files.join(offsets, ["__shard", "__bucket"]).withColumn("__slot", (F.col("__before") + F.col("__at")).cast("long")).drop("__before")


def shard_table(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, path: str | None = None) -> DataFrame:
    """Write the shards (to a fresh shared folder unless ``path`` is given), read them again, and return per row its id,
    ``size`` (bytes plus 1), ``text_crc32``, ``law`` ("key"), ``shard``, ``slot`` and ``grown_shard`` (with one shard more).

    A null text is empty; whole texts are written, however long; null ids share a shard; repeated rows are records of their own;
    an empty table gives an empty table; further columns are dropped, whatever their names.
    """
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "shards")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    write_shards(docs, path, shards=shards, bucket_bytes=bucket_bytes, seed=seed)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.IntegerType()) for c in ("__bucket", "__at", "__shard")]])
    files = spark.read.schema(schema).parquet(path)
    thin = files.select("doc_id", record_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "__bucket", "__at", "__shard")
    out = read_slots(thin)
    return out.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"))
