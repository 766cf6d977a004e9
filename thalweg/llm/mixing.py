"""Mixing sources to target weights by temperature, in SQL functions only.

The share of tokens of each source is raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised.
The exponent is bisected: it is the largest that reaches a target entropy, or, if that repeats a source's documents more
often than allowed, the smallest that doesn't. The weights are realised with the smallest budget that uses every
document at least once: a source's whole epochs, each a permutation of its blocks of its own, and one epoch more of which only
as many tokens are taken as its budget has left. The order of use lays every source's epochs evenly along the mix, so any
stretch of it has about the target weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.common import join_groups, materialise

SEED = 20240607
#: Blocks of a source's permutation: two to the power of twice HALF.
HALF = 6
BLOCKS = 1 << 2 * HALF
#: Production parameters: share of the greatest possible entropy to reach; how often a document may be used.
TARGET_ENTROPY, MAX_REPEATS = 0.95, 2.0
#: Up to so many sources, what their last epochs end with is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Values of the exponent that one pass looks at; passes. The interval shrinks to 17 ** -8.
POINTS, PASSES = 16, 8


def count_words(text: Column) -> Column:
    """The default count of a document's tokens: its words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _shrink(shares: DataFrame, ok, lo: float, hi: float) -> tuple[float, float]:
    """The interval between the last exponent that is ``ok`` and the first that isn't; at ``lo`` it is, at ``hi`` it isn't.
    A pass is one aggregation over the sources, which may be many."""
    for _ in range(PASSES):
        points = [lo + (hi - lo) * (k + 1) / (POINTS + 1) for k in range(POINTS)]
        row = shares.agg(*[x for k, a in enumerate(points) for x in (F.sum(F.pow("p", F.lit(a))).alias(f"z{k}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"s{k}"))]).head()
        good = [ok(a, row[f"z{k}"], row[f"s{k}"]) for k, a in enumerate(points)]
        first = next((k for k, g in enumerate(good) if not g), POINTS)
        lo, hi = (points[first - 1] if first else lo), (points[first] if first < POINTS else hi)
    return lo, hi


def exponent(shares: DataFrame, target: float = TARGET_ENTROPY, repeats: float = MAX_REPEATS) -> float:
    """Of ``shares`` (one row per source, its share ``p`` over 0)."""
    n, least, most, plain = shares.agg(F.count("*"), F.min("p"), F.max("p"), F.sum(-F.col("p") * F.log("p"))).head()
    if not n or n == 1:
        return 1.0
    wanted = target * math.log(n)
    if plain >= wanted:
        return 1.0
    even = _shrink(shares, lambda a, z, s: math.log(z) - a * s / z >= wanted, 0.0, 1.0)[0]
    repeated = lambda a: (most / least) ** (1 - a)
    if repeated(even) <= repeats:
        return even
    return _shrink(shares, lambda a, z, s: repeated(a) > repeats, 0.0, 1.0)[1]


def permuted(block: Column, key: Column, epoch: Column, seed: int) -> Column:
    """The place of a block in the permutation of a source's epoch: a Feistel network of four rounds of seeded hashes."""
    left, right = F.shiftright(block, HALF), block.bitwiseAND(F.lit((1 << HALF) - 1))
    for turn in range(4):
        left, right = right, left.bitwiseXOR(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), key, epoch.cast("long"), right), F.lit(1 << HALF)).cast("int"))
    return F.shiftleft(left, HALF).bitwiseOR(right)


def block_of(place: Column) -> Column:
    return F.pmod(F.shiftright(place, 40), F.lit(BLOCKS)).cast("int")


def plan(docs: DataFrame, id_col: Column, source: Column, text: Column, carried: Column, *, tokens=count_words, target: float = TARGET_ENTROPY, repeats: float = MAX_REPEATS, seed: int = SEED) -> tuple[DataFrame, float]:
    """The plan and the tokens of its budget. Per row ``row`` (what is ``carried``), ``tokens``, ``key`` (of its source), ``weight`` (of its source), ``times`` (epochs of
    its source, the last in part), ``copies`` and ``place`` (a hash of it).

    The copies of a source's documents hold its share of the budget but for less than one document, or than the rows that
    are equal to it. A null source is a source. Sources without tokens keep one copy of each document.
    """
    key = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))
    rows = docs.select(carried.alias("row"), tokens(text).alias("tokens"), key.alias("key"), F.xxhash64(F.lit(seed), key, id_col, text).alias("place"))
    # narrow: what the plan needs of each document
    thin = materialise(rows.select("key", "tokens", "place", block_of(F.col("place")).alias("block")), "thin")
    blocks = materialise(thin.groupBy("key", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "blocks")
    sources = blocks.groupBy("key").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    total = sources.agg(F.sum("t")).head()[0] or 0
    shares = materialise(sources.withColumn("p", F.col("t") / F.lit(float(max(total, 1)))), "sources")
    used = shares.where("p > 0")
    a = exponent(used, target, repeats)
    z, top, n_sources = used.agg(F.sum(F.pow("p", F.lit(a))), F.max("p"), F.count("*")).head()
    times = F.when(F.col("p") > 0, F.pow("p", F.lit(a - 1)) / F.lit(float(top or 1.0) ** (a - 1))).otherwise(1.0)
    whole = F.floor(F.col("times") + 1e-9)
    shares = shares.select("key", "n", F.when(F.col("p") > 0, F.pow("p", F.lit(a)) / F.lit(float(z or 1.0))).otherwise(0.0).alias("weight"), times.alias("times"), "t")
    shares = shares.select("key", "n", "weight", "times", whole.alias("whole"), ((F.col("times") - whole) * F.col("t")).alias("left"))
    # at most BLOCKS rows of a source: the block of its last epoch's permutation in which the budget ends
    ranked = blocks.drop("n").join(shares.select("key", "whole", "left"), "key").withColumn("rank", permuted(F.col("block"), F.col("key"), F.col("whole"), seed))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = ranked.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("t") > F.col("left"))).select("key", "block", "rank", (F.col("left") - F.col("before")).alias("rest"))
    # equal rows are one row here, so that none of them waits for the others in one task
    inside = thin.join(F.broadcast(cut), ["key", "block"]) if n_sources <= BROADCAST_SOURCES else thin.join(cut, ["key", "block"])
    inside = inside.groupBy("key", "place", "rest").agg(F.sum("tokens").alias("t"))
    running = F.sum("t").over(Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("running", running).where(F.col("running") <= F.col("rest")).groupBy("key").agg(F.max("place").alias("last"))
    ends = materialise(shares.join(cut.select("key", F.col("rank").alias("end")), "key", "left").join(last, "key", "left"), "ends")
    rank = permuted(block_of(F.col("place")), F.col("key"), F.col("whole"), seed)
    more = F.when(F.col("left") < 1, False).when(F.col("end").isNull(), False).otherwise((rank < F.col("end")) | ((rank == F.col("end")) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False))))
    out = join_groups(rows, ends, "key", "n")
    planned = out.select("row", "tokens", "key", "weight", "times", (F.col("whole") + more.cast("long")).alias("copies"), "place")
    return planned, total * (z or 1.0) / (top or 1.0) ** (a - 1)


def position(epoch: Column, seed: int = SEED) -> Column:
    """Where in the mix, from 0 to 1, a row of ``plan`` is used in its ``epoch`` (from 0)."""
    block, inside = permuted(block_of(F.col("place")), F.col("key"), epoch, seed), F.pmod(F.xxhash64(F.lit(seed), epoch.cast("long"), "place"), F.lit(1 << 20)) / F.lit(1 << 20)
    return F.least((epoch + (block + inside) / F.lit(float(BLOCKS))) / F.col("times"), F.lit(1.0))


def _uses(planned: DataFrame) -> DataFrame:
    """A row for each use, with ``epoch`` and its ``position``."""
    return planned.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("position", position(F.col("epoch")))


def mixed_table(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """Per row: id, source, ``n_tokens``, ``weight`` (target share of its source), ``copies``, and ``positions``: where in the mix,
    from 0 to 1, each of its uses stands, by epoch.

    Null ids, sources and texts are allowed (a null text has no tokens); whole texts are counted, however long; rows that are
    equal are used alike; further columns are dropped, whatever their names; an empty table gives an empty table.
    """
    out, _ = plan(docs, F.col(id_col), F.col(source_col), F.col(text_col), F.struct(F.col(id_col).alias("i"), F.col(source_col).alias("s")), **kw)
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda e: position(e))
    return out.select(F.col("row.i").alias(id_col), F.col("row.s").alias(source_col), F.col("tokens").alias("n_tokens"), "weight", "copies", places.alias("positions"))


#: Tokens of a partition of the mix.
PARTITION_TOKENS = 1_500_000


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with as many copies of each row as the mix asks for, one at least, in the order of the mix: partitions follow each
    other by position, and rows within them. Columns are as they are, whatever their names.

    Nulls, long texts, equal rows and empty tables are as in ``mixed_table``; equal rows stand side by side.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    planned, budget = plan(docs, F.col(id_col), F.col(source_col), F.col(text_col), carried, **kw)
    parts = max(8, math.ceil(budget / PARTITION_TOKENS))
    uses = _uses(planned).withColumn("part", F.least(F.floor(F.col("position") * parts), F.lit(parts - 1)).cast("int"))
    return uses.repartitionById(parts, "part").sortWithinPartitions("part", "position", "place").select("row.*")
