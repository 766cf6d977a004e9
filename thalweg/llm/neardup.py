"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position has a non-zero label of RADIUS + 1 bits. For every non-zero vector v of that length a table masks
fingerprints to the positions whose label has an odd product with v. The labels of at most RADIUS differing positions
lie in a proper subspace, so some v is orthogonal to all of them, and in its table the two fingerprints have the same
key: every pair within the radius meets in some table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import join_groups, materialise, unsigned_hex

RADIUS = 4
SHINGLE = 4
#: Up to so many fingerprints under a key are compared with each other (at most 2016 pairs); larger ones go by probes.
SMALL = 64
SEED = 42


def table_masks(radius: int = RADIUS) -> list[int]:
    """The 2**(radius + 1) - 1 masks of 64 bits."""
    n = 1 << (radius + 1)
    labels = [1 + i % (n - 1) for i in range(64)]
    return [sum(1 << i for i, label in enumerate(labels) if (label & v).bit_count() % 2) for v in range(1, n)]


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: a bit is 1 if it is set in over half of the hashes of its shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)]
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``fp`` (a signed long) and the columns ``carried`` of every row, where it is read."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *carried)
    names = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]

    def run(batches):
        for batch in batches:
            fps = np.array([simhash(t) for t in batch.column(0).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps)], [*batch.schema.names[1:], "fp"])

    return rows.mapInArrow(run, ", ".join([*names, "fp long"])).withColumnRenamed("doc_id", id_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a < b`` that connect distinct fingerprints (column ``fp``) within the radius of each other.

    All such pairs that share a table key with at most SMALL fingerprints under it are edges. Fingerprints under larger
    keys send out probes: all values within radius // 2 of theirs, for every position. Two of them are within the
    radius if and only if they share a probe, so an edge from each to the smallest at each probe connects just what is
    connected, and the rows stay linear in the number of fingerprints.
    """
    if radius % 2:
        raise ValueError("the radius has to be even")
    masks = table_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "k"))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most")).where("n > 1")
    two = sizes.where("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b"))
    # a key may hold most of the fingerprints, so keys are joined as groups
    groups = materialise(sizes.where("n > 2").select(F.struct("t", "k").alias("tk"), "n"), "sizes")
    met = join_groups(keyed.select("fp", F.struct("t", "k").alias("tk")), groups, "tk", "n").where("n is not null")
    some = materialise(met.select("fp", "tk.t", "tk.k", "n"), "keys")
    few = some.where(F.col("n") <= SMALL)
    pairs = few.select("t", "k", F.col("fp").alias("a")).join(few.select("t", "k", F.col("fp").alias("b")), ["t", "k"]).where("a < b").select("a", "b")
    near = two.unionByName(pairs).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    crowd = some.where(F.col("n") > SMALL).select("fp").distinct()
    if crowd.isEmpty():
        return near.distinct()
    flips = [0] + [1 << i for i in range(64)]
    for _ in range(radius // 2 - 1):
        flips = sorted({f ^ (1 << i) for f in flips for i in range(64)} | set(flips))
    spark = fps.sparkSession
    flip = F.broadcast(spark.createDataFrame([(_signed(f),) for f in flips], "flip long"))  # 2081 rows for radius 4
    probes = crowd.join(flip).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("probe"))
    least = probes.groupBy("probe").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("probe", "a")
    star = probes.join(least, "probe").where("a < fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(star).distinct()


def _least_of(edges: DataFrame, key: str, value: str) -> DataFrame:
    """``edges`` with ``m``, the smallest ``value`` of their ``key``. A key may hold most of the edges."""
    low = edges.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n"))
    return join_groups(edges, materialise(low, "least"), key, "n").drop("n")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node of ``edges`` (a, b).

    Large-star and small-star steps by turns, until no edge changes; each step's edges are written to the shared folder.
    """
    edges = materialise(edges.where("a != b"), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    last = mark(edges)
    while last[0]:
        # large star: a node's larger neighbours go to its smallest neighbour, or itself
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        star = _least_of(both, "a", "b").where("b > a").select(F.least("m", "a").alias("v"), F.col("b").alias("u"))
        star = materialise(star.where("v < u").distinct(), "stars")
        # small star: a node and its smaller neighbours go to the smallest of these
        joined = _least_of(star, "u", "v")
        small = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(joined.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = materialise(small.where("a < b").distinct(), "edges")
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _linked(prints: DataFrame, id_col: str, radius: int) -> DataFrame:
    """One row per fingerprint: ``fp``, ``n`` rows, ``component_id``, ``root`` (the smallest fingerprint of its component)."""
    groups = materialise(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(id_col).alias("least")), "classes")
    roots = components(links(groups.select("fp"), radius))
    labelled = materialise(groups.join(roots, groups.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return materialise(join_groups(labelled, materialise(smallest, "components"), "root", "members").select("fp", "n", "component_id", "root"), "labels")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row its id, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable by links).

    Fingerprints link at ``radius`` or fewer differing bits. Null, empty and blank texts have fingerprint zero and are
    linked like any other; whole texts are read, however long. Null ids are allowed and never the smallest unless a component
    has no other; repeated rows are in one component. Further columns are dropped, whatever their names; an empty table gives
    an empty table.
    """
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col), "prints")
    labels = _linked(prints, id_col, radius)
    return join_groups(prints, labels, "fp", "n").select(id_col, unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _row_key(id_col: str, text_col: str) -> Column:
    """The same for rows of the same id and text only: the id and two hashes of the text."""
    text = F.col(f"`{text_col}`")
    return F.concat_ws("|", F.coalesce(F.concat(F.lit("v"), F.col(f"`{id_col}`").cast("string")), F.lit("n")), text.isNull().cast("string"), F.xxhash64(text).cast("string"), F.xxhash64(F.lit(SEED), text).cast("string"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, one of each component, with all their columns, whatever their names.

    That of the smallest id stays (null ids are last), of rows with that id the first by hashes of the text, and of rows equal
    in both the least of all columns. Null, empty and blank texts are one component. An empty table gives an empty table.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), _row_key(id_col, text_col).alias("key"))
    prints = materialise(fingerprints(rows, carried=("key",)), "prints")
    labels = _linked(prints, "doc_id", radius)
    found = join_groups(prints, labels, "fp", "n")
    equal = found.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    first = equal.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key", "n")).alias("x")).select("x.key", "x.n")
    first = materialise(first, "kept")
    whole = docs.select(_row_key(id_col, text_col).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = join_groups(whole, first, "key", "n").where("n is not null")
    if not first.where("n > 1").isEmpty():
        kept = kept.where("n = 1").select("row").unionByName(kept.where("n > 1").groupBy("key").agg(F.min("row").alias("row")).select("row"))
    return kept.select("row.*")
