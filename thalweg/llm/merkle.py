"""Merkle manifest of a dataset: a digest for each row and each source, one for all, and a proof for every row.

Rows are leaves. The leaves of a tree (a source) ascend by id; while more than one node remains, every ARITY consecutive nodes become
their digest. The trees' roots, in the order of their names, are the leaves of one more tree.

A tree is dealt in aligned blocks of ARITY ** LEVELS leaves, so that a block is a whole subtree. A block's root takes one pass
of a treehash stack. The blocks' roots are leaves again, in rounds, until each tree has one node left. On the way back each block
gets the siblings above it once, and steps from leaf to leaf: the siblings of the first leaf are at hand, and for each level a
treehash stack builds those of the next run while the current one is passed, a few nodes per leaf, the stack with the lowest top first
(Merkle traversal scheduling). What a block holds beside its leaves is logarithmic, and what leaves it is of fixed size per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.common import materialise

ARITY = 3
#: Levels of a block: 729 leaves.
LEVELS = 6
#: What the leaves of documents are made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """Lower-case hex sha256 of the parts, which are hex themselves."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def widths(leaves: int) -> list[int]:
    """Nodes on each level of a tree, from its leaves to its root."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Treehash:
    """Builds the node ``index`` on ``level`` from its leaves, one at each step."""

    def __init__(self, leaves: list[bytes], level: int, index: int):
        self.leaves, self.level = leaves, level
        self.at, self.end = index * ARITY**level, min((index + 1) * ARITY**level, len(leaves))
        self.stack: list[tuple[int, list[bytes]]] = []  # ascending to the bottom: level, nodes of an unfinished run
        self.node: bytes | None = None

    def lowest(self) -> int:
        """The lowest level of what waits on the stack; its own while nothing does."""
        return self.stack[-1][0] if self.stack else self.level

    def step(self) -> None:
        node, level = self.leaves[self.at], 0
        self.at += 1
        last = self.at == self.end
        while level < self.level:
            if self.stack and self.stack[-1][0] == level:
                run = self.stack[-1][1]
                run.append(node)
            else:
                run = [node]
                self.stack.append((level, run))
            if len(run) < ARITY and not last:
                return
            self.stack.pop()
            node, level = digest(*run), level + 1
        if last:
            self.node = node

    def finish(self) -> bytes:
        while self.node is None:
            self.step()
        return self.node


def traverse(leaves: list[bytes], levels: int) -> Iterator[list[list[bytes]]]:
    """For one leaf after the other, its siblings on each of ``levels`` levels (those in its run, left to right)."""
    sizes = [len(leaves)]
    for _ in range(levels):
        sizes.append(-(-sizes[-1] // ARITY))
    left: list[list[bytes]] = [[] for _ in range(levels)]  # of the run on a level, what has been passed
    right = [[Treehash(leaves, h, i).finish() for i in range(1, min(ARITY, sizes[h]))] for h in range(levels)]  # and what comes
    queued: list[list[Treehash]] = [[] for _ in range(levels)]  # of the next run, what will be on the right

    def queue(h: int, run: int) -> None:
        first = run * ARITY
        queued[h] = [Treehash(leaves, h, i) for i in range(first + 1, min(first + ARITY, sizes[h]))]

    for h in range(1, levels):
        queue(h, 1)
    for at in range(len(leaves)):
        yield [left[h] + right[h] for h in range(levels)]
        for _ in range(levels - 1):  # at most so many steps of stacks are due for a leaf
            open_ = [t for q in queued for t in q if t.node is None]
            if not open_:
                break
            min(open_, key=lambda t: (t.lowest(), t.level)).step()
        node, upto = leaves[at], at + 1
        for h in range(levels):
            if upto % ARITY ** h or upto >= len(leaves):
                break
            done = upto // ARITY**h  # nodes passed on this level
            run = [*left[h], node]
            if done % ARITY:
                left[h], right[h] = run, right[h][1:]
                break
            node = digest(*run)
            left[h] = []
            if h:
                right[h] = [t.finish() for t in queued[h]]
                queue(h, done // ARITY + 1)
            else:
                right[h] = leaves[upto + 1 : upto + ARITY]


def fold(leaf: bytes, siblings: list[list[bytes]], at: int) -> bytes:
    """The root that ``leaf``, the ``at``-th of its tree, has with these siblings on the levels above it."""
    node = leaf
    for level in siblings:
        node = digest(*level[: at % ARITY], node, *level[at % ARITY :])
        at //= ARITY
    return node


def _unpacked(path: bytes, at: int, nodes: int) -> list[list[bytes]]:
    """Siblings of the ``at``-th of ``nodes`` leaves, level by level, from their concatenation."""
    out, p = [], 0
    for width in widths(nodes)[:-1]:
        n = min(ARITY, width - at // ARITY * ARITY) - 1
        out.append([path[p + 64 * k : p + 64 * k + 64] for k in range(n)])
        p, at = p + 64 * n, at // ARITY
    return out


def leaf_digest(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf of a row of documents: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" and text is not None else F.col(f"`{name}`")
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place among those with the same ``tree`` by ``order``, and ``nodes``, how many these are.

    Ranges of the sorted rows are written, so no task holds a tree; the ranges' parts of trees are counted and summed up."""
    keys = [k for k in ("tree", *order)]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranged")
    heads = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("nodes"))
    return ranged.join(heads, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(nodes: DataFrame, levels: int, *carried: str) -> DataFrame:
    """A row for each aligned block of ``nodes`` (tree, pos, nodes, digest): its leaves in order and what they carry."""
    row = F.struct("pos", "digest", *carried)
    return nodes.groupBy("tree", F.floor(F.col("pos") / ARITY**levels).alias("block"), "nodes").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _height(nodes: int, levels: int) -> int:
    """Levels that the blocks of a tree of ``nodes`` leaves have."""
    return min(levels, len(widths(nodes)) - 1)


def _roots(blocks: DataFrame, levels: int) -> DataFrame:
    """Each block's root, as a node (tree, pos, nodes, digest) of the round above."""

    def run(batches):
        for batch in batches:
            of = {c: batch.column(c).to_pylist() for c in ("tree", "block", "nodes", "leaves")}
            roots = [Treehash(leaves, _height(n, levels), 0).finish() for leaves, n in zip(of["leaves"], of["nodes"], strict=True)]
            above = [-(-n // ARITY**levels) for n in of["nodes"]]
            yield pa.RecordBatch.from_arrays([pa.array(of["tree"], pa.string()), pa.array(of["block"], pa.int64()), pa.array(above, pa.int64()), pa.array(roots, pa.binary())], ["tree", "pos", "nodes", "digest"])

    return blocks.select("tree", "block", "nodes", F.col("rows.digest").alias("leaves")).mapInArrow(run, "tree string, pos long, nodes long, digest binary")


def _paths(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Of every node: tree, pos and ``path``, its siblings up to its tree's root, from those of the blocks."""

    def run(batches):
        for batch in batches:
            for tree, nodes, rows, path in zip(*[batch.column(c).to_pylist() for c in ("tree", "nodes", "rows", "path")], strict=True):
                own = [b"".join(b"".join(level) for level in s) + path for s in traverse([r["digest"] for r in rows], _height(nodes, levels))]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(own), pa.string()), pa.array([r["pos"] for r in rows], pa.int64()), pa.array(own, pa.binary())], ["tree", "pos", "path"])

    return _with_path(blocks, above).mapInArrow(run, "tree string, pos long, path binary")


def _with_path(blocks: DataFrame, above: DataFrame) -> DataFrame:
    return blocks.join(above.select("tree", F.col("pos").alias("block"), "path"), ["tree", "block"])


def _climb(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """The roots (tree, digest) of the trees of ``nodes``, and the siblings (tree, pos, path) above each of the nodes.

    Each round has a block's worth of nodes fewer, until every tree has one."""
    rounds = []
    while True:
        nodes = materialise(nodes, "nodes")
        if nodes.where("nodes > 1").isEmpty():
            break
        rounds.append(materialise(_blocks(nodes, levels), "blocks"))
        nodes = _roots(rounds[-1], levels)
    paths = nodes.select("tree", "pos", F.lit(b"").alias("path"))
    for blocks in reversed(rounds):
        paths = materialise(_paths(blocks, paths, levels), "paths")
    return nodes.select("tree", "digest"), paths


def manifest(leaves: DataFrame, *, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """Of ``leaves`` (id, tree, leaf, presented): id, leaf, ``subroot``, ``root``, ``proof_sha256`` (of the siblings in the order of the
    proof), ``folded_root`` (what the presented leaf has as root with the siblings of the own one) and ``verified``; with
    ``proofs`` also the ``proof`` (the siblings), ``pos`` and ``nodes`` (the place in the tree and its size), ``tree_pos`` and ``trees``.

    Leaves of a tree ascend by id, then leaf; null ids come first. Trees are in the order of their names' bytes, the null tree first.
    Repeated rows are leaves of their own; equal ones may stand for each other. No rows give no rows.
    """
    name = F.coalesce(F.concat(F.lit("s"), F.col("tree").cast("string")), F.lit("n"))
    rows = leaves.select("id", name.alias("tree"), F.col("leaf").alias("digest"), "presented", F.monotonically_increasing_id().alias("salt"))
    blocks = materialise(_blocks(numbered(materialise(rows, "leaves"), ["id", "digest", "salt"]).withColumn("digest", F.col("digest").cast("binary")), levels, "id", "presented"), "blocks")
    subroots, inner = _climb(_roots(blocks, levels), levels)
    trees = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("subroot"))
    tops = materialise(numbered(trees, ["name"]), "subroots")
    root, outer = _climb(tops.select("tree", "pos", "nodes", F.col("subroot").alias("digest")), levels)
    per_tree = tops.join(outer, ["tree", "pos"]).join(root.select("tree", F.col("digest").alias("root")), "tree")
    per_tree = per_tree.select(F.col("name").alias("tree"), "subroot", "root", F.col("pos").alias("tree_pos"), F.col("nodes").alias("trees"), F.col("path").alias("outer"))
    work = _with_path(blocks, inner).join(per_tree, "tree")
    kind = leaves.schema["id"].dataType
    plain = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    shape = f"id {kind.simpleString()}, {', '.join(f'{c} string' for c in plain)}, verified boolean" + (", proof binary, pos long, nodes long, tree_pos long, trees long" if proofs else "")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                b = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "rows"}
                rows = batch.column("rows")[k].values
                ids, own = rows.field("id"), rows.field("digest").to_pylist()
                shown, at = rows.field("presented").to_pylist(), rows.field("pos").to_pylist()
                upper, outer = _unpacked(b["path"], b["block"], -(-b["nodes"] // ARITY**levels)), _unpacked(b["outer"], b["tree_pos"], b["trees"])
                shared, root = b["path"] + b["outer"], b["root"]
                out: dict[str, list] = {c: [] for c in ("proof_sha256", "folded_root", "proof")}
                for leaf, i, siblings in zip(shown, at, traverse(own, _height(b["nodes"], levels)), strict=True):
                    proof = b"".join(b"".join(level) for level in siblings) + shared
                    out["proof_sha256"].append(digest(proof))
                    out["folded_root"].append(fold(fold(fold(leaf.encode(), siblings, i), upper, b["block"]), outer, b["tree_pos"]))
                    if proofs:
                        out["proof"].append(proof)
                n, text = len(own), lambda x: pa.array([v.decode() for v in x], pa.string())
                columns = [ids, text(own), text([b["subroot"]] * n), text([root] * n), text(out["proof_sha256"]), text(out["folded_root"]), pa.array([v == root for v in out["folded_root"]])]
                if proofs:
                    columns += [pa.array(out["proof"], pa.binary()), pa.array(at), *[pa.array([b[c]] * n, pa.int64()) for c in ("nodes", "tree_pos", "trees")]]
                yield pa.RecordBatch.from_arrays(columns, ["id", *plain, "verified", *(["proof", "pos", "nodes", "tree_pos", "trees"] if proofs else [])])

    return work.mapInArrow(run, shape)


def verify(leaf: bytes, proof: bytes, pos: int, nodes: int, tree_pos: int, trees: int) -> bytes:
    """The root that a leaf has with a proof of ``manifest``."""
    inner = _unpacked(proof, pos, nodes)
    split = 64 * sum(map(len, inner))
    return fold(fold(leaf, inner, pos), _unpacked(proof[split:], tree_pos, trees), tree_pos)


def tampered_text() -> Column:
    """The text without ``\\n`` where the unsigned crc32 of the decimal id is even."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def document_manifest(docs: DataFrame, presented: Column | None = None, *, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """``manifest`` of the rows of ``docs`` (doc_id, source, lang, n_chars, text), a tree for each source.

    ``presented`` is the text that is held against the manifest, by default ``tampered_text()``; where it says the same as the text, the
    row verifies. Null fields count as such, also a null id (which is never tampered with and comes first in its source) and a
    null source; whole texts are read, however long, and empty ones differ from null. Repeated rows are leaves of their own; further
    columns are not read, whatever their names. An empty table gives an empty table.
    """
    text = tampered_text() if presented is None else presented
    own = docs.select(F.col("`doc_id`").alias("id"), F.col("`source`").alias("tree"), leaf_digest(docs).alias("leaf"), leaf_digest(docs, text).alias("presented"))
    return manifest(own, proofs=proofs, levels=levels).withColumnRenamed("id", "doc_id")
