"""Hard negatives for contrastive training: for each anchor and each of its nearest rows of the same label (positives), the best rows of
other labels whose score lies in a window below the positive's.

Rows are dealt into blocks of bounded size by label, and each block becomes a ball tree of its own: a row of the table of trees. Anchors
come in chunks of bounded size. Each pair of a chunk and a block is one search, so that tasks hold one tree and one chunk at a
time, whatever the input. A node's ball bounds the scores of all rows in it from above and from below: nodes outside an
anchor's window are left out, and so are nodes whose upper bound is strictly beneath the k-th score found so far. The searches' first k
are ranked per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.common import materialise

#: Rows of a block and of a leaf of its tree; anchors of a chunk.
BLOCK, LEAF, CHUNK = 8192, 64, 8192
SEED = 20250119
#: The score and the id of a place among the first k that nothing has taken.
NONE = -np.iinfo(np.int64).max
LAST = np.iinfo(np.int64).max


class BallTree:
    """A ball tree over integer vectors: nodes in preorder, each with a centre, a radius, its rows and the node after it."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        centre, radius, start, end, after, split = [], [], [], [], [], []
        real = vectors.astype(np.float64)

        def build(a: int, b: int) -> None:
            node, rows = len(start), self.order[a:b]
            mid = real[rows].mean(axis=0)
            far = np.sqrt(((real[rows] - mid) ** 2).sum(axis=1))
            centre.append(mid), radius.append(far.max() * (1 + 1e-9) + 1e-6), start.append(a), end.append(b), after.append(0), split.append(b - a > leaf)
            if b - a > leaf:
                one = real[rows[far.argmax()]]
                away = ((real[rows] - one) ** 2).sum(axis=1)
                axis = real[rows[away.argmax()]] - one
                half = (b - a) // 2
                self.order[a:b] = rows[np.argpartition(real[rows] @ axis, half)]
                build(a, a + half)
                build(a + half, b)
            after[node] = len(start)

        if len(vectors):
            build(0, len(vectors))
        self.centre, self.radius = np.array(centre).reshape(len(start), -1), np.array(radius)
        self.start, self.end, self.after, self.split = (np.array(x, dtype=np.int64) for x in (start, end, after, split))
        self.vectors, self.real = vectors[self.order], real[self.order]
        most = int(np.abs(vectors).max(initial=0))
        self.exact = vectors.shape[1] * most * most < 2**53  # then float products are exact

    def scores(self, a: int, b: int, queries: np.ndarray, real: np.ndarray, exact: bool) -> np.ndarray:
        """Of the queries (rows) with the rows from a to b."""
        return (real @ self.real[a:b].T).astype(np.int64) if exact and self.exact else queries @ self.vectors[a:b].T


def first_k(tree: BallTree, ids: np.ndarray, anchors: np.ndarray, anchor_ids: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each window (``of``: its anchor's place; from ``low`` to ``high``) the first ``k`` scores and ids of rows with another id
    than the anchor's, greater scores first, then smaller ids; and how many rows were scored for a window."""
    best, who = np.full((len(of), k), NONE), np.full((len(of), k), LAST)
    ids, real = ids[tree.order], anchors.astype(np.float64)
    norm = np.sqrt((real**2).sum(axis=1))
    dims = anchors.shape[1]
    exact = dims * int(np.abs(anchors).max(initial=0)) ** 2 < 2**53
    scored = 0

    def bounds(node: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid, spread = real[of[windows]] @ tree.centre[node], norm[of[windows]] * tree.radius[node]
        slack = 1e-9 * (np.abs(mid) + spread) + 1e-3
        return mid - spread - slack, mid + spread + slack

    def wanted(node: int, windows: np.ndarray) -> tuple[np.ndarray, float]:
        """The windows that a node may matter to, and how high it reaches for them."""
        under, over = bounds(node, windows)
        keep = (over >= low[windows]) & (under <= high[windows]) & (over >= best[windows, -1])
        return windows[keep], float(over[keep].sum())

    def visit(node: int, windows: np.ndarray) -> None:
        nonlocal scored
        if not tree.split[node]:
            a, b = tree.start[node], tree.end[node]
            group, back = np.unique(of[windows], return_inverse=True)
            s = tree.scores(a, b, anchors[group], real[group], exact)[back]
            scored += s.size
            s = np.where((s >= low[windows, None]) & (s <= high[windows, None]) & (ids[None, a:b] != anchor_ids[of[windows], None]), s, NONE)
            hit = s.max(axis=1) >= np.maximum(best[windows, -1], NONE + 1)
            windows, s = windows[hit], s[hit]
            if len(windows):
                every = np.concatenate([best[windows], s], axis=1)
                names = np.where(every == NONE, LAST, np.concatenate([who[windows], np.broadcast_to(ids[a:b], s.shape)], axis=1))
                rank = np.lexsort((names, -every), axis=1)[:, :k]
                best[windows], who[windows] = np.take_along_axis(every, rank, 1), np.take_along_axis(names, rank, 1)
            return
        one, two = node + 1, int(tree.after[node + 1])
        (x, up), (y, vp) = wanted(one, windows), wanted(two, windows)
        first, second = ((one, x), (two, y)) if up >= vp else ((two, y), (one, x))
        if len(first[1]):
            visit(*first)
        left, _ = wanted(second[0], second[1]) if len(second[1]) else (second[1], 0.0)
        if len(left):
            visit(second[0], left)

    if len(ids) and len(of):
        all_, _ = wanted(0, np.arange(len(of)))
        if len(all_):
            visit(0, all_)
    return best, who, scored


def usable(vectors: Column) -> Column:
    """Whether a vector and all its components are there, finite, and of a length whose scores fit a long."""
    whole = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(vectors, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") * 256, 2.0))
    return vectors.isNotNull() & F.coalesce(whole, F.lit(False)) & (square < float(2**62))


def quantised(vectors: Column) -> Column:
    """floor(256 * x) of every component."""
    return F.transform(vectors, lambda x: F.floor(x.cast("double") * 256).cast("int"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows; what a shorter one lacks is 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(sizes.max(initial=0))), dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _grown(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _piled(rows: DataFrame, per_pile: int, columns: list[str]) -> DataFrame:
    """``rows`` in piles of about ``per_pile`` of one label: label, pile, and ``rows``, their columns as an array of structs, in which
    rows that are equal in all of them are one."""
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / per_pile).cast("int").alias("piles"))
    salt = F.pmod(F.xxhash64(F.lit(SEED), "id", "v"), F.col("piles"))
    dealt = rows.join(F.broadcast(sizes) if _few(sizes) else sizes, "label").withColumn("pile", salt.cast("int"))
    return dealt.groupBy("label", "pile").agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("rows"))


def _few(sizes: DataFrame, most: int = 100_000) -> bool:
    """Whether labels are so few that their sizes may be sent to every task."""
    return len(sizes.limit(most + 1).collect()) <= most


def _search(pairs: DataFrame, k: int, kin: bool) -> DataFrame:
    """The first ``k`` of each window in each pair of a block and a chunk: anchor (number), window, found, score. ``kin`` says whether
    anchors ask for rows of their own label or of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key = None, None
        for batch in batches:
            block_keys = batch.column("block").to_pylist()
            for i, here in enumerate(block_keys):
                rows = batch.column("rows")[i].values
                if here != key:  # pairs come sorted by block
                    tree, key = BallTree(_matrix(rows.field("v"))), here
                ids = rows.field("id").to_numpy(zero_copy_only=False)
                chunk = batch.column("anchors")[i].values
                chunk = chunk.filter(pa.array((chunk.field("label").to_numpy(zero_copy_only=False) == batch.column("label")[i].as_py()) == kin))
                vectors = _matrix(chunk.field("v"))
                width = max(vectors.shape[1], tree.vectors.shape[1])
                if tree.vectors.shape[1] < width:
                    tree, key = BallTree(_grown(tree.vectors[np.argsort(tree.order)], width)), None
                windows = chunk.field("windows")
                counts = np.diff(windows.offsets.to_numpy())
                flat = windows.flatten()
                of = np.repeat(np.arange(len(chunk)), counts)
                low, high = flat.field("low").to_numpy(zero_copy_only=False), flat.field("high").to_numpy(zero_copy_only=False)
                best, who, _ = first_k(tree, ids, _grown(vectors, width), chunk.field("id").to_numpy(zero_copy_only=False), of, low, high, k)
                w, r = np.nonzero(best > NONE)
                anchor, window = chunk.field("anchor").take(pa.array(of[w])), flat.field("id").take(pa.array(w))
                yield pa.RecordBatch.from_arrays([anchor, window, pa.array(who[w, r]), pa.array(best[w, r])], ["anchor", "window", "found", "score"])

    return pairs.sortWithinPartitions("block").select("block", "label", "rows", "anchors").mapInArrow(run, "anchor long, window long, found long, score long")


def _pairs(blocks: DataFrame, chunks: DataFrame, kin: bool) -> DataFrame:
    """A row for each block and each chunk that is to search it, with both's rows: the anchors of a label are met by their label's
    blocks, or all anchors by all blocks (a fixed query set against all rows, in blocks). Keys meet first, without rows."""
    keys = blocks.select("label", "pile")
    if kin:
        met = keys.join(chunks.select(F.col("at").alias("label"), "at", "chunk"), "label")
    else:
        last = chunks.agg(F.max("chunk")).head()[0]
        met = keys.select("*", F.lit(0).cast("long").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(last or 0))).alias("chunk"))
    whole = met.repartition("label", "pile", "at", "chunk").join(blocks, ["label", "pile"]).join(chunks, ["at", "chunk"])
    return whole.select(F.struct("label", "pile").cast("string").alias("block"), "label", "rows", "anchors")


def _chunked(anchors: DataFrame, per_chunk: int, kin: bool) -> DataFrame:
    """Chunks of anchors: at (the label, or 0 for all), chunk, ``anchors``."""
    at = F.col("label") if kin else F.lit(0).cast("long")
    piles = _piled(anchors.withColumn("own", F.col("label")).withColumn("label", at), per_chunk, ["id", "anchor", "own", "v", "windows"])
    row = F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["anchor"].alias("anchor"), r["own"].alias("label"), r["v"].alias("v"), r["windows"].alias("windows")))
    return piles.select(F.col("label").alias("at"), F.col("pile").alias("chunk"), row.alias("anchors"))


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100), block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Of ``rows`` (id, label, v: integer components) and ``anchors`` (some of them): anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Scores are exact inner products; greater ones come first, and of equal ones the smaller id. An anchor's positives are the first
    ``positives`` rows of its label with another id. For each of them, the first ``negatives`` rows of other labels whose score lies
    between ``percent`` of the positive's (none does if that is negative). Vectors of different lengths: components that one lacks are 0.
    Rows that are equal in all columns count once; rows that share an id are rows of their own, and each an anchor of its own. A
    positive or anchor without negatives has no row. No rows give no rows.
    """
    low, high = percent
    blocks = materialise(_piled(rows.select("id", "label", "v"), block, ["id", "v"]), "blocks")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(NONE + 1).alias("low"), F.lit(LAST).alias("high")))
    marked = materialise(anchors.select("id", "label", "v").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    near = _ranked(_search(_pairs(blocks, _chunked(marked.withColumn("windows", all_), chunk, True), True), positives, True), ["anchor"], positives)
    near = materialise(near.select("anchor", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("long").alias("window")), "positives")
    # a window from the least whole score that is at least low % to the greatest that is at most high %
    at_least, at_most = -F.floor(F.col("positive_score").cast("decimal(38,0)") * -low / 100), F.floor(F.col("positive_score").cast("decimal(38,0)") * high / 100)
    windows = near.groupBy("anchor").agg(F.collect_list(F.struct(F.col("window").alias("id"), at_least.cast("long").alias("low"), at_most.cast("long").alias("high"))).alias("windows"))
    asked = materialise(marked.join(windows, "anchor"), "asked")
    far = _ranked(_search(_pairs(blocks, _chunked(asked, chunk, False), False), negatives, False), ["anchor", "window"], negatives)
    named = far.join(near, ["anchor", "window"]).join(marked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def embedding_negatives(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, shifted: int = 7, labels: int = 10, **limits: int) -> DataFrame:
    """``hard_negatives`` of a table of embeddings, for the anchors whose id ``every`` divides.

    Components become floor(256 * x). Rows with a null label or vector, or a null or non-finite component, take no part, nor do vectors
    so long (over 2 ** 23) that a score might not fit a long; rows with a null id are no anchors and, having no name to be returned by,
    take no part either. An empty vector scores 0. Where ``shifted`` divides the id, the label is first moved on by one (of ``labels``).
    Further columns aren't read, whatever their names; an empty table gives an empty table.
    """
    own = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    moved = F.when(F.col("id") % shifted == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = own.select("id", moved.alias("label"), quantised(F.col("v")).alias("v"))
    return hard_negatives(rows, rows.where(F.col("id") % every == 0), **limits)
