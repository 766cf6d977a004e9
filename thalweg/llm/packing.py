"""Packing documents into sequences of a fixed length by Karmarkar-Karp multiway differencing.

A document's ids, with an end id, are cut into whole sequences; what is left of it is a part. Parts of up to half a sequence are gathered
until they fill SMALL sequences, and are divided whole: each part begins as a partition of its own, and the two partitions with the
greatest imbalances are merged with the sequences of one in opposite order to the other's, until one is left, whose sequences are
nearly equal. Where one is over the capacity, the number of sequences rises by one and the differencing starts again. So these parts
are not cut, for a little padding.

Larger parts are too few to a sequence for sums to come out equal. They are gathered until they fill GROUP sequences, where the last
one is cut, and divided by the same differencing; what is over the capacity of a sequence is cut off and fills those that are short.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from thalweg.llm.tokens import default_vocabulary, vocabulary

CAPACITY, END = 1024, 0
#: Sequences that parts are gathered for: those that are cut, and those that stay whole.
GROUP, SMALL = 128, 64
#: Sequence ids: the partition's number, shifted by so many bits, and a counter.
SHIFT = 40


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` lists of indices into ``sizes`` with nearly equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    # A partition: sums in descending order, less the least of them, and beside each sum the chain of its members.
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    heap, made = [], 0
    for a in range(0, len(order), k):  # the first merges only set single parts side by side: k of them at a time
        row = order[a : a + k]
        sums = np.zeros(k, dtype=np.int64)
        sums[: len(row)] = [sizes[i] for i in row]
        sums -= sums[-1]
        chains: list = [(i, None, None) for i in row] + [None] * (k - len(row))
        heap.append((-int(sums[0]), made, sums, chains))
        made += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, s, c = heapq.heappop(heap)
        _, _, t, d = heapq.heappop(heap)
        sums = s + t[::-1]
        by = np.argsort(-sums, kind="stable")
        sums = sums[by]
        chains = [(None, c[i], d[k - 1 - i]) if c[i] and d[k - 1 - i] else c[i] or d[k - 1 - i] for i in by.tolist()]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), made, sums, chains))
        made += 1
    out = []
    for chain in heap[0][3]:
        members, todo = [], [chain]
        while todo:
            x = todo.pop()
            if x is not None:
                if x[0] is not None:
                    members.append(x[0])
                todo += [y for y in x[1:] if y is not None]
        out.append(members)
    return out


def whole_windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Lists of indices into ``sizes`` (each at most the capacity) whose sums are nearly equal and none over the capacity: as few as
    differencing finds, from the least that can hold them on."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [sorted(w) for w in windows if w]
        k += 1


def divide(sizes: list[int], capacity: int = CAPACITY, k: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (index into ``sizes``, start, length), none over the capacity; each size is at most the capacity, and ``k``
    sequences (the least by default) can hold them all."""
    k = k or max(1, -(-sum(sizes) // capacity))
    windows, over = [], []
    for members in differencing(sizes, k):
        window = [(i, 0, sizes[i]) for i in sorted(members, key=lambda i: (sizes[i], i))]
        surplus = sum(n for _, _, n in window) - capacity
        while surplus > 0:  # the tail of the largest
            i, _, n = window.pop()
            if n > surplus:
                window.append((i, 0, n - surplus))
            over.append((i, max(0, n - surplus), min(n, surplus)))
            surplus -= n
        windows.append(window)
    short = sorted(((capacity - sum(n for _, _, n in w), at) for at, w in enumerate(windows)), reverse=True)
    over.sort(key=lambda x: (-x[2], x[0]))
    room, at = 0, -1
    for i, start, n in over:
        while n:
            if not room:
                at += 1
                room = short[at][0]
            size = min(n, room)
            windows[short[at][1]].append((i, start, size))
            start, n, room = start + size, n - size, room - size
    return [w for w in windows if w]


def pack(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A null or empty text is its end id alone; a long one is cut into many sequences. Repeated rows are packed as documents of
    their own; null ids pass; further columns are dropped, whatever their names; an empty table gives an empty table. Texts are
    packed where they are read, without a shuffle. Sequences of parts that stay whole are padded (to the capacity); others are full, but for
    the last group of each partition, which takes what parts are left over: a sequence needs no padding where its length is a power of
    two, so that group's last tokens are cut into such lengths.
    """
    path = path or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        v = vocabulary(path)
        first = TaskContext.get().partitionId() << SHIFT
        made = 0
        parts: list[tuple] = []  # id, start, ids as bytes, tokens of the document
        held = 0
        small: list[tuple] = []  # parts that stay whole
        less = 0
        end = np.array([END], dtype="<u4").tobytes()
        id_type = None

        def emit(windows):
            nonlocal made
            out = [[] for _ in names]
            for window in windows:
                offset = 0
                for doc, start, ids, n in window:
                    for o, x in zip(out, (doc, start, len(ids) // 4, zlib.crc32(ids), n, first + made, offset), strict=True):
                        o.append(x)
                    offset += len(ids) // 4
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(out[0], id_type), *[pa.array(o, pa.int64()) for o in out[1:]]], names)

        def grouped(rows, k=None):
            cut = lambda r, start, n: (r[0], r[1] + start, r[2][4 * start : 4 * (start + n)], r[3])
            return [[cut(rows[i], start, n) for i, start, n in w] for w in divide([len(r[2]) // 4 for r in rows], capacity, k)]

        def settle(rows):
            """The last group: as many full sequences as its tokens give; the rest in sequences of powers of two."""
            sizes = [len(r[2]) // 4 for r in rows]
            spare = sum(sizes) % capacity
            rest, keep = [], list(rows)
            while spare and keep:
                doc, start, ids, n = keep.pop()
                size = min(spare, len(ids) // 4)
                if size < len(ids) // 4:
                    keep.append((doc, start, ids[: -4 * size], n))
                rest.append((doc, start + len(ids) // 4 - size, ids[len(ids) - 4 * size :], n))
                spare -= size
            windows = grouped(keep) if keep else []
            length = sum(len(r[2]) // 4 for r in rest)
            for bit in [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if length & (1 << b)]:
                window, room = [], bit
                while room:
                    doc, start, ids, n = rest.pop()
                    size = min(room, len(ids) // 4)
                    window.append((doc, start, ids[: 4 * size], n))
                    if size < len(ids) // 4:
                        rest.append((doc, start + size, ids[4 * size :], n))
                    room -= size
                windows.append(window)
            return windows

        for batch in batches:
            id_type = batch.column(0).type
            whole = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = v.id_bytes(text or "") + end
                n = len(ids) // 4
                full = n // capacity * capacity
                whole += [[(doc, a, ids[4 * a : 4 * (a + capacity)], n)] for a in range(0, full, capacity)]
                if 0 < n - full <= capacity // 2:
                    small.append((doc, full, ids[4 * full :], n))
                    less += n - full
                    if less >= SMALL * capacity:
                        whole += [[small[i] for i in w] for w in whole_windows([len(r[2]) // 4 for r in small], capacity)]
                        small, less = [], 0
                elif full < n:
                    parts.append((doc, full, ids[4 * full :], n))
                    held += n - full
                if held >= GROUP * capacity:
                    last, spare = parts.pop(), held - GROUP * capacity
                    kept = len(last[2]) - 4 * spare
                    whole += grouped([*parts, (last[0], last[1], last[2][:kept], n)], GROUP)
                    parts, held = [(last[0], last[1] + kept // 4, last[2][kept:], n)] if spare else [], spare
                if len(whole) > 4096:
                    yield emit(whole)
                    whole = []
            if whole:
                yield emit(whole)
        if parts or small:
            yield emit(settle([*parts, *small]))

    out = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
