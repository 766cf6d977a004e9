"""The Merkle manifest, line dedup and hard negatives against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thalweg.llm import hard_negatives, line_dedup, merkle

LONG = "This Line is long enough to be looked at, as it has over forty letters"
OTHER = "another line that is certainly longer than forty code points, été ça"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "\n".join([LONG.upper() if i % 2 else f" \t{LONG} ", f"own {i}", *([OTHER] if i % 3 == 0 else []), "short"]), "en", ("a", "b", None, "é")[i % 4], i, 1, "x", 0) for i in range(40)]
    rows += [(100, None, None, None, None, 1, "x", 0), (101, "", "", "", 0, 1, "x", 0), (None, LONG, "en", "a", 1, 1, "x", 0), (None, LONG, "en", "a", 1, 1, "x", 0)]
    rows += [(102, "\n".join([LONG] * 3 + ["\n"] + [f"w{k} " * 20 for k in range(3000)]), "en", "lone", 9, 1, "x", 0), (7, rows[7][1], "en", rows[7][3], 7, 1, "x", 0), (103, LONG[:39], "de", "a", 2, 1, "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, h string, drop int").repartition(3).cache()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 244, 729])
def test_traversal_steps_along_brute_siblings(n):
    leaves = [sha(str(i)).encode() for i in range(n)]
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.digest(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    for i, siblings in enumerate(merkle.traverse(leaves, len(levels) - 1)):
        at = i
        for level, got in zip(levels, siblings, strict=False):
            run = at // 3 * 3
            assert got == [level[k] for k in range(run, min(run + 3, len(level))) if k != at]
            at //= 3
        assert merkle.fold(leaves[i], siblings, i) == levels[-1][0]


def brute_manifest(rows):
    def leaf(r, text):
        values = [None if v is None else str(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)]
        return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])

    def proofs(level):
        out, width = [[] for _ in level], 1
        while len(level) > 1:
            for i, proof in enumerate(out):
                at = i // width
                proof.append((at % 3, [x for k, x in enumerate(level) if k // 3 == at // 3 and k != at]))
            level, width = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)], width * 3
        return level[0], out

    trees = defaultdict(list)
    for r in rows:
        trees[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    solved = {s: proofs([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    root, above = proofs([solved[s][0] for s in names])
    out = []
    for s, over in zip(names, above, strict=True):
        for (_, _, own, r), inner in zip(sorted(trees[s], key=lambda x: x[:3]), solved[s][1], strict=True):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for at, siblings in inner + over:
                node = sha(*siblings[:at], node, *siblings[at:])
            proof = sha(*[x for _, siblings in inner + over for x in siblings])
            out.append((str(r["doc_id"]), own, solved[s][0], root, proof, node, node == root))
    return sorted(out)


@pytest.mark.parametrize("levels", [1, 6])
def test_manifest(docs, levels):
    got = merkle.document_manifest(docs, proofs=True, levels=levels).collect()
    plain = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got)
    assert plain == brute_manifest(docs.collect())
    for r in got:
        assert merkle.verify(r["leaf"].encode(), r["proof"], r["pos"], r["nodes"], r["tree_pos"], r["trees"]).decode() == r["root"]


def test_empty_tables(spark, docs):
    assert merkle.document_manifest(docs.where("false")).isEmpty() and line_dedup.line_report(docs.where("false")).isEmpty()
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.embedding_negatives(none).isEmpty()


def brute_lines(rows, least=40, many=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: -1 if i is None else i
    holders = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(rank(r["doc_id"]))
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < many or rank(r["doc_id"]) == max(holders[key(x)])]
        out.append((rank(r["doc_id"]), len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"min_docs": 2, "batches": 7}, {"min_chars": 5, "batches": 1}])
def test_lines(docs, limits):
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3]) for r in line_dedup.line_report(docs, **limits).collect())
    assert got == brute_lines(docs.collect(), limits.get("min_chars", 40), limits.get("min_docs", 5))
    rows = line_dedup.drop_repeated_lines(docs, **limits)
    assert rows.columns == docs.columns and rows.count() == docs.count()
    assert sorted(sha(r["text"] or "") for r in rows.collect()) == sorted(x[3] for x in got)


def test_runs_are_compacted_and_prune(spark):
    runs = line_dedup.LineRuns(spark)
    for k in range(5):
        runs.add(spark.range(100).selectExpr("id as h", "0L as g", f"if(id < 50, 5L, 1L) as n", f"{10 - k}L as top"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {r["h"]: (r["n"], r["top"]) for r in runs.compacted().collect()}
    assert got == {h: (5, 10) if h < 50 else (5, 10) for h in range(100)}
    assert runs.levels[0][0].count() == 50  # the rest were settled by then


def brute_negatives(rows, every=100):
    own = {}
    for r in rows:
        v = r["embedding"]
        if r["label"] is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own[r["vec_id"]] = ((r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [int(np.floor(np.float64(x) * 256)) for x in v])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in own.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), b, m) for b, (m, w) in own.items() if b != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"block": 40, "chunk": 2}])
def test_negatives(spark, limits):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.25, 0.1, 0.25, 0.5]) for _ in range(6)], rng.choice([1, 1, 2, 3])) for i in range(600)]
    rows += [(600 + i, [0.25] * 6, 1) for i in range(150)]  # copies: ties by id
    rows += [(1000, None, 1), (1100, [0.5, None, 0.1, 0.1, 0.1, 0.1], 1), (1200, [float("nan")] * 6, 1), (1300, [float("inf")] * 6, 1), (1400, [0.3] * 6, None), (1500, [0.3] * 3, 2), (1600, [], 3), (1700, [-0.4] * 6, 9)]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, id string, pile int").repartition(3)
    want = brute_negatives(table.collect())
    assert sorted(map(tuple, hard_negatives.embedding_negatives(table, **limits).collect())) == want and len(want) > 50
    twice = table.unionByName(table)
    assert sorted(map(tuple, hard_negatives.embedding_negatives(twice, **limits).collect())) == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 4), st.integers(1, 6))
def test_tree_search_is_exact_and_prunes(seed, n, dims, k):
    rng = np.random.default_rng(seed)
    vectors, ids = rng.integers(-20, 20, (n, dims)), rng.permutation(n).astype(np.int64)
    tree = hard_negatives.BallTree(vectors, 4)
    anchors = rng.integers(-20, 20, (3, dims))
    of, low, high = np.array([0, 1, 1, 2]), np.array([-(10**6), 0, 50, -30]), np.array([10**6, 200, 10**6, 30])
    best, who, scored = hard_negatives.first_k(tree, ids, anchors, np.array([-1, 0, -1]), of, low, high, k)
    for w in range(4):
        all_ = sorted((-int(s), int(i)) for s, i in zip(vectors @ anchors[of[w]], ids, strict=True) if low[w] <= s <= high[w] and i != [-1, 0, -1][of[w]])[:k]
        assert [(-int(s), int(i)) for s, i in zip(best[w], who[w], strict=True) if s > hard_negatives.NONE] == all_


def test_clusters_are_pruned():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (50, 8))
    vectors = centres.repeat(100, axis=0) + rng.integers(-10, 10, (5000, 8))
    anchors = vectors[::500].copy()
    tree = hard_negatives.BallTree(vectors)
    of = np.arange(10)
    *_, scored = hard_negatives.first_k(tree, np.arange(5000), anchors, np.full(10, -1), of, np.full(10, -(10**9)), np.full(10, 10**9), 5)
    assert scored < 10 * 5000 / 4
