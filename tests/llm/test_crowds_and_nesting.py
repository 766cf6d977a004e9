"""Crowded keys of fingerprints lose no link; pages nest deep, and their ratios, smoothing and cluster are recomputed."""

import math
import time

import numpy as np
import pytest

from thalweg.llm import fingerprints, html_text


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(7)
    rows = rng.integers(1, 16, (900, fingerprints.BINS), dtype=np.uint8)
    rows[:, fingerprints._bands()[0][1][: fingerprints.SAMPLED + fingerprints.NEXT]] = 5  # all meet in the first band, in one part
    for k in range(60):  # planted pairs of likeness 0.9
        rows[800 + k] = rows[k]
        at = rng.permutation(fingerprints.BINS)[: fingerprints.BINS // 10]
        free = ~np.isin(at, fingerprints._bands()[0][1][: fingerprints.SAMPLED + fingerprints.NEXT])
        rows[800 + k, at[free]] = 1 + rows[k, at[free]] % 15
    prints = [((r[0::2] << 4) | r[1::2]).tobytes() for r in rows]
    classes = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(prints)], "node long, fingerprint binary")
    want = {(i, j) for i in range(900) for j in np.flatnonzero(fingerprints.likeness(rows[i : i + 1], rows[i + 1 :]) >= 0.8) + i + 1}
    assert len(want) >= 60
    for limits in ({"crowd": 32, "whole": 100}, {"crowd": 32, "whole": 10_000}, {}):
        found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in fingerprints.near_pairs(classes, **limits).collect()}
        assert found == want  # pairs, so that what connects them is all of them


def apart(band):
    """A few bins that, beside those that ``band`` samples next, hold one at least of those that each further band samples first."""
    first = [set(b[1][: fingerprints.SAMPLED].tolist()) for b in fingerprints._bands()[: fingerprints.BANDS]]
    order = fingerprints._bands()[band][1].tolist()
    out = order[fingerprints.SAMPLED : fingerprints.SAMPLED + fingerprints.NEXT]
    rest = [b for k, b in enumerate(first) if k != band and not b & set(out)]
    while rest:
        best = max((x for x in range(fingerprints.BINS) if x not in first[band]), key=lambda x: sum(x in b for b in rest))
        out, rest = [*out, best], [b for b in rest if best not in b]
    return np.array(out)


def classes_of(spark, rows):
    prints = [((r[0::2] << 4) | r[1::2]).tobytes() for r in rows]
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(prints)], "node long, fingerprint binary")


def roots_of(n, pairs):
    root = list(range(n))
    for _ in range(n):
        last = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == last:
            return root


def test_pairs_that_meet_in_a_crowded_key_alone(spark):
    """Their next bins differ, and no other band brings them together."""
    rng = np.random.default_rng(11)
    other = apart(0)
    rows = rng.integers(1, 16, (460, fingerprints.BINS), dtype=np.uint8)
    rows[:, fingerprints._bands()[0][1][: fingerprints.SAMPLED]] = 5
    rows[400:] = rows[:60]
    rows[400:, other] = 1 + rows[400:, other] % 15
    want = {(i, j) for i in range(460) for j in np.flatnonzero(fingerprints.likeness(rows[i : i + 1], rows[i + 1 :]) >= 0.8) + i + 1}
    assert {(k, 400 + k) for k in range(60)} <= want
    for limits in ({"crowd": 32, "whole": 100}, {"crowd": 32, "whole": 1000}):
        found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in fingerprints.near_pairs(classes_of(spark, rows), **limits).collect()}
        assert found == want


def test_strays_of_a_large_class_in_a_crowded_key(spark):
    """Half of them are like one text of the class alone, which shares no other band with them."""
    rng = np.random.default_rng(12)
    key = fingerprints._bands()[0][1][: fingerprints.SAMPLED]
    other = apart(0)
    free = np.setdiff1d(np.arange(fingerprints.BINS), np.concatenate((key, other)))
    rows = np.repeat(rng.integers(1, 16, (1, fingerprints.BINS), dtype=np.uint8), 240, axis=0)
    for k in range(200):  # the class: about 40 bins between two of them
        at = rng.permutation(free)[:20]
        rows[k, at] = 1 + (rows[k, at] + rng.integers(0, 14, 20)) % 15
    for k in range(200, 240):
        rows[k] = rows[k - 200]
        at = np.concatenate((other, rng.permutation(free)[: 47 - len(other) + (k % 2) * 40]))
        rows[k, at] = 1 + (rows[k, at] + rng.integers(0, 14, len(at))) % 15
    like = [(i, j) for i in range(240) for j in np.flatnonzero(fingerprints.likeness(rows[i : i + 1], rows[i + 1 :]) >= 0.8) + i + 1]
    want = roots_of(240, like)
    assert want[:200] == [0] * 200 and 20 <= sum(want[k] == 0 for k in range(200, 240)) < 40
    found = [(r["a"], r["b"]) for r in fingerprints.near_pairs(classes_of(spark, rows), crowd=16, whole=50).collect()]
    assert {(min(p), max(p)) for p in found} <= set(like) and roots_of(240, found) == want


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.8, 0.95])
def test_links_connect_what_all_do(threshold):
    rng = np.random.default_rng(13)
    rows = rng.integers(0, 16, (40, fingerprints.BINS), dtype=np.uint8)[rng.integers(0, 40, 300)]
    rows[rng.random(rows.shape) < rng.choice([0, 0.05, 0.1, 0.3], (300, 1))] = 3
    rows[:100, 20:] = 0  # short ones
    roots, sides = rng.integers(0, 150, 300), rng.integers(0, 2, 300)
    like = np.stack([fingerprints.likeness(r[None], rows) for r in rows]) >= threshold
    own = [(min(np.flatnonzero(roots == r)), k) for k, r in enumerate(roots)]
    all_of = [(a, b) for a, b in zip(*np.nonzero(like), strict=True) if a < b]
    across = [(a, b) for a, b in all_of if sides[a] != sides[b]]
    assert roots_of(300, [x[:2] for x in fingerprints.linked(rows, threshold)]) == roots_of(300, all_of)
    for pairs, s in ((all_of, None), (across, sides)):
        got = [x[:2] for x in fingerprints.linked(rows, threshold, roots, s)]
        assert {(min(p), max(p)) for p in got} <= set(pairs) and roots_of(300, [*got, *own]) == roots_of(300, [*pairs, *own])


@pytest.mark.parametrize("page", ["<div>" * 100_000, "<ul><li>x" * 30_000, "<div>words of text " * 30_000, "<p><table><td>x" * 15_000, "<div>" * 30_000 + "</p></b></zz>" * 30_000])
def test_deep_nesting_is_linear(page):
    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 10


def brute_lines(page):
    """Texts of blocks of a page of plain divs and ps, and the tags met since the one before."""
    out, tags, text, k = [], 0, "", 0
    while k <= len(page):
        if k == len(page) or page[k] == "<":
            tags += 1  # the tag that ends a block is one of its own
            if text.strip():
                out.append((" ".join(text.split()), tags))
                tags = 0
            text = ""
            k = page.find(">", k) + 1 if k < len(page) else k + 1
        else:
            text += page[k]
            k += 1
    return out


def test_ratios_smoothing_and_cluster():
    prose = "Several words of running prose that make up the body of the text here. "
    page = "<div><div>" + "".join(f"<div><div><p>link {k}</p></div></div>" for k in range(6)) + "</div><div>" + "".join(f"<p>{prose * 3}{k}</p>" for k in range(5)) + "</div><div>" + "".join(f"<div><div><p>foot {k}</p></div></div>" for k in range(6)) + "</div></div>"
    events = html_text.Events()
    events.feed(page)
    lines = events.finish()
    assert [(x.text, x.tags) for x in lines] == brute_lines(page)
    own = [len(t) / max(1, n) for t, n in brute_lines(page)]
    assert [html_text.ratio(x) for x in lines] == own
    kernel = {k: math.exp(-(k**2) / 2) for k in range(-2, 3)}
    want = [sum(kernel[j - i] * own[j] for j in range(max(0, i - 2), min(len(own), i + 3))) / sum(kernel[j - i] for j in range(max(0, i - 2), min(len(own), i + 3))) for i in range(len(own))]
    assert html_text.smoothed(own) == pytest.approx(want)
    spread = math.sqrt(sum((x - sum(want) / len(want)) ** 2 for x in want) / len(want))
    inside = [t for (t, _), x in zip(brute_lines(page), want, strict=True) if x >= spread]
    got = html_text.extract(page).split("\n")
    assert got == [t for t, _ in brute_lines(page) if t.startswith("Several")] and set(got) <= set(inside)


def test_pages_with_nulls_repeats_and_clashing_columns(spark):
    page = "<html><body><nav>menu</nav><p>Text &amp; more</p><p>Last   one</p></body></html>"
    rows = [(1, "u", page, "x", 9), (1, "u", page, "x", 9), (None, None, None, None, None), (2, "v", "", "x", 9), (3, "w", "plain words", "x", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract_main_text(pages).collect())
    assert got == [("1", "Text & more\nLast one", 20)] * 2 + [("2", "", 0), ("3", "plain words", 11), ("None", "", 0)]
    assert html_text.extract_main_text(pages.where("false")).isEmpty()


def brute_differencing(sizes, k):
    """Sums of Karmarkar-Karp's partition, by lists: the two greatest imbalances are merged in opposite order until one is left."""
    from thalweg.llm import packing  # noqa: F401

    sizes = sorted(sizes, reverse=True)
    rows = [sizes[a : a + k] + [0] * (k - len(sizes[a : a + k])) for a in range(0, len(sizes), k)]
    state = [(max(r) - min(r), -i, r) for i, r in enumerate(rows)]
    made = len(rows)
    while len(state) > 1:
        state.sort(key=lambda x: (x[0], x[1]))
        one, two = state.pop(), state.pop()
        merged = sorted((a + b for a, b in zip(one[2], reversed(two[2]), strict=True)), reverse=True)
        state.append((merged[0] - merged[-1], -made, merged))
        made += 1
    return sorted(state[0][2])


@pytest.mark.parametrize("seed", range(6))
def test_differencing_decides(seed):
    from thalweg.llm import packing

    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 513, rng.integers(1, 400)).tolist()
    for k in (1, 2, 7, 40):
        assert sorted(sum(sizes[i] for i in w) for w in packing.differencing(sizes, k)) == brute_differencing(sizes, k)
    windows = packing.whole_windows(sizes)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) <= packing.CAPACITY
    least = -(-sum(sizes) // packing.CAPACITY)
    assert all(max(brute_differencing(sizes, k)) > packing.CAPACITY for k in range(least, len(windows)))


def test_the_count_rises():
    from thalweg.llm import packing

    assert len(packing.whole_windows([400] * 5)) == 3 and len(packing.whole_windows([500, 500, 500, 500, 48])) == 3
    assert packing.whole_windows([5]) == [[0]]


def test_small_parts_stay_whole(spark):
    from tokenizers import Tokenizer

    from thalweg.llm import packing, tokens

    library = Tokenizer.from_file(tokens.default_vocabulary())
    rng = np.random.default_rng(2)
    texts = [" ".join("word text of some more things".split()[i] for i in rng.integers(0, 6, rng.integers(20, 480))) for _ in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs).collect()
    n = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert sum(p["length"] for p in pieces) == sum(n.values())
    sequences = len({p["sequence_id"] for p in pieces})
    assert len(pieces) < len(texts) + 0.35 * sequences  # plain cutting gives a piece more for each sequence
    filled = sum(n.values()) / packing.CAPACITY
    assert sequences < 1.03 * filled + 12
