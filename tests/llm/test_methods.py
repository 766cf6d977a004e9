"""The methods themselves against brute force, and rows that once were lost or clashed."""

import re
from collections import Counter

import numpy as np
import pytest

from thalweg.llm import html_text, mixing, neardup, quality, secret_scan, sharding

PARAGRAPH = "This is a paragraph of the article which is long enough to hold some text."


def neutral(page):
    page = re.sub(r"<(/?)(article|nav|aside|header|footer|section|form|main)\b[^>]*>", r"<\1div>", page)
    return re.sub(r'<([a-z]+) (?:class|id|role)="[^"]*"', r"<\1", page)


def test_ratios_select_the_region(monkeypatch):
    page = f'<html><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li><li><a href="/c">three</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>A heading</h1><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p></article><footer>The footer.</footer></body></html>'
    want = f"A heading\n{PARAGRAPH}\nShort.\n{PARAGRAPH}"
    assert html_text.extract(page) == html_text.extract(neutral(page)) == want
    monkeypatch.setattr(html_text, "ratio", lambda line: 1.0)
    assert html_text.extract(neutral(page)) != want


def test_words_of_furniture_in_other_company():
    inner = f"<p>{PARAGRAPH}</p><section id='related-work'><p>one</p></section><p id='login'>two</p><div class='header'>three</div><div class='comments'><p>no</p></div>"
    page = f"<article><h1>T</h1>{inner}</article><div class='site-header'>no</div><div class='share-buttons'>no</div><div class='related-posts'>no</div>"
    assert html_text.extract(page) == f"T\n{PARAGRAPH}\none\ntwo\nthree"


def test_expectation_maximisation(spark):
    rng = np.random.default_rng(4)
    seen = Counter()
    for _ in range(3000):
        kind = rng.choice(3, p=[0.85, 0.1, 0.05])
        bad = np.full(quality.RULES, 0.02)
        if kind:
            bad[[[0, 5, 6], [3, 7]][kind - 1]] = 0.9
        seen[tuple(int(x) for x in np.where(rng.random(quality.RULES) < 0.3, 0, np.where(rng.random(quality.RULES) < bad, -1, 1)))] += 1
    got = {tuple(r["v"]): r["posterior"] for r in quality.learn(spark.createDataFrame([(list(v), n) for v, n in seen.items()], "v array<int>, n long")).collect()}
    v, n = np.array(list(seen)), np.array(list(seen.values()), dtype=float)
    voted, bad, r = (v != 0) * 1.0, (v < 0) * 1.0, quality.RULES
    share0 = np.array([quality.GOOD_SHARE] + [(1 - quality.GOOD_SHARE) / r] * r)
    rate0 = np.full((r + 1, r), quality.OTHER)
    rate0[0] = quality.ERROR
    rate0[np.arange(1, r + 1), np.arange(r)] = quality.OWN
    share, rate, weight = share0, rate0, quality.WEIGHT * n.sum()

    def classes():
        q = np.exp(np.log(share) + bad @ np.log(rate.T) + (voted - bad) @ np.log1p(-rate.T))
        return q / q.sum(axis=1, keepdims=True)

    start = classes()[:, 0]
    for _ in range(quality.ITERATIONS):
        c = n[:, None] * classes()
        rate = (c.T @ bad + weight * share0[:, None] * rate0) / (c.T @ voted + weight * share0[:, None])
        share = (c.sum(axis=0) + weight * share0) / (n.sum() + weight)
    want = classes()[:, 0]
    assert np.allclose([got[tuple(x)] for x in v.tolist()], want, atol=1e-9)
    assert n[(want >= 0.5) != (start >= 0.5)].sum() > 20  # what is learnt decides


def test_one_row_of_each_component_stays(spark):
    b, z = "one text that is here twice with some words", "quite another one without any word in common"
    rows = [(0, b, 1, "x"), (1, b, 2, "y"), (1, z, 3, "z"), (None, "a third text which has no id at all", 4, None), (None, "a third text which has no id at all", 5, None), (5, z, 6, "w"), (5, z, 6, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, root string")
    got = neardup.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(0, b, 1, "x"), (1, z, 3, "z"), (None, rows[3][1], 4, None)], key=str)
    assert neardup.drop_near_duplicates(df.where("false")).isEmpty()


@pytest.mark.parametrize("distance", [1, 4, 5])
def test_links_by_distance(spark, distance):
    rng = np.random.default_rng(distance)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    near = [f ^ int(np.bitwise_or.reduce(np.int64(1) << rng.choice(63, distance, replace=False).astype(np.int64))) for f in fps]
    df = spark.createDataFrame([(x,) for x in fps + near], "fp long")
    got = {tuple(sorted(r)) for r in neardup.links(df).collect()}
    assert got == ({tuple(sorted(x)) for x in zip(fps, near, strict=True)} if distance <= 4 else set())


def test_mix_keeps_columns_and_shares(spark):
    names = "n weight whole left end last key row times place".split()
    rows = [(i, "w " * (4 + i % 5), "big" if i % 4 else f"s{i % 3}", *range(len(names))) for i in range(1200)] + [(5000, "same text", "equal", *range(len(names)))] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    uses = {r["doc_id"]: r for r in mixing.mixed_table(df).collect()}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    out = mixed.collect()
    seen = Counter(r["doc_id"] for r in out if r["source"] != "equal")
    assert all(seen[i] == r["copies"] == len(r["positions"]) for i, r in uses.items() if r["source"] != "equal") and max(seen.values()) == 2
    # the order is that of the positions
    epoch, places = Counter(), []
    for r in out:
        if r["source"] != "equal":
            places.append(uses[r["doc_id"]]["positions"][epoch[r["doc_id"]]])
            epoch[r["doc_id"]] += 1
    assert places == sorted(places)
    tokens = Counter()
    for r in out[: len(out) // 2]:
        tokens[r["source"]] += len(r["text"].split())
    assert abs(tokens["big"] / tokens.total() - uses[1]["weight"]) < 0.06


def test_exponent_by_bisection(spark):
    p = np.array([0.7, 0.2, 0.06, 0.04])
    shares = spark.createDataFrame([(float(x),) for x in p], "p double")
    grid = np.linspace(0, 1, 20001)
    entropy = np.array([-(q := p**a / (p**a).sum()) @ np.log(q) for a in grid])
    assert abs(mixing.exponent(shares, 0.95, 100.0) - grid[entropy >= 0.95 * np.log(4)].max()) < 1e-4
    assert abs(mixing.exponent(shares, 0.95, 2.0) - grid[(0.7 / 0.04) ** (1 - grid) <= 2].min()) < 1e-4


def test_sharding_repeats_in_other_partitions(spark):
    df = spark.createDataFrame([(i, f"text {i} " * (1 + i % 9)) for i in range(600)], "doc_id long, text string")
    one, two = (sorted(map(tuple, sharding.shard_table(df.repartition(k), bucket_bytes=1024).collect())) for k in (2, 5))
    assert one == two
    crowd = spark.createDataFrame([(5, "x" * 50)] * 300, "doc_id long, text string")
    got = sharding.shard_table(crowd, bucket_bytes=1024).collect()
    assert sorted(r["slot"] for r in got) == list(range(300))


def test_redaction_of_long_texts(spark):
    rng = np.random.default_rng(3)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 30)) for _ in range(3000)]
    text = " é ".join(hexes)
    df = spark.createDataFrame([(1, text, 7), (2, "nothing", 7), (3, None, None)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in secret_scan.redact(df).collect()}
    want = " é ".join(["[SECRET]"] * len(hexes))
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want) and tuple(got[2])[1:] == ("nothing", 7) and got[3]["text"] is None


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = "the of and a to in is it that was for on with as are be this by from at".split()
    rng = np.random.default_rng(9)
    prose = [" ".join(rng.choice(words, 30)) + ". " + " ".join(rng.choice(words, 40)) + "." for _ in range(30)]
    texts = [*prose, prose[0], prose[1], *["junk ### " * 40] * 3, "", None, prose[2] + " password = hunter22secret"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert {30, 31, 32, 33, 34, 35, 36} & ids == set() and set(range(30)) <= ids
    for i in ids:
        pieces = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
        assert pieces[0][0] == 0 and {r["doc_tokens"] for r in got if r["doc_id"] == i} != set()
