"""Fingerprints of whole texts by a randomised edit embedding.

All texts are walked with the same random bits: at step j the symbol under the pointer is read and the pointer moves on if
the bit of (j, symbol) is set. Two walks that an edit drives apart soon meet again, so a small edit distance becomes a small
Hamming distance between the sequences of symbols read. The fingerprint samples that sequence: steps are dealt to BINS
bins, and of the steps a walk takes each bin keeps the one of the lowest priority, as a code of its symbol. Walks of like
length keep the same steps. Likeness is the share of bins that agree, less what chance gives.

Bands of sampled bins bring like fingerprints together; the links between them that verification finds make the classes.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import join_groups, materialise
from thalweg.llm.neardup import components

BINS = 256
#: Codes of a kept symbol; 0 is a bin without a step.
CODES = 15
SEED = 20240607
_PERIOD, _CHUNK = 8192, 65536
#: With fewer texts than this still walking, each is walked alone.
_FEW = 24


class Walk:
    """The shared randomness; the same in every process."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.moves = rng.integers(0, 2, size=(_PERIOD, 256), dtype=np.uint8)
        self.moves[:, 0] = 0  # the end of a text: the pointer stays
        self.codes = rng.integers(1, CODES + 1, size=(997, 256), dtype=np.uint8)
        self.move_rows = [r.tobytes() for r in self.moves]
        self.steps: list[int] = []  # at which a bin is written
        self.bins: list[int] = []
        self.least = np.full(BINS, np.inf)
        self.upto = 0

    def extend(self, steps: int) -> None:
        """Find, to so many steps at least, those whose priority is the lowest yet of their bin."""
        while self.upto < steps:
            rng = np.random.Generator(np.random.PCG64([SEED, self.upto // _CHUNK]))
            bins, priority = rng.integers(0, BINS, size=_CHUNK), rng.random(_CHUNK)
            found = []
            for b in range(BINS):
                at = np.flatnonzero(bins == b)
                low = np.minimum.accumulate(np.concatenate(([self.least[b]], priority[at])))
                found += [(int(k) + self.upto, b) for k in at[low[1:] < low[:-1]]]
                self.least[b] = low[-1]
            for k, b in sorted(found):
                self.steps.append(k)
                self.bins.append(b)
            self.upto += _CHUNK

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """A row of BINS codes for each text."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        out = np.zeros((len(texts), BINS), dtype=np.uint8)
        if not len(texts):
            return out
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        symbols = np.zeros(int(lengths.sum()) + len(texts), dtype=np.uint8)
        for t, s in zip(texts, starts.tolist(), strict=True):
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
            symbols[s : s + len(c)] = (c ^ (c >> 8) * 31) % 255 + 1
        live = np.argsort(-lengths, kind="stable")
        pointer = starts[live]
        j = mark = 0
        while True:
            if j % 64 == 0:
                walking = symbols[pointer] > 0
                if not walking.all():
                    live, pointer = live[walking], pointer[walking]
                if len(live) < _FEW:
                    break
                self.extend(j + 65)
            c = symbols.take(pointer)
            if self.steps[mark] == j:
                code = self.codes[j % 997].take(c)
                there = c > 0
                out[live[there], self.bins[mark]] = code[there]
                mark += 1
                self.extend(j + 2 * _CHUNK if mark == len(self.steps) else 0)
            pointer += self.moves[j % _PERIOD].take(c)
            j += 1
        for k, p in zip(live.tolist(), pointer.tolist(), strict=True):
            self._alone(symbols, p, j, mark, out[k])
        return out

    def _alone(self, symbols: np.ndarray, p: int, j: int, mark: int, row: np.ndarray) -> None:
        text = symbols[p : p + int(np.argmin(symbols[p:]) if len(symbols) - p < 4096 else self._end(symbols, p)) + 1].tobytes()
        p, rows = 0, self.move_rows
        while text[p]:
            while mark == len(self.steps):
                self.extend(self.upto + 1)
            stop = self.steps[mark]
            while j < stop:
                c = text[p]
                if not c:
                    return
                p += rows[j % _PERIOD][c]
                j += 1
            c = text[p]
            if not c:
                return
            row[self.bins[mark]] = self.codes[j % 997, c]
            mark += 1

    @staticmethod
    def _end(symbols: np.ndarray, p: int) -> int:
        at, step = p, 4096
        while True:
            zero = np.flatnonzero(symbols[at : at + step] == 0)
            if len(zero):
                return at + int(zero[0]) - p
            at, step = at + step, step * 2


@functools.lru_cache(maxsize=1)
def walk() -> Walk:
    return Walk()


def hex_of(rows: np.ndarray) -> list[str]:
    packed = (rows[:, 0::2] << 4) | rows[:, 1::2]
    return [r.tobytes().hex() for r in packed]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; two texts without symbols are alike, one without is unlike any other."""
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    raw = np.where(filled > 0, same / np.maximum(filled, 1), 1.0)
    return np.maximum(0.0, (raw - 1 / CODES) / (1 - 1 / CODES))


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by as many of the first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Characters walked together; bounds a worker's memory.
_TOGETHER = 12_000_000


def _compare(rows: list[tuple]) -> list[list]:
    """Of (id, text, range, ghost) rows that follow each other, the last only for its text: the columns of the result."""
    own = [k for k in range(len(rows) - 1) if not rows[k][3]]
    texts = [r[1] for r in rows]
    edits = [edited_text(texts[k], texts[k + 1]) for k in own]
    prints = walk().fingerprints([*texts, *edits])
    first, after, edit = prints[own], prints[[k + 1 for k in own]], prints[len(texts) :]
    sha = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]
    return [[rows[k][0] for k in own], [len(texts[k]) for k in own], sha, hex_of(first), hex_of(edit), likeness(first, edit).tolist(), likeness(first, after).tolist()]


#: Ranges of ids, at most: their bounds are in the plan. A range is read as a stream, so larger ones need no more memory.
RANGES = 8192


def bucket_bounds(docs: DataFrame, id_col: str, rows: int) -> list[int]:
    """Ids that cut the table into ranges of about so many rows; the last is the largest id."""
    n, top = docs.agg(F.count(id_col), F.max(id_col)).head()
    if not n:
        return [0]
    parts = max(1, min(n // rows, RANGES))
    cuts = docs.agg(F.percentile_approx(id_col, [k / parts for k in range(1, parts)] or [1.0], max(10_000, 4 * parts))).head()[0]
    return sorted({*cuts, top})


def range_of(bounds: list[int], x: Column) -> Column:
    """How many bounds are below ``x``, by two levels of comparison; 0 for null."""
    width = max(1, math.isqrt(len(bounds)))
    top = bounds[width - 1 :: width]
    arr = lambda v: F.lit(np.array(v, dtype=np.int64)) if v else F.expr("cast(array() as array<bigint>)")
    level = F.coalesce(F.size(F.filter(arr(top), lambda b: b < x)), F.lit(0)) * width
    return level + F.coalesce(F.size(F.filter(F.slice(arr(bounds), level + 1, F.lit(width)), lambda b: b < x)), F.lit(0))


def fingerprint_chain(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 1000) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    Ids are whole numbers. The next document is that of the next smaller id; after the smallest comes the largest. Rows of one id
    follow each other by text; null ids come last. A null text is empty; long texts are walked to their ends. Equal texts have
    equal fingerprints; an empty text's has no symbols. Further columns are dropped, whatever their names; an empty table gives
    an empty table.

    Texts are shuffled once, by ranges of ids; the row that begins each range is also sent to the range before it, so
    that no row has to wait for another task's. All rows of one id, and those without, are one task's stream.
    """
    bounds = bucket_bounds(docs, id_col, rows_per_range)
    last = len(bounds) - 1
    key = F.col(id_col)
    docs = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("r", range_of(bounds, F.col("doc_id")))
    at = F.array([F.lit(b) for b in bounds]) if len(bounds) < 4 else F.lit(np.array(bounds, dtype=np.int64))
    begins = F.coalesce(F.element_at(at, F.col("r") + 1) == F.col("doc_id"), F.col("doc_id").isNull() & F.lit(bounds == [0]))
    copies = F.when(begins, F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("ghost")), F.struct(F.when(F.col("r") == last, 0).otherwise(F.col("r") + 1).alias("r"), F.lit(True).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("ghost")))
    )
    rows = docs.select("doc_id", "text", F.explode(copies).alias("at")).select("doc_id", "text", "at.r", "at.ghost")
    rows = rows.repartition("r").sortWithinPartitions("r", "ghost", F.col("doc_id").desc_nulls_last(), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held: list[tuple] = []  # rows in order; the last waits for the next one's text
        id_type, chars = None, 0
        for batch in batches:
            id_type = batch.column(0).type
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held.append(row)
                chars += len(row[1])
                if chars > _TOGETHER and len(held) > 1:
                    yield done(held, id_type)
                    held, chars = held[-1:], len(row[1])
        if len(held) > 1:
            yield done(held, id_type)

    def done(held, id_type):
        return pa.RecordBatch.from_arrays([pa.array(o, t or id_type) for o, t in zip(_compare(held), types, strict=True)], names)

    out = rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("doc_id", id_col)


#: Bands and the filled bins that each samples; for fingerprints of under SHORT filled bins further bands sample fewer.
BANDS, SAMPLED = 32, 8
SHORT, SHORT_BANDS, SHORT_SAMPLED = 24, 16, 2
THRESHOLD = 0.8
#: So many fingerprints of a band's key are searched in one go; of more a first search, dealt by bins that the band samples next, finds
#: what it can, and a second one compares whatever that hasn't connected.
CROWD, NEXT = 2048, 3
#: Fingerprints of a crowded key that join all its first searches.
PIVOTS = 4
#: So many fingerprints at most, about, in one search of a crowded key.
WHOLE = 8 * CROWD


def rows_of(prints: list[bytes] | list[str]) -> np.ndarray:
    """The rows of codes of fingerprints, in bytes or hex."""
    whole = b"".join(bytes.fromhex(p) if isinstance(p, str) else p for p in prints)
    packed = np.frombuffer(whole, dtype=np.uint8).reshape(len(prints), BINS // 2)
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(len(prints), BINS)


@functools.lru_cache(maxsize=1)
def _bands() -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of each band: how many bins it samples, its order of the bins, and a random number for each bin and code."""
    rng = np.random.Generator(np.random.PCG64([SEED, 1]))
    return [(SAMPLED if k < BANDS else SHORT_SAMPLED, rng.permutation(BINS), rng.integers(-(2**63), 2**63, size=(BINS, CODES + 1))) for k in range(BANDS + SHORT_BANDS)]


def _sampled(rows: np.ndarray, band: int, low: int, high: int) -> np.ndarray:
    """Of each of ``rows`` a hash of the filled bins that a band samples after ``low`` of them, up to ``high``."""
    _, order, numbers = _bands()[band]
    own = rows[:, order]
    nth = np.cumsum(own > 0, axis=1)
    out = np.zeros(len(rows), dtype=np.int64)
    r, c = np.nonzero((own > 0) & (nth > low) & (nth <= high))
    np.add.at(out, r, numbers[c, own[r, c]])  # wraps
    return out


def band_keys(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each band: which of ``rows`` have a key in it, and their keys."""
    filled = (rows > 0).sum(axis=1)
    out = []
    for k, (sampled, *_) in enumerate(_bands()):
        at = np.flatnonzero((filled > 0) & (filled < SHORT if k >= BANDS else True))
        out.append((at, _sampled(rows[at], k, 0, sampled)))
    return out


#: Up to so many rows are compared bin by bin, more by planes of bits first.
_PLAIN = 64


def _planes(rows: np.ndarray) -> np.ndarray:
    """The codes of ``rows`` by bits: 64 bins to a word, four words to a bit, a column to a row."""
    bits = [np.packbits(rows >> k & 1, axis=1).view(np.uint64) for k in range(4)]
    return np.ascontiguousarray(np.concatenate(bits, axis=1).T)


def _differing(one: np.ndarray, planes: np.ndarray, word: int) -> np.ndarray:
    """In how many of the bins of a word the row ``one`` differs from each of ``planes``."""
    differ = planes[word] ^ one[word]
    bit = np.empty_like(differ)
    for k in range(word + 4, 16, 4):
        np.bitwise_or(differ, np.bitwise_xor(planes[k], one[k], out=bit), out=differ)
    return np.bitwise_count(differ)


def _close(one: np.ndarray, planes: np.ndarray, most: float) -> np.ndarray:
    """Which of ``planes`` differ from the row ``one`` in at most so many bins."""
    at = np.flatnonzero(_differing(one, planes, 0) <= most)
    if 4 * len(at) < planes.shape[1]:
        planes = planes[:, at]
        return at[sum(_differing(one, planes, w).astype(np.int16) for w in range(4)) <= most]
    return np.flatnonzero(sum(_differing(one, planes, w).astype(np.int16) for w in range(4)) <= most)


def linked(rows: np.ndarray, threshold: float, roots: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Links of likeness ``threshold`` or more that connect just what all such links between ``rows`` connect.

    Each row that is reached is compared with all that aren't reached yet, so like rows cost one comparison each. Rows of one of ``roots``
    count as connected. Where ``sides`` (0 and 1) are given, only rows of different ones are compared.
    """
    n = len(rows)
    # like rows differ in few of the bins that either fills, so those differing in more need no closer look
    most = BINS * (1 - (threshold * (1 - 1 / CODES) + 1 / CODES)) + 1 if threshold > 0 else BINS
    planes = _planes(rows) if n > _PLAIN else None
    away = np.ones(n, dtype=bool)
    pools = [np.arange(n)] if sides is None else [np.flatnonzero(sides == s) for s in (0, 1)]
    words = [None if planes is None else planes[:, pool] for pool in pools]
    out, todo, left = [], [], [len(pool) for pool in pools]

    def reach(found):
        if roots is not None and len(found):
            found = np.flatnonzero(away & np.isin(roots, roots[found]))
        away[found] = False
        todo.extend(found.tolist())
        for s in range(len(pools)):
            left[s] -= len(found) if sides is None else np.count_nonzero(sides[found] == s)
            if 4 * left[s] < 3 * len(pools[s]):
                stay = away[pools[s]]
                pools[s] = pools[s][stay]
                words[s] = None if planes is None else words[s][:, stay]

    for start in range(n):
        if not away[start]:
            continue
        reach(np.array([start]))
        while todo and sum(left):
            k = todo.pop()
            s = 0 if sides is None else 1 - int(sides[k])
            if not left[s]:
                continue
            some = pools[s] if planes is None else pools[s][_close(planes[:, k], words[s], most)]
            some = some[away[some]]
            if not len(some):
                continue
            like = likeness(rows[k : k + 1], rows[some])
            near = like >= threshold
            if near.any():
                out += [(k, b, x) for b, x in zip(some[near].tolist(), like[near].tolist(), strict=True)]
                reach(some[near])
        if not sum(left):
            break
    return out


SEARCH = ["key", "part", "pair"]


def _pieces(members: DataFrame, whole: int) -> DataFrame:
    """``members`` (key, part, node, parts) with ``pair``: 0, or, where over ``whole`` share key and part, the piece that they are dealt to."""
    sizes = members.groupBy("key", "part").agg(F.count("*").alias("n")).where(F.col("n") > whole)
    large = materialise(sizes.select(F.struct("key", "part").alias("kp"), "n", F.ceil(F.col("n") / whole).alias("pieces")), "crowds")
    found = join_groups(members.withColumn("kp", F.struct("key", "part")), large, "kp", "n")
    return found.select("key", "part", F.coalesce(F.pmod(F.xxhash64(F.lit(SEED), "node"), "pieces"), F.lit(0)).cast("long").alias("pair"), "node")


def _unconnected(members: DataFrame, links: DataFrame, whole: int) -> DataFrame:
    """Searches that compare all ``members`` (key, node) of a key that ``links`` don't connect: key, part, pair, node, side and root.

    A key whose members are one component needs none. The others' members are dealt to blocks of half of ``whole``, those of a component
    larger than a block to blocks of its own. Each pair of blocks is a search of one against the other, and each block one of its own;
    only blocks of that component needn't meet each other.
    """
    roots = components(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rooted = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "rooted")
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("top")).where("most < n")
    half, large = F.lit(max(1, whole // 2)), F.col("most") > whole // 2
    keys = keys.select("key", "n", F.when(large, F.col("top")).alias("top"), F.ceil(F.when(large, F.col("n") - F.col("most")).otherwise(F.col("n")) / half).alias("rest"), F.when(large, F.ceil(F.col("most") / half)).otherwise(0).alias("tops"))
    found = join_groups(rooted, materialise(keys, "unconnected"), "key", "n").where("n is not null")
    deal, count = F.xxhash64(F.lit(SEED), "node"), lambda n: F.filter(F.sequence(F.lit(0).cast("long"), n), lambda x: x < n)
    own, at_top = F.pmod(deal, "rest"), F.coalesce(F.col("root") == F.col("top"), F.lit(False))
    search = lambda part, pair, side: F.struct(part.cast("long").alias("part"), pair.cast("long").alias("pair"), side.cast("byte").alias("side"))
    among = F.transform(count(F.col("rest")), lambda x: search(F.least(own, x), F.greatest(own, x), F.when(own != x, (own > x).cast("int"))))
    with_top = F.transform(count(F.col("tops")), lambda x: search(own, F.col("rest") + x, F.lit(0)))
    of_top = F.transform(count(F.col("rest")), lambda x: search(x, F.col("rest") + F.pmod(deal, F.greatest("tops", F.lit(1))), F.lit(1)))
    return found.select("key", F.explode(F.when(at_top, of_top).otherwise(F.concat(among, with_top))).alias("s"), "node", "root").select("key", "s.part", "s.pair", "node", "s.side", "root")


def near_pairs(classes: DataFrame, *, threshold: float = THRESHOLD, crowd: int = CROWD, whole: int = WHOLE) -> DataFrame:
    """Links between like fingerprints: bit-sampled banding, then verification.

    ``classes`` has ``node`` (a long) and ``fingerprint`` (in bytes), both unique. Each band orders the bins at random and samples the first
    ones that a fingerprint fills, so bins without a step never bring unlike texts together; two fingerprints meet in a
    band of SAMPLED bins with a chance of about the share of bins that agree to that power, about 0.998 in all at likeness
    0.8. All that meet in a band are searched for links: of those at or above ``threshold`` as many are returned as connect
    what all of them connect. Where over ``crowd`` fingerprints meet in a key they are first dealt by the bins that the band samples next,
    with PIVOTS of them in every search, and by number where over ``whole`` still meet: that takes time in proportion. Members of a key
    that no links connect then are all compared with each other, as pairs of blocks, so a search is bounded and nothing that meets is
    left out; where most are unlike that takes time with the square of their number.
    Returns ``a``, ``b`` (nodes) and ``likeness``; a link may come from several bands.
    """

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for band, (at, keys) in enumerate(band_keys(rows_of(batch.column(1).to_pylist()))):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(keys), pa.array(np.full(len(at), band, dtype=np.int8))], ["node", "key", "band"])

    def dealt_further(batches):
        """The part of a crowded key that a member goes to, by the bins that the band samples next."""
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, bands = rows_of(batch.column("fingerprint").to_pylist()), batch.column("band").to_numpy()
            more = np.zeros(len(rows), dtype=np.int64)
            for band in np.unique(bands):
                sampled = _bands()[band][0]
                more[bands == band] = _sampled(rows[bands == band], band, sampled, sampled + NEXT)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("parts"), pa.array(more), batch.column("node")], ["key", "parts", "more", "node"])

    def search(batches):
        key, held = None, []
        for batch in batches:
            found = []
            for k, part, pair, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, part, pair) != key:
                    found += done(held)
                    key, held = (k, part, pair), []
                held.append(row)
            yield table(found)
        yield table(done(held))

    def done(held):
        if not held:
            return []
        nodes, prints, *more = zip(*held, strict=True)
        sides = np.array(more[0]) if more and more[0][0] is not None else None
        return [(nodes[a], nodes[b], x) for a, b, x in linked(rows_of(prints), threshold, np.array(more[1]) if more else None, sides)]

    def table(found):
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "likeness"])

    def searched(members, *more):
        members = members.join(classes.select("node", "fingerprint"), "node").select(*SEARCH, "node", "fingerprint", *more)
        return members.repartition(*SEARCH).sortWithinPartitions(*SEARCH, "node").mapInArrow(search, "a long, b long, likeness double")

    # worked out twice rather than written: there are 32 keys to a fingerprint
    keys = classes.select("node", "fingerprint").mapInArrow(keyed, "node long, key long, band byte")
    met = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / crowd))
    found = join_groups(keys, materialise(met, "met"), "key", "n").where("n is not null")
    found = materialise(found.select("key", "band", "parts", "node"), "members")
    members, crowded = found.where("parts = 1").select("key", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("pair"), "node"), found.where("parts > 1")
    if crowded.isEmpty():
        return searched(members)
    more = crowded.join(classes.select("node", "fingerprint"), "node").select("key", "band", "parts", "node", "fingerprint").mapInArrow(dealt_further, "key long, parts long, more long, node long")
    crowded = materialise(_pieces(more.select("key", F.pmod(F.xxhash64("more"), "parts").alias("part"), "node"), whole), "crowded")
    ends = [F.min_by("node", F.xxhash64(F.lit(k), "node")) for k in range(PIVOTS)]
    pivots = crowded.groupBy("key").agg(F.array_distinct(F.array(*ends)).alias("pivots"))
    pivots = crowded.select("key", "part", "pair").distinct().join(pivots, "key").select(*SEARCH, F.explode("pivots").alias("node"))
    links = materialise(searched(members.unionByName(crowded.unionByName(pivots).distinct())), "links")
    return links.unionByName(searched(_unconnected(crowded.select("key", "node"), links, whole), "side", "root"))


def fingerprint_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """The rows of ``fingerprint_chain`` and ``class_id``: the smallest id of the texts that links between like fingerprints lead to.

    Equal fingerprints are always one class. Null ids are never the smallest unless a class has no other.
    """
    hexes = ["edited_sha256", "fingerprint", "edited_fingerprint"]
    chain = fingerprint_chain(docs, id_col=id_col, text_col=text_col, **kw)
    columns = chain.columns
    chain = materialise(chain.withColumns({c: F.unhex(c) for c in hexes}), "chain")
    groups = chain.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(id_col).alias("least"))
    classes = materialise(groups.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(near_pairs(classes, threshold=threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labelled = classes.join(roots, "node", "left").select("fingerprint", "n", "least", F.coalesce("root", "node").alias("root"))
    labelled = materialise(labelled, "rooted")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("members"))
    labels = materialise(join_groups(labelled, materialise(smallest, "smallest"), "root", "members").select("fingerprint", "n", "class_id"), "labels")
    out = join_groups(chain, labels, "fingerprint", "n")
    return out.select(*[F.lower(F.hex(c)).alias(c) if c in hexes else c for c in columns], "class_id")
