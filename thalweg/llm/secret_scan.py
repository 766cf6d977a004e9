"""Secrets in whole texts: base patterns, and a battery of randomness tests over other long tokens. SQL functions only.

A token without white space is a candidate. Its encoding is inferred from its characters. The battery tests it against
randomness over that alphabet: chi-squared uniformity of its symbols, runs about the middle of the alphabet, and serial
correlation, combined by Fisher's method. Against the other hypothesis, written language, it has the likelihood under the letter
pairs of the table's words over that under its alphabet, a bound on a p-value by Markov's inequality, which shrinks as random
tokens grow. What enters the control of false discoveries is that bound over the battery's p-value (which is at most 1, so the
quotient is a bound too): a token has to be far likelier as random than as language by as much as the battery speaks against
randomness. Within each class of length, Benjamini-Hochberg control over all candidates of the table decides what is reported.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import materialise
from thalweg.llm.quality import FUNCTION_WORDS, let

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more: as AKIA[A-Z0-9]+ with short ones dropped, since runs are maximal
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ["assign", "access", "hex", "random"]
ENCODINGS = {
    "^[0-9a-f]+$": "0123456789abcdef",
    "^[0-9A-F]+$": "0123456789ABCDEF",
    "^[a-z]+$": "abcdefghijklmnopqrstuvwxyz",
    "^[A-Z]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "^[A-Z2-7]+=*$": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "^[0-9a-z]+$": "0123456789abcdefghijklmnopqrstuvwxyz",
    "^[0-9A-Z]+$": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "^[A-Za-z]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "^[0-9A-Za-z]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "^[0-9A-Za-z+/]+=*$": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Rate of false discoveries; lower ends of the classes of length; steps of -log10(p) in the histogram, and its last one.
FDR = 0.01
LENGTHS = [20, 32, 48, 64, 128]
STEPS, LAST = 4, 400

#: What words and candidates are made of; the weight of a letter's own share among those that follow a letter.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
BACKOFF = 10.0

_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def running(xs: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The results of folding ``xs`` (longs) by ``op`` up to each element. Runs of about the root of the length are folded on
    their own and then joined, so arrays aren't copied once for each element."""
    none = F.array().cast("array<bigint>")
    after = lambda s, x: F.when(s["last"].isNull(), x).otherwise(op(s["last"], x))
    step = lambda s, x: let(after(s, x), lambda y: F.struct(y.alias("last"), F.concat(s["out"], F.array(y)).alias("out")))
    fold = lambda c: F.aggregate(c, F.struct(F.lit(None).cast("long").alias("last"), none.alias("out")), step, lambda s: s["out"])

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        runs = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda k: fold(F.slice(v, k * w + 1, w))))
        before = lambda r: fold(F.transform(r, lambda c: F.element_at(c, -1)))
        joined = lambda r, b: F.transform(r, lambda c, k: F.when(k == 0, c).otherwise(F.transform(c, lambda x: op(F.get(b, k - 1), x))))
        return let(runs, lambda r: let(before(r), lambda b: F.flatten(joined(r, b))))

    return let(F.transform(xs, lambda x: x.cast("long")), lambda v: F.when(F.size(v) == 0, none).otherwise(whole(v)))


def spans(text: Column, pattern: str, kind: int, likely: Column | None = None, group: int | None = None, least: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places in code points, where ``group`` has ``least`` characters or more."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(m: Column, g: Column) -> Column:
        ends = running(F.transform(m, lambda x, i: F.get(g, i) + F.length(x)), lambda a, b: a + b)
        return let(ends, lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).cast("int").alias("start"), F.get(e, i).cast("int").alias("end"), F.lit(kind).alias("kind"), x.alias("value"))))

    out = let(found, lambda m: F.when(F.size(m) == 0, _none()).otherwise(let(gaps, lambda g: placed(m, g))))
    if group is not None:
        out = F.filter(out, lambda x: F.length(F.regexp_extract(x["value"], pattern, group)) >= least)
    there = text.rlike(pattern) if likely is None else likely
    return F.when(there, out).otherwise(_none())


def apart(base: Column, found: Column) -> Column:
    """Those spans of ``found`` that overlap none of ``base``; the kind of all of ``found`` is the last one."""
    last = len(KINDS) - 1
    furthest = lambda v: running(F.transform(v, lambda x: F.when(x["kind"] < last, x["end"]).otherwise(0)), F.greatest)
    nearest = lambda v: F.reverse(running(F.reverse(F.transform(v, lambda x: F.when(x["kind"] < last, x["start"]).otherwise((1 << 31) - 1))), F.least))
    kept = lambda v, f, n: F.filter(v, lambda x, i: (x["kind"] == last) & (F.get(f, i) <= x["start"]) & (F.get(n, i) >= x["end"]))
    sorted_ = let(F.sort_array(F.concat(base, found)), lambda v: let(furthest(v), lambda f: let(nearest(v), lambda n: kept(v, f, n))))
    return F.when(F.size(base) == 0, found).when(F.size(found) == 0, found).otherwise(sorted_)


def log_tail(z: Column) -> Column:
    """Minus the natural logarithm of the upper tail of the normal distribution, by a logistic curve."""
    y = 1.5976 * z + 0.070565 * z * z * z
    return F.greatest(y, F.lit(0.0)) + F.log1p(F.exp(-F.abs(y)))


def encoding_of(token: Column, of: Callable[[str], object]) -> Column:
    """``of`` of the symbols of the first of ENCODINGS whose pattern fits."""
    out = F.lit(of(ENCODINGS[""]))
    for pattern, symbols in reversed([x for x in ENCODINGS.items() if x[0]]):
        out = F.when(token.rlike(pattern), F.lit(of(symbols))).otherwise(out)
    return out


def against_randomness(token: Column) -> Column:
    """-log10 of the p-value of the battery: chi-squared uniformity over the inferred alphabet, runs about its middle and
    serial correlation, combined by Fisher's method. Large if ``token`` isn't random."""
    body = F.rtrim(token, F.lit("="))

    def battery(x: Column, symbols: Column) -> Column:
        n, size = F.size(x).cast("double"), F.length(symbols).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
        counts = F.transform(F.sequence(F.lit(0), F.length(symbols) - 1), lambda k: F.size(F.filter(x, lambda y: y == k)).cast("double"))
        chi = size / n * total(F.transform(counts, lambda c: c * c)) - n
        uniform = log_tail((chi - (size - 1)) / F.sqrt(2 * (size - 1) * (1 - 1 / n)))
        high = F.transform(x, lambda y: (2 * y >= size).cast("int"))
        ones = F.aggregate(high, F.lit(0.0), lambda s, y: s + y)
        runs = 1 + let(high, lambda h: F.aggregate(F.transform(h, lambda y, i: (F.coalesce(F.get(h, i - 1), y) != y).cast("int")), F.lit(0.0), lambda s, y: s + y))
        mu = 2 * ones * (n - ones) / n + 1
        var = F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(0.01))
        mean = total(F.transform(x, lambda y: y.cast("double"))) / n
        square = F.greatest(total(F.transform(x, lambda y: (y - mean) * (y - mean))), F.lit(1e-6))
        serial = total(F.transform(x, lambda y, i: F.coalesce((y - mean) * (F.get(x, i - 1) - mean), F.lit(0.0))))
        both = lambda z: F.greatest(log_tail(z) - F.log(F.lit(2.0)), F.lit(0.0))
        three = uniform + both(F.abs(runs - mu) / F.sqrt(var)) + both(F.abs(serial / square + 1 / n) * F.sqrt(n))
        # Fisher: twice the sum is chi-squared with six degrees of freedom
        return let(three, lambda t: (t - F.log(1 + t + t * t / 2)) / F.log(F.lit(10.0)))

    place = lambda symbols: F.transform(F.split(body, ""), lambda c: F.instr(symbols, c) - 1)
    return let(encoding_of(token, str), lambda s: let(F.filter(place(s), lambda y: y >= 0), lambda x: battery(x, s)))


def _places(token: Column) -> Column:
    """The places of the characters in LETTERS, from 1; 0 is the start."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(LETTERS), c))


def letter_pairs(docs: DataFrame, text: Column) -> np.ndarray:
    """log10 of the chance that a letter (second index) follows another or the start (first index) in the words of ``docs``.

    Words are runs of LETTERS shorter than a candidate. Each distinct word counts once, so that frequent words don't make rare
    ones look unlike language; so do the function words of four languages, for small tables.
    """
    words = docs.select(F.explode(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9+/_-]+")).alias("w")).where(F.length("w").between(1, LENGTHS[0] - 1))
    pairs = words.distinct().select(F.explode(let(_places(F.col("w")), lambda p: F.transform(p, lambda y, i: F.struct(F.coalesce(F.get(p, i - 1), F.lit(0)).alias("a"), y.alias("b"))))).alias("p"))
    seen = np.zeros((len(LETTERS) + 1, len(LETTERS) + 1))
    # at most 67 * 66 rows, on the driver
    for a, b, n in pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).collect():
        seen[a, b] += n
    for w in FUNCTION_WORDS.split():
        if w.isascii():
            for a, b in zip("\0" + w, w, strict=False):
                seen[LETTERS.find(a) + 1, LETTERS.find(b) + 1] += 1
    single = seen.sum(axis=0) + 0.5
    single[0] = 0.0
    chance = (seen + BACKOFF * single / single.sum()) / (seen.sum(axis=1, keepdims=True) + BACKOFF)
    return np.log10(np.maximum(chance, 1e-300))


def language_evidence(token: Column, pairs: np.ndarray) -> Column:
    """-log10 of a bound on the chance that written language makes a token so much likelier under an encoding's alphabet.

    The alphabet is chosen among ENCODINGS by the token; a share of each in the alternative pays for that.
    """
    body = F.rtrim(token, F.lit("="))
    size = encoding_of(token, lambda symbols: float(len(symbols)))
    width = len(LETTERS) + 1
    table = F.lit(pairs.reshape(-1))
    written = let(_places(body), lambda p: F.aggregate(F.transform(p, lambda y, i: F.get(table, F.coalesce(F.get(p, i - 1), F.lit(0)) * width + y)), F.lit(0.0), lambda s, y: s + y))
    return -written - F.length(body) * F.log10(size) - F.log10(F.lit(float(len(ENCODINGS))))


def scan(text: Column) -> Column:
    """A struct of ``base`` spans and the ``candidates`` with their class of length and value."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        low = let(F.lower(t), lambda x: x.contains("passw") | x.contains("secret") | x.contains("token") | x.contains("apikey") | x.contains("api_key"))
        base = F.concat(
            spans(t, ASSIGN, 0, low, 2, 6),
            spans(t, ACCESS, 1, t.contains("AKIA")),
            spans(t, HEX, 2),
        )
        clean = lambda b: F.transform(F.sort_array(b), lambda x: F.struct(x["start"], x["end"], x["kind"]))
        tested = lambda b: F.transform(
            apart(b, spans(t, CANDIDATE, len(KINDS) - 1)),
            lambda x: F.struct(
                x["start"].alias("start"),
                x["end"].alias("end"),
                F.aggregate(F.array(*[F.lit(v) for v in LENGTHS[1:]]), F.lit(0), lambda s, v: s + (x["end"] - x["start"] >= v).cast("int")).alias("size"),
                x["value"].alias("value"),
            ),
        )
        return let(base, lambda b: F.struct(clean(b).alias("base"), tested(b).alias("candidates")))

    return let(text, of)


def _decided(docs: DataFrame, text: Column, carried: list[str]) -> DataFrame:
    """The columns carried, ``__base`` and ``__all`` (spans by start, then kind)."""
    found = materialise(docs.select(*carried, scan(text).alias("__s")), "scanned")
    pairs = letter_pairs(docs, text) if not found.where(F.size("__s.candidates") > 0).isEmpty() else np.zeros((1, 1))

    def judged(c: Column) -> Column:
        surplus = let(c["value"], lambda x: language_evidence(x, pairs) - F.greatest(against_randomness(x), F.lit(0.0)))
        return F.least(F.greatest(F.floor(surplus * STEPS).cast("int"), F.lit(0)), F.lit(LAST))

    found = found.withColumn("__c", F.transform("__s.candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["size"].alias("size"), judged(c).alias("evidence"))))
    hist = found.select(F.explode("__c").alias("c")).groupBy("c.size", "c.evidence").agg(F.count("*").alias("n"))
    # at most len(LENGTHS) * (LAST + 1) rows, on the driver
    limits = []
    rows = hist.collect()
    for size in range(len(LENGTHS)):
        own = sorted(((r["evidence"], r["n"]) for r in rows if r["size"] == size), reverse=True)
        tested, so_far, limit = sum(n for _, n in own), 0, LAST + 1
        for evidence, n in own:
            so_far += n
            if tested * 10 ** (-evidence / STEPS) <= FDR * so_far:
                limit = evidence
        limits.append(limit)
    least = F.array(*[F.lit(x) for x in limits])
    more = F.transform(F.filter("__c", lambda c: (c["evidence"] > 0) & (c["evidence"] >= F.get(least, c["size"]))), lambda c: F.struct(c["start"], c["end"], F.lit(3).alias("kind")))
    typed = lambda c: c.cast("array<struct<start:int,end:int,kind:int>>")
    by_start = lambda c: F.transform(F.sort_array(F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.withColumn("__base", by_start(typed(F.col("__s.base")))).withColumn("__all", by_start(F.concat(typed(F.col("__s.base")), typed(more)))).drop("__s", "__c")


def _joined(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` (``kind:start:end``, by start, then
    kind, comma-joined; code points, end exclusive; kind ``random`` is what the battery adds).

    A null or empty text has no spans. Repeated rows get equal results; null ids pass; further columns are dropped, whatever
    their names; an empty table gives an empty table. The thresholds depend on all rows of the table.
    """
    out = _decided(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"), ["doc_id"])
    n = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long")
    return out.select(F.col("doc_id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.col("__all")).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", n_chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span replaced by ``mark`` (spans that overlap by one), and ``n_chars_col``, if it is
    there, counted again where something was replaced. Other rows and columns stay as they are, whatever their names;
    null and empty texts have no spans; an empty table gives an empty table. Time is near linear in a text's length."""
    columns = docs.columns
    text = F.col("__row")[text_col]
    out = _decided(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row")), text, ["__row"])
    out = out.withColumn("__cut", F.when(F.size("__all") > 0, without(text, F.col("__all"), mark)))
    texts = F.coalesce(F.col("__cut"), text)
    new = {text_col: texts}
    if n_chars_col in columns:
        n = F.col("__row")[n_chars_col]
        new[n_chars_col] = F.when(F.col("__cut").isNull(), n).otherwise(F.length("__cut").cast(docs.schema[n_chars_col].dataType))
    return out.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in columns])


#: Code points of a block of a long text, within which places are found by counting.
BLOCK = 4096


def without(text: Column, spans_: Column, mark: str) -> Column:
    """``text`` with each of ``spans_`` (by start; at least one) replaced by ``mark``, those that overlap by one."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(b: Column, start: Column, end: Column) -> Column:
        i, j = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        head = F.substr(F.get(b, i), (start % BLOCK + 1).cast("int"), F.lit(BLOCK))
        between = F.array_join(F.slice(b, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        last = F.coalesce(F.substr(F.get(b, j), F.lit(1), (end % BLOCK).cast("int")), F.lit(""))
        inside = F.substr(F.get(b, i), (start % BLOCK + 1).cast("int"), (end - start).cast("int"))
        return F.when(start >= end, F.lit("")).when(i == j, inside).otherwise(F.concat(head, between, last))

    def cut(b: Column, far: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(spans_) - 1), lambda i: (i == 0) | (F.get(spans_, i)["start"] >= F.get(far, i - 1)))
        before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(far, i - 1))
        pieces = F.transform(begins, lambda i: piece(b, before(i), F.get(spans_, i)["start"].cast("long")))
        rest = piece(b, F.element_at(far, -1), F.length(text).cast("long"))
        return F.concat(F.array_join(pieces, mark), F.lit(mark), rest)

    return let(blocks, lambda b: let(running(F.transform(spans_, lambda x: x["end"]), F.greatest), lambda far: cut(b, far)))
