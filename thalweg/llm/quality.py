"""Quality rules combined by weak supervision, in SQL functions only.

Each rule votes good (1), bad (-1) or abstains (0). Documents with the same votes are one pattern; RULES rules give at most
3 ** RULES patterns whatever the input, so expectation-maximisation over the pattern counts is one row's work. A document is
good, or its chief fault is of one of as many kinds as there are rules. Expectation-maximisation estimates how common each
class is and, for each class, how often each rule that votes casts a bad vote: among good documents that is the rule's error,
among those of a fault how well it finds that fault. The posterior probability of being good decides. What it starts from
only gives the rules a direction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import WHITE, materialise, words

SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that it for on with as are be this by was or from at an not "
    "der die das und in zu den von mit ist im ein eine nicht auf für des dem sich als "
    "de la le les et des en un une que qui du dans est pour par au sur pas avec "
    "el los las y que en un una por con para se del no su al lo como es"
)
ITERATIONS = 30
#: Words by which a document passes the base.
LEAST_WORDS = 50
#: Documents of at least this posterior are kept.
KEEP = 0.5


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def repeated_words(w: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more among the words ``w``.

    Windows are sorted by 33 bits of their hash beside their place (30 bits), so that only those with an equal neighbour are
    sorted again, by the words themselves.
    """
    n = F.size(w)
    word = lambda i: F.get(w, i)
    place = lambda x: x.bitwiseAND(F.lit((1 << 30) - 1)).cast("int")
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.shiftleft(F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(F.lit((1 << 33) - 1)), 30).bitwiseOR(i.cast("long")),
    )
    beside = lambda a, x, i, of: F.coalesce(of(F.get(a, i - 1)) == of(x), F.lit(False)) | F.coalesce(of(F.get(a, i + 1)) == of(x), F.lit(False))
    likely = let(F.sort_array(packed), lambda s: F.filter(s, lambda x, i: beside(s, x, i, lambda y: F.shiftright(y, 30))))

    def exact(c: Column) -> Column:
        named = F.transform(c, lambda x: let(place(x), lambda p: F.struct(F.struct(word(p).alias("a"), word(p + 1).alias("b"), word(p + 2).alias("c")).alias("w"), p.alias("p"))))
        same = let(F.sort_array(named), lambda s: F.filter(s, lambda x, i: beside(s, x, i, lambda y: y["w"])))
        places = F.sort_array(F.transform(same, lambda x: x["p"]))
        steps = let(places, lambda q: F.transform(q, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(q, i - 1), x - 3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(likely, lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(exact(c))))


def features(text: Column) -> Column:
    """A struct of the base counts and of what the rules look at."""
    text = F.coalesce(text, F.lit(""))
    without = lambda t, chars: F.length(F.translate(t, chars, ""))
    frequent = sorted(set(FUNCTION_WORDS.split()))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, WHITE, "") != "")
        n_chars = F.length(t)
        return let(
            words(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                without(t, WHITE).cast("long").alias("word_chars"),
                (n_chars - without(t, SYMBOLS)).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(F.filter(lines, lambda x: F.lit(True))).cast("long").alias("n_lines"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(frequent))).cast("long").alias("n_frequent"),
                (n_chars - without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
                (n_chars - without(t, "!?")).cast("long").alias("n_shouts"),
                (n_chars - without(t, "0123456789")).cast("long").alias("n_digits"),
                F.size(F.filter(w, lambda x: x.endswith(".") | x.endswith("!") | x.endswith("?"))).cast("long").alias("n_ends"),
            ),
        )

    return let(text, of)


def votes(f: Column) -> list[Column]:
    """The rules. ``f`` is the struct of ``features``. Between the bounds, or where there is too little to look at, they abstain."""
    n, chars = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["word_chars"], F.lit(1))
    any_, enough, lines = f["n_words"] > 0, f["n_words"] >= 20, F.greatest(f["n_lines"], F.lit(1))
    vote = lambda seen, bad, good: F.when(~seen, 0).when(bad, -1).when(good, 1).otherwise(0)
    return [
        vote(any_, f["n_symbols"] > 0.10 * n, f["n_symbols"] <= 0.01 * n),
        vote(any_, f["n_upper"] > 0.35 * chars, f["n_upper"].between(0.002 * chars, 0.15 * chars)),
        vote(any_, f["n_shouts"] > 0.20 * n, f["n_shouts"] <= 0.05 * n),
        vote(enough, f["n_repeat_words"] > 0.30 * n, f["n_repeat_words"] <= 0.02 * n),
        vote(lines >= 3, f["n_dup_lines"] > 0.30 * lines, f["n_dup_lines"] == 0),
        vote(enough, f["n_frequent"] < 0.05 * n, f["n_frequent"] >= 0.15 * n),
        vote(any_, (chars > 10 * n) | (chars < 2.5 * n), (chars <= 7 * n) & (chars >= 3.5 * n)),
        vote(enough, (f["n_words"] >= LEAST_WORDS) & (f["n_distinct"] < 0.30 * n), f["n_distinct"] >= 0.60 * n),
        vote(any_, f["n_digits"] > 0.20 * chars, f["n_digits"] <= 0.02 * chars),
        vote(enough, f["n_ends"] == 0, f["n_ends"].between(0.02 * n, 0.25 * n)),
    ]


RULES = 10
#: Before anything is seen: the share of good documents, and the chance that a rule which votes casts a bad vote on a good
#: document, on one of another rule's fault, and on one of its own; what they weigh, as a share of all documents.
GOOD_SHARE, ERROR, OTHER, OWN, WEIGHT = 0.8, 0.2, 0.3, 0.7, 0.01


def fit(patterns: DataFrame) -> DataFrame:
    """Of ``v`` (votes) and ``n`` (documents), one row: ``ps`` (the patterns) and ``s``, a struct of ``share`` (of the good and of
    each rule's fault) and ``bad`` (for each of these classes, each rule's chance of a bad vote when it votes)."""
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("ps"))
    number = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    share0 = number([GOOD_SHARE] + [(1 - GOOD_SHARE) / RULES] * RULES)
    bad0 = F.array(number([ERROR] * RULES), *[number([OWN if r == k else OTHER for r in range(RULES)]) for k in range(RULES)])

    def step(s: Column, start: Column) -> Column:
        seen = F.transform(F.col("ps"), lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), _classes(s, p["v"]).alias("q")))

        def update(ps: Column) -> Column:
            of = lambda c: _total(ps, lambda x: x["n"] * F.get(x["q"], c))
            voted = lambda c, r: _total(ps, lambda x: F.when(F.get(x["v"], r) == 0, 0.0).otherwise(x["n"] * F.get(x["q"], c)))
            bad = lambda c, r: _total(ps, lambda x: F.when(F.get(x["v"], r) < 0, x["n"] * F.get(x["q"], c)).otherwise(0.0))
            own = lambda c: start["weight"] * F.get(start["share"], c)
            rate = lambda c, r: (bad(c, r) + own(c) * F.get(F.get(start["bad"], c), r)) / (voted(c, r) + own(c))
            rules, classes = F.sequence(F.lit(0), F.lit(RULES - 1)), F.sequence(F.lit(0), F.lit(RULES))
            return F.struct(
                F.transform(classes, lambda c: (of(c) + own(c)) / (start["n"] + start["weight"])).alias("share"),
                F.transform(classes, lambda c: F.transform(rules, lambda r: rate(c, r))).alias("bad"),
            )

        return let(seen, update)

    n = _total(F.col("ps"), lambda x: x["n"])
    begin = F.struct(share0.alias("share"), bad0.alias("bad"), n.alias("n"), (n * WEIGHT).alias("weight"))
    fitted = let(begin, lambda b: F.aggregate(F.array_repeat(b, ITERATIONS), F.struct(b["share"].alias("share"), b["bad"].alias("bad")), step))
    return row.select("ps", F.when(F.size("ps") > 0, fitted).alias("s"))


def _total(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda t, x: t + f(x))


def _classes(s: Column, v: Column) -> Column:
    """The probability of each class given the votes ``v``."""
    vote = lambda b, r: F.when(F.get(v, r) == 0, 0.0).when(F.get(v, r) < 0, F.log(b)).otherwise(F.log1p(-b))
    logs = F.transform(s["share"], lambda p, c: F.log(p) + F.aggregate(F.transform(F.get(s["bad"], c), vote), F.lit(0.0), lambda t, x: t + x))
    scaled = let(logs, lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda y: F.exp(y - m))))
    return let(scaled, lambda x: let(_total(x, lambda y: y), lambda z: F.transform(x, lambda y: y / z)))


def learn(patterns: DataFrame) -> DataFrame:
    """Of ``v`` (votes) and ``n`` (documents): each ``v`` with its ``posterior`` of being good."""
    return fit(patterns).select(F.explode("ps").alias("x"), "s").select(F.col("x.v").alias("v"), F.get(_classes(F.col("s"), F.col("x.v")), 0).alias("posterior"))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scored(docs: DataFrame, text: Column, carried: list[str], least_words: int) -> DataFrame:
    """The columns carried, the base counts, ``__failed``, ``__kept`` and ``__posterior`` (null where failed)."""
    f = docs.select(*carried, features(text).alias("__f"))
    failed = (F.col("__f.n_words") < least_words) | (100 * F.col("__f.n_repeat_words") > 50 * F.col("__f.n_words"))
    f = f.select(*carried, *[F.col(f"__f.{c}").alias(f"__{c}") for c in BASE], failed.alias("__failed"), F.array(*votes(F.col("__f"))).alias("__v"))
    f = materialise(f, "votes")
    counts = f.where(~F.col("__failed")).groupBy(F.col("__v").alias("v")).agg(F.count("*").alias("n"))
    learnt = materialise(learn(counts), "posteriors")  # at most 3 ** RULES rows: a proven bound for the broadcast
    posterior = F.when(~F.col("__failed"), F.col("p"))
    out = f.join(F.broadcast(learnt.select(F.col("v").alias("__v"), F.col("posterior").alias("p"))), "__v", "left").withColumn("__posterior", posterior)
    return out.withColumn("__kept", F.coalesce(F.col("__posterior") >= KEEP, F.lit(False))).drop("p")


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row: its id, the base counts, ``base_failed``, ``kept``, ``posterior`` (null if base_failed).

    The base fails where there are fewer than ``least_words`` words or over half of them repeat. A null or empty text has no
    words. Repeated rows get equal results and count as often as they are there; null ids pass; whole texts are looked at,
    however long; further columns are dropped, whatever their names; an empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = _scored(docs, F.col("text"), ["doc_id"], least_words)
    return out.select(F.col("doc_id").alias(id_col), *[F.col(f"__{c}").alias(c) for c in BASE], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__posterior").alias("posterior"))


def keep_good(docs: DataFrame, *, text_col: str = "text", least_words: int = 1) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    A short text isn't a bad one, so by default only those without words fail for their length: null, empty and blank ones go.
    Repeated rows are kept or go together; null ids pass; an empty table gives an empty table.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return _scored(row, F.col("__row")[text_col], ["__row"], least_words).where("__kept").select("__row.*")
