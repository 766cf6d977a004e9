"""Lines that many documents share, dropped but for one document, in SQL functions only.

Documents come in batches, those of the largest ids first. A batch's line hashes are counted into a run: a table dealt into buckets by
the hash and sorted inside them. Before that, hashes that a run has already seen in enough documents are merge-anti-joined away: later
batches have smaller ids, so neither that they are shared nor which document keeps them can change. What is left is added as a run
of its own. Two runs on a level are compacted into one on the next, so there are about log2(batches) runs, and each hash is rewritten
about as often. Runs have the same buckets, so joins between them and the next batch's counts don't deal the runs out again.

In the end the runs are compacted into one, which says of each shared line how it is decided. Lines of documents meet it by their hashes
alone (hot ones are what Spark's skew join splits); texts are read twice and dealt out once, by the document.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import WHITE, materialise, scratch_dir

#: Code points of a key, and documents that hold it, from which on its lines are dropped.
MIN_CHARS, MIN_DOCS = 40, 5
BATCHES = 4
#: Runs on a level that are compacted into one of the next.
FANOUT = 2
SEEDS = (20250117, 20250118)
HASH = ["h", "g"]
ROW = ["r", "q"]


class LineRuns:
    """Levels of sorted runs (h, g, n: documents, top: the largest id among them), each a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[DataFrame]] = []

    def _written(self, run: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = run.select(*HASH, "n", "top").repartition(self.buckets, *HASH)
        dealt.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", scratch_dir(self.spark, "run")).saveAsTable(name)
        return self.spark.table(name)

    def unsettled(self, counted: DataFrame) -> DataFrame:
        """``counted`` without hashes that a run has seen in enough documents."""
        for run in (r for level in self.levels for r in level):
            counted = counted.join(run.where(F.col("n") >= self.min_docs).select(*HASH), HASH, "left_anti")
        return counted

    def add(self, counted: DataFrame) -> None:
        """Add a batch's counts, one row per hash. Its ids are smaller than those of the batches before."""
        run, level = self._written(self.unsettled(counted)), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FANOUT:
                return
            run, self.levels[level] = self._written(self._merged(self.levels[level])), []
            level += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            a, b = out.alias("a"), run.alias("b")
            both = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
            out = a.join(b, HASH, "full_outer").select(*HASH, both.alias("n"), F.greatest("a.top", "b.top").alias("top"))
        return out

    def compacted(self) -> DataFrame | None:
        """All runs as one; none without batches."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else None


def line_key(line: Column) -> Column:
    """``line`` without white space at its ends, A-Z in lower case. Where all is ASCII, ``lower`` does the same faster."""
    plain = F.octet_length(line) == F.length(line)
    return F.btrim(F.when(plain, F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase)), F.lit(WHITE))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column, at: Column, min_chars: int) -> Column:
    """A line's place and the two hashes of its key; null if that is too short."""
    return F.when(F.length(key) >= min_chars, F.struct(at.alias("at"), *[F.xxhash64(F.lit(s), key).alias(c) for s, c in zip(SEEDS, HASH, strict=True)]))


def _row(id_col: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(s), id_col, text).alias(c) for s, c in zip(SEEDS, ROW, strict=True)]


def repeated_lines(rows: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Of ``rows`` (id, text): r, q (hashes of id and text) and ``drop``, the places of lines that go, of rows that lose any."""
    spark = rows.sparkSession
    bounds = rows.agg(F.percentile_approx("id", [k / batches for k in range(batches - 1, 0, -1)])).head()[0] or []
    batch = F.lit(0)
    for bound in dict.fromkeys(bounds):
        batch = batch + F.coalesce((F.col("id") < F.lit(bound)).cast("int"), F.lit(1))
    hashes = F.filter(F.transform(F.transform(_lines(F.col("text")), line_key), lambda k, i: _hash(k, i, min_chars)), lambda x: x.isNotNull())
    held = rows.select("id", *_row(F.col("id"), F.col("text")), hashes.alias("x"), batch.alias("batch")).where(F.size("x") > 0)
    path = scratch_dir(spark, "lines")
    held.write.partitionBy("batch").parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    lines = held.select("id", *ROW, F.explode("x").alias("x"), "batch").select("id", *ROW, "x.*", "batch")
    runs = LineRuns(spark, min_docs)
    for k in range(len(set(bounds)) + 1):
        one = lines.where(F.col("batch") == k).groupBy(*HASH, "id").agg(F.count("*"))  # documents may repeat a line, and rows an id
        runs.add(one.groupBy(*HASH).agg(F.count("*").alias("n"), F.max("id").alias("top")))
    shared = materialise(runs.compacted().where(F.col("n") >= min_docs).select(*HASH, "top"), "shared")
    gone = lines.join(shared, HASH).where(~F.col("id").eqNullSafe(F.col("top")))
    return gone.groupBy(*ROW).agg(F.collect_set("at").alias("drop"))


def _decided(docs: DataFrame, id_col: str, text_col: str, **limits: int) -> DataFrame:
    """``docs`` with all lines (``lines``) and those kept (``kept``) beside the row (``row``); ``kept`` is null where all are."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    gone = repeated_lines(rows, **limits)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumns(dict(zip(ROW, _row(F.col("id"), F.col("text")), strict=True)))
    # as a generator's result the lines are split once, not for every place that is looked up
    found = whole.join(gone, ROW, "left").select("row", "id", "text", "drop", F.inline(F.array(F.struct(_lines(F.col("text")).alias("lines")))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return found.withColumn("kept", F.when(F.col("drop").isNotNull(), F.transform(stay, lambda i: F.get("lines", i))))


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """Per row its id, ``n_lines``, ``n_dropped`` and ``kept_sha256``, the digest of the lines that stay, joined by ``\\n``.

    Lines whose key (without white space at its ends, A-Z in lower case) has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents go from all documents but the one of the largest id among these, which keeps all of them. Rows of one
    id are one document; null ids are one too, smaller than any other. Ids are numbers. Null and empty texts are one empty line; whole
    texts are read, however long. Repeated rows have the same result each; further columns aren't read, whatever their names; an
    empty table gives an empty table.
    """
    found = _decided(docs.select(id_col, text_col), id_col, text_col, **limits)
    text = F.when(F.col("kept").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.concat_ws("\n", "kept"))
    n = F.size("lines").cast("long")
    return found.select(F.col("id").alias(id_col), n.alias("n_lines"), F.coalesce(n - F.size("kept"), F.lit(0).cast("long")).alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``docs`` with all rows and columns and without the lines that ``line_report`` drops; null texts stay null."""
    found = _decided(docs, id_col, text_col, **limits)
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "kept"))
    return found.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
