"""WARC archives, written and read in parallel.

Files are read in splits, at every occurrence of the magic line, so any task may start anywhere. Each occurrence is only a
candidate: its header names its length and so the offset of its successor. Where a candidate's successor is the next
candidate, both are in one run. From the run that holds a file's start, pointer jumping over the runs finds which are
reached, and from where; what isn't reached is the inside of a payload. Payloads that hold the magic line are put
together from their pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thalweg.llm.common import join_groups, materialise, scratch_dir

MAGIC, GAP = "WARC/1.0\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Up to so many digests of repeated payloads (about 50 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary."""
    h = F.sha1(data)
    parts = []
    for k in range(4):
        forty = F.conv(F.substring(h, 1 + 10 * k, 10), 16, 10).cast("long")
        parts += [F.substr(F.lit(BASE32), F.shiftright(forty, s).bitwiseAND(31).cast("int") + 1, F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*parts)


def _uuid(x: Column) -> Column:
    h = F.md5(x)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def record_id(page: Column, digest: Column) -> Column:
    return _uuid(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), digest))


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Write a record per row to text files under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest id are responses and the others
    revisits of it, without a payload of their own; all other rows are responses. Null html is an empty payload; a row
    without an id is a revisit if any row with its payload has one.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    digest = base32_sha1(payload.cast("binary"))
    size = F.octet_length(payload)
    copies = pages.where(size >= least_bytes).select(digest.alias("d"), F.col(id_col).alias("i")).groupBy("d").agg(F.max("i").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    copies = materialise(copies, "copies")
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), payload.alias("p"), digest.alias("d"))
    if copies.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(copies.select("d", "top")), "d", "left")
    else:
        rows = join_groups(rows, copies, "d", "n")
    again = F.col("top").isNotNull() & (size_of("p") >= least_bytes) & ~F.coalesce(F.col("i") == F.col("top"), F.lit(False))
    line = lambda name, x: F.coalesce(F.concat(F.lit(f"{name}: "), x, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size_of("p").cast("string"), F.lit(GAP))
    block = F.when(again, http).otherwise(F.concat(http, F.col("p")))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("i"), F.col("d"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("u", r"[\x00-\x20\x7F]", "%20")),
        line("X-Page-ID", F.col("i").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("d"))),
        F.when(again, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(""),
        F.when(again, line("WARC-Refers-To", record_id(F.col("top"), F.col("d")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.col("n").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    rows.withColumn("block", block).withColumn("n", F.octet_length("block")).select(record.alias("value")).write.option("lineSep", GAP).text(path)


def size_of(c: str) -> Column:
    return F.octet_length(c)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magic lines, with its file, the split that read it, and its order there."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"))


def _block(value: Column, head: Column, length: Column) -> dict[str, Column]:
    """The payload in a record's block: its binary, after the HTTP header."""
    gap = F.locate(GAP, F.decode(F.substr(value, head + 1, F.least(length, F.lit(65536)).cast("int")), "ISO-8859-1"))
    http = F.when(gap > 0, gap + 3).otherwise(0)
    return {"payload": F.substr(value, head + http + 1, (length - http).cast("int"))}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: ``file``, ``start``, ``type``, ``record_id``, ``page_id`` (string), ``refers_to``, ``digest``,
    ``payload_bytes`` and ``payload_digest`` (both of the payload as it stands there). Only lengths and offsets decide
    what is a record; magic lines inside payloads do not."""
    chunks = _chunks(spark, path)
    binary = F.col("value").cast("binary")
    gap = F.locate(GAP, F.col("value"))
    header = F.when(gap > 0, F.concat(F.lit("\r\n"), F.substr(F.col("value"), F.lit(1), gap - 1), F.lit("\r\n")))
    field = lambda name: F.nullif(F.regexp_extract(header, rf"(?i)\r\n{name}: *([^\r\n]*)", 1), F.lit(""))
    named = chunks.select(
        "file", "split", "seq", "value",
        F.octet_length("value").cast("long").alias("bytes"),
        F.when(gap > 0, F.octet_length(F.substr(F.col("value"), F.lit(1), gap - 1)) + 4).alias("head"),
        F.nullif(F.regexp_extract(header, r"(?i)\r\nContent-Length: *(\d{1,15})\r\n", 1), F.lit("")).cast("long").alias("length"),
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"), field("X-Page-ID").alias("page_id"),
        field("WARC-Refers-To").alias("refers_to"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
    )
    whole = F.col("head") + F.col("length") + 4 <= F.col("bytes")
    inner = _block(binary, F.col("head"), F.col("length"))["payload"]
    named = named.withColumn("payload", F.when(whole, inner)).select(
        *[c for c in named.columns if c != "value"], F.coalesce(whole, F.lit(False)).alias("whole"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(whole, base32_sha1(F.col("payload"))).alias("payload_digest")
    )
    thin = materialise(named, "candidates")
    # absolute offsets: sums within a split, and of the splits before it
    in_split = Window.partitionBy("file", "split").orderBy("seq")
    before = F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = thin.groupBy("file", "split").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("t"))
    base = splits.select("file", "split", F.coalesce(F.sum("t").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = thin.withColumn("before", before).join(base, ["file", "split"]).withColumn("start", F.col("base") + F.col("before") - len(MAGIC)).where("start >= 0").drop("base", "before")
    placed = placed.withColumn("next", F.col("start") + len(MAGIC) + F.col("head") + F.col("length") + len(GAP))
    by = Window.partitionBy("file", "split").orderBy("start")
    begins = F.when(F.coalesce(F.lag("next").over(by) == F.col("start"), F.lit(False)), F.lit(None)).otherwise(F.col("start"))
    placed = materialise(placed.withColumn("b", begins).withColumn("run", F.last("b", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("b"), "placed")
    runs = placed.groupBy("file", "run").agg(F.max_by("next", "start").alias("exit"))
    heads = placed.select("file", F.col("start").alias("exit"), F.col("run").alias("to"))
    # a run's pointer: the run that its last record leads into, and where it enters it
    jump = materialise(runs.join(heads, ["file", "exit"]).select("file", "run", "to", F.col("exit").alias("entry")), "pointers")
    reached = placed.where("start = 0").select("file", "run", F.lit(0).cast("long").alias("entry"))
    known = -1
    while True:
        reached = materialise(reached, "reached")
        count = reached.count()
        if count == known:
            break
        known = count
        step = reached.select("file", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reached = reached.unionByName(step).groupBy("file", "run").agg(F.min("entry").alias("entry"))
        second = jump.select("file", F.col("run").alias("to"), F.col("to").alias("far"), F.col("entry").alias("last"))
        jump = materialise(jump.join(second, ["file", "to"]).select("file", "run", F.col("far").alias("to"), F.col("last").alias("entry")), "pointers")
    marked = placed.join(reached, ["file", "run"], "left").withColumn("real", F.coalesce(F.col("start") >= F.col("entry"), F.lit(False)) & F.col("next").isNotNull())
    marked = materialise(marked, "marked")
    columns = ["file", "start", "type", "record_id", "page_id", "refers_to", "digest", "payload_bytes", "payload_digest"]
    done = marked.where("real and whole").select(*columns)
    if marked.where("real and not whole").isEmpty():
        return done
    # records whose payload holds the magic line: pieces up to the next real record
    last = F.last(F.when(F.col("real"), F.col("start")), ignorenulls=True)
    tops = marked.groupBy("file", "split").agg(F.max(F.when(F.col("real"), F.col("start"))).alias("top"))
    carry = tops.select("file", "split", F.last("top", ignorenulls=True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    owned = marked.withColumn("own", last.over(by.rowsBetween(Window.unboundedPreceding, 0))).join(carry, ["file", "split"]).withColumn("own", F.coalesce("own", "carry")).where("not real or not whole")
    owners = marked.where("real and not whole").select("file", F.col("start").alias("own"))
    # a chunk is known by its number within its split, which no packing of splits into tasks changes
    first = thin.groupBy("file", "split").agg(F.min("seq").alias("base"))
    pieces = owned.join(owners, ["file", "own"]).join(first, ["file", "split"]).select("file", "split", (F.col("seq") - F.col("base")).alias("nth"), "start", "own")
    chunks = _chunks(spark, path)
    begins = chunks.groupBy("file", "split").agg(F.min("seq").alias("base"))
    texts = chunks.join(begins, ["file", "split"]).withColumn("nth", F.col("seq") - F.col("base")).join(materialise(pieces, "pieces"), ["file", "split", "nth"]).select("file", "own", F.struct("start", F.col("value").cast("binary").alias("value")).alias("x"))
    joined = texts.groupBy("file", "own").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    magic = F.lit(MAGIC).cast("binary")
    whole_text = F.aggregate(F.slice("xs", 2, 1 << 30), F.get(F.col("xs"), 0)["value"], lambda s, x: F.concat(s, magic, x["value"]))
    more = joined.withColumn("v", whole_text).join(marked.where("real and not whole").withColumnRenamed("start", "own"), ["file", "own"])
    more = more.withColumn("payload", _block(F.col("v"), F.col("head"), F.col("length"))["payload"]).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    return done.unionByName(more.withColumnRenamed("own", "start").select(*columns))


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the archives (to a fresh shared folder unless ``path`` is given), read them back, and return per record its id,
    ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` (the response's id for revisits, else null).

    A revisit's payload is that of the record it refers to. A null html is an empty payload; long ones are whole; null ids and
    urls are left out of the headers. Rows with the same id and payload are records of their own;
    an empty table gives an empty table; further columns are dropped, whatever their names.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    path = path or scratch_dir(spark, "warc")
    write_warc(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes)
    found = materialise(read_warc(spark, path), "records")
    first = found.where("type = 'response'")
    own = first.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    again = found.where("type = 'revisit'").select(F.col("page_id").alias("p"), F.col("refers_to").alias("r"), "digest")
    counts = again.groupBy("r").agg(F.count("*").alias("n"))
    targets = counts.join(first.select(F.col("record_id").alias("r"), F.col("page_id").alias("t"), "payload_bytes").distinct(), "r")
    later = join_groups(again, materialise(targets, "targets"), "r", "n")
    later = later.select(F.col("p").cast(kind).alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("t").cast(kind).alias("refers_to"))
    return own.unionByName(later)
