"""WARC archives: written from pages, read back along verified record boundaries.

Writing. A record is a header, an empty line, the payload and two line ends; rows are written as text with the two
line ends as row separator, so that each part file is a WARC file in any store that Spark writes to. Of equal payloads
only the one with the largest page_id is stored (response), the others refer to it (revisit).

Reading. The magic `WARC/1.1` may also stand in a payload, so cutting files at it yields candidates only. Tasks read
ranges of files, and emit for each candidate its offset and the offset of its successor, which its Content-Length
gives. Candidates whose successors are their neighbours form runs; the last successor of a run points into another run
or nowhere. Pointer jumping from offset 0 over the runs keeps those that the chain of records reaches; what it does not
reach lay inside a payload. Only offsets and lengths are shuffled; digests are made in the scan that reads the payload.
Payloads that hold the magic are put together again from their pieces in a second read of their files.

Defined cases: a null html is an empty payload; a null page_id is smaller than any other, and its record has no number;
rows that repeat a page_id each get a record, all of them responses if it is the largest of its payload; payloads below
`least` bytes are always responses; line ends and controls in a url are written as %XX; payloads may hold any text, the
magic and whole records too; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import cut, new_path

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
#: Groups of equal payloads that are broadcast at most (some 50 bytes each); beyond, they are joined by a shuffle.
MAX_BROADCAST = 200_000


def base32_sha1(data: Column) -> Column:
    """RFC 4648 base32 of the SHA-1, upper-case: four times ten hex digits are eight base-32 digits each."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """pages (page_id, url, html) -> archives under path."""
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html").cast("binary"))})
    groups = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("id").alias("to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "to")
    groups = cut(groups, "equal_payloads")
    if groups.count() <= MAX_BROADCAST:
        groups = F.broadcast(groups)
    rows = rows.join(groups, (F.col("digest") == F.col("same")) & (F.col("bytes") >= least), "left")
    again = F.col("same").isNotNull() & ~F.col("id").eqNullSafe(F.col("to"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = [
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number("id"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), number("to"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, 0).otherwise(F.col("bytes")).cast("string")),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *head), F.lit(GAP), F.when(again, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, seq, value): what stands between two magics; at and seq put the pieces of a file in order."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"), "value")


def _placed(pieces: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """pieces (file, at, seq, n, ...) with o, where the magic before each stands in its file; with `marks` (file, at, o,
    own) also `carried`, the own of the last mark in the splits before.

    Sizes are summed for each split, and only these sums over the file: however large a file is, no task sorts more of
    it than a split holds.
    """
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("n") + len(MAGIC)
    sums, kept = pieces.groupBy("file", "at").agg(F.sum(size).alias("split_size")), ["file", "at", "base"]
    # Sums and marks may come from other scans: what they don't agree on must not be placed somewhere else.
    known = lambda c: F.coalesce(c, F.raise_error(F.lit("the splits of an archive changed while it was read")).cast("long"))
    if marks is not None:
        sums, kept = sums.join(marks.groupBy("file", "at").agg(F.max_by("own", "o").alias("mark")), ["file", "at"], "full"), [*kept, "carried"]
        sums = sums.withColumn("carried", F.last("mark", ignorenulls=True).over(before))
    sums = sums.withColumn("base", F.coalesce(F.sum(known(F.col("split_size"))).over(before), F.lit(0))).select(kept)
    within = F.sum(size).over(Window.partitionBy("file", "at").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return pieces.join(sums, ["file", "at"], "left").withColumn("o", known(F.col("base")) + F.coalesce(within, F.lit(0)) - len(MAGIC)).drop("base")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, o, succ, head, h, size, whole, digest): every magic that a plausible header follows, its successor's
    offset, and where the split begins that it was read from."""
    head = F.substring_index("value", GAP, 1)
    rows = _pieces(spark, path).withColumns({"n": F.octet_length("value").cast("long"), "head": head, "h": F.octet_length(head).cast("long")})
    rows = rows.withColumn("size", F.expr("try_cast(regexp_extract(head, '(?i)(?:^|\\\\r\\\\n)Content-Length:[ \\\\t]*([0-9]{1,18})[ \\\\t]*(?:\\\\r\\\\n|$)', 1) as bigint)"))
    whole = F.coalesce(F.col("n") == F.col("h") + 4 + F.col("size") + 4, F.lit(False))
    block = F.when(whole, base32_sha1(F.expr("substring(cast(value as binary), cast(h + 5 as int), cast(size as int))")))
    rows = rows.select("file", "at", "seq", "n", F.when(F.col("size").isNotNull() & (F.col("n") >= F.col("h") + 4), F.col("head")).alias("head"), "h", "size", whole.alias("whole"), block.alias("digest"))
    rows = _placed(cut(rows, "pieces"))
    return rows.where("head is not null and o >= 0").select("file", "at", "o", (F.col("o") + len(MAGIC) + F.col("h") + 4 + F.col("size") + 4).alias("succ"), "head", "h", "size", "whole", "digest")


def reachable(nodes: DataFrame) -> DataFrame:
    """nodes (file, at, o, succ, ...) -> those on the chain that starts at offset 0 of their file.

    A run ends with its split at the latest, so that no task sorts a whole file; its number is its first offset.
    """
    w = Window.partitionBy("file", "at").orderBy("o")
    first = F.when(F.coalesce(F.lag("succ").over(w) != F.col("o"), F.lit(True)), F.col("o"))
    run = F.last("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nodes = cut(nodes.withColumn("first", first).withColumn("run", run).drop("first"), "candidates")
    ends = nodes.groupBy("file", "run").agg(F.max_by("succ", "o").alias("o"))
    jumps = cut(ends.join(nodes.select("file", "o", F.col("run").alias("to_run")), ["file", "o"]).select("file", "run", "to_run", F.col("o").alias("to_o")), "jumps")
    reached = nodes.where("o = 0").select("file", "run", F.col("o").alias("entry"))
    while not jumps.isEmpty():  # each round doubles the jump; offsets only grow, so jumps run out
        new = reached.join(jumps, ["file", "run"]).select("file", F.col("to_run").alias("run"), F.col("to_o").alias("entry"))
        reached = cut(reached.union(new).groupBy("file", "run").agg(F.min("entry").alias("entry")), "reached")
        on = jumps.select("file", F.col("run").alias("to_run"), F.col("to_run").alias("next"), F.col("to_o").alias("next_o"))
        jumps = cut(jumps.join(on, ["file", "to_run"]).select("file", "run", F.col("next").alias("to_run"), F.col("next_o").alias("to_o")), "jumps")
    return nodes.join(reached, ["file", "run"]).where("o >= entry").drop("run", "entry")


def _joined_payloads(spark: SparkSession, path: str, spanning: DataFrame) -> DataFrame:
    """Digests of payloads that hold the magic: (file, o, digest)."""
    marks = spanning.select("file", "at", "o", F.struct("o", "succ", "h", "size").alias("own"))
    pieces = _pieces(spark, path).join(marks.select("file").distinct(), "file", "left_semi").withColumn("n", F.octet_length("value").cast("long"))
    # The record that a piece belongs to began in the same split, or is the last that began before it.
    owned = _placed(pieces, marks).join(marks.drop("at"), ["file", "o"], "left")
    last = Window.partitionBy("file", "at").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    owned = owned.withColumn("own", F.coalesce(F.last("own", ignorenulls=True).over(last), F.col("carried"))).where("o < own.succ")
    record = owned.groupBy("file", "own").agg(F.sort_array(F.collect_list(F.struct("o", "value"))).alias("parts"))  # one record
    text = F.array_join(F.col("parts.value"), MAGIC).cast("binary")
    return record.select("file", F.col("own.o").alias("o"), text.alias("text"), F.col("own.h").alias("h"), F.col("own.size").alias("size")).select(
        "file", "o", base32_sha1(F.expr("substring(text, cast(h + 5 as int), cast(size as int))")).alias("joined")
    )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Archives under path -> (page_id, payload_bytes, payload_digest, record_type, refers_to, verified)."""
    records = cut(reachable(candidates(spark, path)), "records")
    spanning = records.where("not whole")
    if not spanning.isEmpty():
        records = records.join(_joined_payloads(spark, path, spanning), ["file", "o"], "left").withColumn("digest", F.coalesce("digest", "joined"))
    field = lambda name, form: F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*{form}[ \t]*(?:\r\n|$)", 1)
    number = lambda text: F.when(text != "", text).cast("long")
    told = field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")
    kind = field("WARC-Type", "([a-z]+)")
    revisit = kind == "revisit"
    return records.select(
        number(field("WARC-Record-ID", "<urn:page:(-?[0-9]*)>")).alias("page_id"),
        F.when(revisit, number(field("WARC-Payload-Length", "([0-9]+)"))).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, told).otherwise(F.col("digest")).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(revisit, number(field("WARC-Refers-To", "<urn:page:(-?[0-9]*)>"))).alias("refers_to"),
        (revisit | (told == F.col("digest"))).alias("verified"),
    )


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least)
    return read_back(spark, path)
