"""WARC archives of pages: writing with revisits, and reading by boundary-chain verification (operator 4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.session import new_run_folder
from forgeline.sources.tables import settle

MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
LEAST_REVISIT = 1000  # bytes of a payload from which copies become revisits

# Header names of the format, and two of our own for what a revisit doesn't carry.
TYPE, ID, URI, DIGEST = "WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest"
REFERS, PROFILE, CONTENT, LENGTH = "WARC-Refers-To", "WARC-Profile", "Content-Type", "Content-Length"
PAGE, PAYLOAD_LENGTH = "X-Page-Id", "X-Payload-Length"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def with_types(pages: DataFrame, key: str, html: str, least: int) -> DataFrame:
    """Pages with digest, size, and whether they revisit a page of equal payload.

    Only digests of payloads that occur more than once are joined back; they combine before
    the shuffle, however many copies one has.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    sized = pages.withColumn("_size", F.octet_length(body).cast("bigint")).withColumn(
        "_digest", F.sha1(body.cast("binary"))
    )
    copied = (
        sized.filter(F.col("_size") >= least)
        .groupBy(F.col("_digest").alias("_same"))
        .agg(F.max(key).alias("_keeper"), F.count("*").alias("_copies"))
        .filter("_copies > 1")
        .drop("_copies")
    )
    other = F.col("_keeper").isNotNull() & ~F.col(key).eqNullSafe(F.col("_keeper"))
    return (
        sized.join(copied, F.col("_digest") == F.col("_same"), "left")
        .withColumn("_refers", F.when(other & (F.col("_size") >= least), F.col("_keeper")))
        .drop("_same", "_keeper")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = LEAST_REVISIT,
    compression: str = "gzip",
) -> None:
    """One record per page, a file per task; a page whose payload another has becomes a revisit."""
    typed = with_types(pages.select(key, url, html), key, html, least)
    number, refers = F.col(key).cast("string"), F.col("_refers").cast("string")
    revisit = F.col("_refers").isNotNull()
    block = F.when(revisit, "").otherwise(F.coalesce(F.col(html), F.lit("")))
    record = F.concat(
        F.lit(MAGIC),
        _field(TYPE, F.when(revisit, "revisit").otherwise("response")),
        _field(ID, F.concat(F.lit("<urn:page:"), F.coalesce(number, F.lit("")), F.lit(">"))),
        _field(PAGE, number),
        _field(PAYLOAD_LENGTH, F.col("_size").cast("string")),
        _field(DIGEST, F.concat(F.lit("sha1:"), F.col("_digest"))),
        _field(REFERS, F.concat(F.lit("<urn:page:"), refers, F.lit(">"))),
        _field(PROFILE, F.when(revisit, SAME_PAYLOAD)),
        _field(CONTENT, F.lit("text/html; charset=utf-8")),
        _field(URI, F.regexp_replace(url, "[\\r\\n]+", " ")),
        F.lit(f"{LENGTH}: "),
        F.octet_length(block).cast("string"),
        F.lit(BREAK),
        block,
    )
    typed.select(record.alias("value")).write.option("lineSep", BREAK).option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between marks, with file and order; Spark splits the files at the mark itself."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("at"),
        "value",
    )


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r\n]*)", 1)


def candidates(pieces: DataFrame) -> DataFrame:
    """Every mark as a candidate record: bytes of its piece, bytes its header asks for, header fields.

    The digest is taken here where the piece holds the whole record, so payloads aren't moved.
    """
    head = F.substring_index("value", BREAK, 1)
    step = pieces.withColumn("head", head).withColumn("bytes", F.octet_length("value").cast("bigint"))
    head_bytes = F.octet_length("head").cast("bigint") + len(BREAK)
    step = step.withColumn("start", F.when(head_bytes <= F.col("bytes"), head_bytes)).withColumn(
        "content", F.regexp_extract("head", rf"(?:^|\n){LENGTH}: (\d{{1,18}})\r?$", 1).try_cast("bigint")
    )
    needs = F.col("start") + F.col("content") + len(BREAK)
    whole = needs == F.col("bytes")
    payload = F.substring(F.col("value").cast("binary"), (F.col("start") + 1).cast("int"), F.col("content").cast("int"))
    return step.select(
        "file",
        "at",
        "bytes",
        needs.alias("needs"),
        "start",
        "content",
        _header(TYPE).alias("type"),
        _header(PAGE).alias("page"),
        _header(URI).alias("uri"),
        _header(PAYLOAD_LENGTH).alias("payload_length"),
        F.regexp_extract(_header(DIGEST), "sha1:(\\w+)", 1).alias("declared"),
        F.regexp_extract(_header(REFERS), "<urn:page:(.*)>", 1).alias("refers"),
        F.when(whole, F.sha1(payload)).alias("digest"),
    )


def reachable(size: np.ndarray, needs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all candidates of a file, and which of them a chain from the start reaches.

    ``size`` has the bytes of each piece in order, the first being what stands before the first
    mark; ``needs`` the bytes of record after the mark, or -1. Pointer jumping: a candidate
    knows its successor, and all know in each round who is twice as far.
    """
    mark = len(MAGIC)
    offset = np.cumsum(size + mark) - size - 2 * mark
    end = int(offset[-1] + mark + size[-1])
    n = len(size)
    target = np.where(needs >= 0, offset + mark + needs, -1)
    place = np.searchsorted(offset[1:], target) + 1
    hits = (place < n) & (offset[np.minimum(place, n - 1)] == target)
    jump = np.append(np.where(hits & (np.arange(n) > 0), place, n), n)
    found = np.zeros(n + 1, bool)
    if n > 1 and size[0] == 0:
        found[1] = True
    while True:
        more = found.copy()
        more[jump[found]] = True
        jump = jump[jump]
        if (more == found).all():
            break
        found = more
    found = found[:n]
    # a record that runs past the end of the file is cut off
    return offset, found & (target <= end) & (target >= 0)


def chained(found: DataFrame) -> DataFrame:
    """(file, at, offset, owner): pieces of true records, ``owner`` being the piece the record starts with."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = table["at"].combine_chunks().field("block").to_numpy()
        row = table["at"].combine_chunks().field("row").to_numpy()
        order = np.lexsort((row, block))
        size = table["bytes"].to_numpy()[order]
        needs = table["needs"].fill_null(-1).to_numpy()[order]
        offset, true = reachable(size, needs)
        # later pieces that belong to the record before them
        owner = np.maximum.accumulate(np.where(true, np.arange(len(size)), -1))
        last = offset + len(MAGIC) + needs
        inside = (owner >= 0) & (offset < np.where(owner >= 0, last[owner], 0))
        keep = order[inside]
        return pa.table(
            {
                "file": table["file"].take(pa.array(keep)),
                "at": table["at"].take(pa.array(keep)),
                "offset": pa.array(offset[inside]),
                "owner": table["at"].take(pa.array(order[owner[inside]])),
            }
        )

    at = "struct<block:bigint,row:bigint>"
    return (
        found.select("file", "at", "bytes", "needs")
        .groupBy("file")
        .applyInArrow(run, f"file string, at {at}, offset bigint, owner {at}")
    )


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of WARC files: file, offset, type, page, uri, payload length and digest, what they refer to.

    Spark splits the files at the record mark, so a file may be read by many tasks. Each piece
    is a candidate with the offset of its successor by its own header; only candidates that the
    chain from the start of the file reaches are records, so marks inside payloads are not.
    Offsets are of the uncompressed file. A payload that contains marks lies in several
    pieces, which are read again and put together. With ``payloads`` that is done for all. A
    record that the end of its file cuts off is left out, and what follows a broken record
    isn't reached. An empty folder of files gives no rows.
    """
    pieces = _pieces(spark, path)
    found = settle(candidates(pieces), "warc-candidates")
    chain = settle(chained(found), "warc-chain")
    records = chain.filter(F.col("at") == F.col("owner")).drop("owner").join(found, ["file", "at"])
    parts = chain if payloads else chain.join(
        found.filter(F.col("digest").isNull()).select("file", F.col("at").alias("owner")), ["file", "owner"]
    )
    parts = settle(parts.select("file", "at", "owner"), "warc-parts")
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC
    )
    joined = (
        pieces.join(parts, ["file", "at"])
        .groupBy("file", "owner")
        .agg(text.alias("text"))
        .join(found.select("file", F.col("at").alias("owner"), "start", "content"), ["file", "owner"])
        .withColumn(
            "payload",
            F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), F.col("content").cast("int")),
        )
        .select("file", F.col("owner").alias("at"), F.sha1("payload").alias("joined_digest"), "payload")
    )
    if not payloads:
        joined = joined.drop("payload")
    revisit = F.col("type") == "revisit"
    return records.join(joined, ["file", "at"], "left").select(
        "file",
        "offset",
        "type",
        F.col("page").try_cast("bigint").alias("page"),
        "uri",
        F.when(revisit, F.col("payload_length").try_cast("bigint")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(revisit, F.col("declared"))
        .otherwise(F.coalesce("digest", "joined_digest"))
        .alias("payload_digest"),
        F.when(revisit, F.col("refers").try_cast("bigint")).alias("refers_to"),
        *(["payload"] if payloads else []),
    )


def round_trip(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT
) -> DataFrame:
    """Write a record per page and read the archives back.

    Of pages with equal payloads of ``least`` bytes or more the largest key is the response and
    the others revisit it; rows that repeat that key are responses too. Null or empty pages have
    an empty payload. Null urls have no target header. Null keys stay null; with a copy that has
    one they revisit it. An empty table gives no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    path = new_run_folder(spark, "warc")
    write_archives(pages, path, key, url, html, least)
    records = read_archives(spark, path)
    return records.select(
        F.col("page").alias(key),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        "refers_to",
        "offset",
    )
