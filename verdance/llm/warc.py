"""Content-addressed WARC archive.

Three tables in a shared folder make the archive: `payloads` holds every distinct payload's bytes once under its
SHA-256, `headers` holds the exact header block of every record with the digest of its payload, and records are
restored by joining the two. The digest is verified when storing: all payloads of one digest must agree on length
and on two unrelated checksums, and again when reading, by recomputing it from the stored bytes.

Among records of equal payload (of at least `revisit_min` bytes) that with the smallest id is the response, the
others revisit it. A null payload counts as empty; null URLs are written as an empty URI; rows with a null id sort
last. Repeated ids with equal payloads give repeated records; the second is a revisit of the same id (in the order of
URLs; which of rows equal in all three is the response cannot be told). Line ends in a URL are written as %0D and
%0A, and ids are percent-encoded, so every header keeps to its line, whatever they hold. Other columns are ignored.

Records follow WARC/1.1: date, type, id, target, both digests; a response's block is an HTTP answer (its head is the same for all
records and stands with the exact headers), a revisit's is that head alone, with the profile of equal payload digests.
Repeated ids give records of one WARC-Record-ID.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
# Fixed values of the format: the head of an answer, and the profile of a revisit.
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z"


def base32_sha1(raw: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 40 hex digits in eight groups of 20 bits, each four letters."""
    digest = F.sha1(raw)
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.lit(ALPHABET).substr((F.shiftright(bits, shift).bitwiseAND(31) + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", revisit_min: int = 0, date: str | None = None) -> None:
    """Write `pages` (id, url, html) as an archive under path. date: of all records (UTC, as in 2024-05-01T12:00:00Z), by default now. Pages are hashed in one pass; payloads are shuffled once, without copies in the same task."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    if not re.fullmatch(DATE, date):
        raise ValueError(f"{date!r} is no date of this format")
    raw = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(id_col).alias("record_id"), url.alias("url"), raw.alias("payload"))
    head = F.lit(bytearray(HTTP_HEAD.encode()))
    facts = rows.select(
        "record_id", "url", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), base32_sha1(F.concat(head, F.col("payload"))).alias("block"), F.octet_length("payload").cast("long").alias("n"),
        F.xxhash64("payload").alias("x"), F.crc32("payload").alias("c"), F.monotonically_increasing_id().alias("serial"),
    )
    light = written(facts, "warc-records")  # one row a page, without its payload; serials are fixed from here on
    check = F.struct("n", "x", "c", "sha1")
    place = F.struct(F.col("record_id").isNull().alias("unnamed"), "record_id", "url", "serial")
    # partial minima in every task: a payload that a third of all pages share arrives as one row a task
    first = light.groupBy("digest").agg(F.min(place).alias("first"), F.min(check).alias("lo"), F.max(check).alias("hi"))
    sure = F.when(F.col("lo") == F.col("hi"), F.col("first.serial")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("long"))
    # written, so that the join below has plain exchanges on both sides, whose hot digests adaptive execution may split
    first = written(first.select(F.col("digest").alias("of"), F.col("first.record_id").alias("first_id"), sure.alias("first_serial")), "warc-first", compact=True)
    named = light.join(first, F.col("digest") == F.col("of"))
    kind = F.when((F.col("n") < revisit_min) | (F.col("serial") == F.col("first_serial")), "response").otherwise("revisit")
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(c.cast("string")), F.lit("")), F.lit(">"))
    is_response = kind == "response"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisits = F.concat(line("WARC-Refers-To", uri(F.col("first_id"))), line("WARC-Profile", F.lit(PROFILE)))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", uri(F.col("record_id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(is_response, F.col("block")).otherwise(base32_sha1(head)))), F.when(is_response, "").otherwise(revisits),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", (F.lit(len(HTTP_HEAD)) + F.when(is_response, F.col("n")).otherwise(0)).cast("string")), F.lit(CRLF + HTTP_HEAD),
    )
    named.select("record_id", F.encode(header, "utf-8").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")
    # all payloads of a digest are the same bytes (verified above), so a task sends on one of each, and one is stored
    rows.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(header: Column, name: str) -> Column:
    """A header's value, from the line that begins with its name: other lines may hold anything."""
    found = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found == "", None).otherwise(found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record's parsed header, and length and digests recomputed from the stored payload (joined by digest, without its bytes)."""
    payloads = spark.read.parquet(f"{path}/payloads")
    facts = payloads.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), (F.sha2("payload", 256) == F.col("digest")).alias("intact"))
    head = spark.read.parquet(f"{path}/headers").withColumn("text", F.decode("header", "utf-8"))
    ident = lambda name: F.url_decode(F.regexp_extract(_field(F.col("text"), name), "<urn:page:(.*)>", 1))
    parsed = head.select(
        "digest", ident("WARC-Record-ID").alias("record"), _field(F.col("text"), "WARC-Type").alias("record_type"),
        ident("WARC-Refers-To").alias("refers"), F.regexp_replace(_field(F.col("text"), "WARC-Payload-Digest"), "^sha1:", "").alias("stated"),
    )
    sound = F.col("intact") & (F.col("stated") == F.col("payload_digest"))
    return parsed.join(facts, "digest").withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload is damaged"))))


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The original records, byte for byte: header block with the answer's head, payload (none in a revisit), two line ends."""
    head = spark.read.parquet(f"{path}/headers").withColumn("type", _field(F.decode("header", "utf-8"), "WARC-Type"))
    whole, rest = head.filter("type = 'response'"), head.filter("type = 'revisit'")
    end = F.lit(bytearray(b"\r\n\r\n"))
    full = whole.join(spark.read.parquet(f"{path}/payloads"), "digest").select("record_id", F.concat("header", "payload", end).alias("record"))
    return full.unionByName(rest.select("record_id", F.concat("header", end).alias("record")))


def op6(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    kind = pages.schema["page_id"].dataType
    ident = lambda c: F.when(F.col(c) == "", None).otherwise(F.col(c)).cast(kind)
    return read_archive(spark, path).select(ident("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers").alias("refers_to"))
