"""Content-addressed WARC archive: payload bytes once per verified digest, exact record heads beside them.

A folder holds two Parquet tables. ``payloads``: sha256, payload. ``records``: head (the bytes of a WARC/1.1 record up to
its payload, with the HTTP head of a response), sha256. A record is its head and, unless it is a revisit, the payload of
its digest; the page of a revisit is its head and the same payload. Everything is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import materialize

# Fixed values of WARC/1.1 and RFC 4648.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32(hexadecimal: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five of them make four characters."""
    fifths = [F.lpad(F.conv(F.substring(hexadecimal, at, 5), 16, 32), 4, "0") for at in range(1, 40, 5)]
    return F.translate(F.concat(*fifths), DIGITS, BASE32)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def field(head: Column, name: str) -> Column:
    """A field of a head, null if it isn't there."""
    found = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def head_of(url: Column, record: Column, kind: Column, refers: Column, digest: Column, size: Column, date: str) -> Column:
    """The exact bytes before a record's payload, as text."""
    revisit = kind == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.length(http) + F.when(revisit, 0).otherwise(size)
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe), F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), refers)),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), block.cast("string")),
    )
    return F.concat(lines, F.lit("\r\n\r\n"), http)


def write_archive(pages: DataFrame, target: str, *, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                  at_least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record per row to the new folder ``target``; the payload is the text in UTF-8.

    Of the records with equal payloads of ``at_least`` bytes or more, the one with the smallest id is a response and the
    others revisit it; among rows with that same id one is taken, ids that are null come last. Shorter payloads are
    responses each. A null text is an empty payload, a null url gives no target field. An empty table gives empty tables.
    Equal digests are checked byte by byte: should two payloads share one, the job fails. Copies are combined before
    the shuffle, so a payload of a third of all rows moves once per task.
    """
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    plain = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload"))
    keyed = plain.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    same = keyed.groupBy("sha256").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"))
    checked = F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")))
    same.select("sha256", checked.alias("payload")).write.parquet(f"{target}/payloads")

    small = keyed.select("page_id", "url", "sha256", base32(F.sha1("payload")).alias("digest"), F.length("payload").alias("size"))
    stored = materialize(small, "records").withColumn("row", F.monotonically_increasing_id())
    rank = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("page_id"), F.col("row").alias("row"))
    first = stored.groupBy("sha256").agg(F.min(rank).alias("first"))
    joined = stored.join(first, "sha256")
    answer = (F.col("row") == F.col("first.row")) | (F.col("size") < at_least)
    kind = F.when(answer, "response").otherwise("revisit")
    head = head_of(F.col("url"), record_id(F.col("page_id")), kind, record_id(F.col("first.page_id")), F.col("digest"), F.col("size"), date)
    joined.select(head.cast("binary").alias("head"), "sha256").write.parquet(f"{target}/records")


def original_records(spark: SparkSession, source: str) -> DataFrame:
    """head and payload of every record, revisits with the payload that they refer to; digests are computed anew."""
    payloads = spark.read.parquet(f"{source}/payloads")
    good = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    sound = payloads.select("sha256", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a payload is damaged"))).alias("payload"))
    found = spark.read.parquet(f"{source}/records").join(sound, "sha256", "left")
    missing = F.raise_error(F.lit("a payload is missing")).cast("binary")
    return found.select(F.decode("head", "UTF-8").alias("head"), F.coalesce("payload", missing).alias("payload"))


def read_archive(spark: SparkSession, source: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from its head and its payload.

    Fails where the digest in a head isn't that of the payload.
    """
    def page(name: str) -> Column:
        return F.regexp_extract(field(F.col("head"), name), r"^<urn:x-page:(-?\d*)>$", 1).try_cast("long")

    digest = base32(F.sha1("payload"))
    same = field(F.col("head"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)
    return original_records(spark, source).select(
        page("WARC-Record-ID").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        F.when(same, digest).otherwise(F.raise_error(F.lit("a digest differs"))).alias("payload_digest"),
        field(F.col("head"), "WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
    )


def warc_bytes(spark: SparkSession, source: str) -> DataFrame:
    """record: the exact bytes of every WARC record, ready to be put one after the other."""
    end = F.lit(b"\r\n\r\n")
    body = F.when(field(F.col("head"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return original_records(spark, source).select(F.concat(F.encode("head", "UTF-8"), body, end).alias("record"))
