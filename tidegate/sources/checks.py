"""Checks on bytes: every line decodes, no foreign byte order mark, file checksums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.results import GateError, GateResult, failed, succeeded, utc_now
from tidegate.sources.options import charset as canonical_charset
from tidegate.sources.paths import file_system, hadoop_path, plain_path
from tidegate.sources.readers import file_inventory, raw_lines
from tidegate.sources.splits import split_files, split_lines, split_runs

UTF8_MARK = b"\xef\xbb\xbf"
# Bytes read at once, and files per task when they are dealt out.
PIECE = 8 * 1024 * 1024
FILES_PER_TASK = 4
# Bytes of a file's head read at once.
HEAD = 64 * 1024
# Schemes whose files executors read in pieces; of other stores Spark gives a file as one value, up to 2 GiB.
STREAMED = ["file", "hdfs", "gs", "s3", "abfs", "abfss"]


def open_bytes(path: str, compression: str | None):
    """A byte stream of a file that any executor can open by its URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream(re.sub(r"^file:/*", "/", path), compression=compression)
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@%"))
    return system.open_input_stream(inner, compression=compression)


@contextmanager
def _charset_conf(spark: SparkSession):
    """Any JVM charset, and U+FFFD instead of an error, while the decoding check runs."""
    keys = ["spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"]
    before = {key: spark.conf.get(key, None) for key in keys}
    for key in keys:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def undecodable(value: Column, charset: str) -> Column:
    """True for bytes that are no complete text in ``charset``.

    Outside UTF-8 both tests are needed: a real U+FFFD exists in some charsets, and some charsets write one character
    in two ways so that a round trip alone would differ.
    """
    if charset == "UTF-8":
        return ~F.is_valid_utf8(value.cast("string"))
    text = F.decode(value, charset)
    return (F.instr(text, "�") > 0) & (F.encode(text, charset) != value)


def require_decodable(
    spark: SparkSession, path: str | list[str], charset: str | None = None, label: str = "input"
) -> None:
    """Refuses text with lines that are not valid in its charset, which a reader would damage silently."""
    name = canonical_charset(spark, charset)
    if name != "UTF-8":
        require_no_bom(spark, path, name, label)
    with _charset_conf(spark):
        bad = raw_lines(spark, path).filter(undecodable(F.col("bytes"), name))
        lines, first = bad.agg(F.count(F.lit(1)), F.min("file")).first()
    if lines:
        raise GateError(
            f"{label} is not valid {name}: {lines} line(s) cannot be decoded, the first in {first}; "
            "set encoding to the charset the data was written in"
        )


def undecodable_files(spark: SparkSession, paths: list[str], charset: str) -> dict[str, str]:
    """The problem of each of the given files that has lines not valid in its charset, or a foreign byte order mark."""
    named = {plain_path(path): path for path in paths}
    with _charset_conf(spark):
        bad = raw_lines(spark, paths).filter(undecodable(F.col("bytes"), charset)).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
        found = {named[plain_path(row["file"])]: f"{row['lines']} line(s) cannot be decoded" for row in bad.collect()}
    if charset != "UTF-8":
        marked = file_heads(spark, paths).filter(F.col("head") == F.lit(UTF8_MARK))
        found |= {named[plain_path(row["path"])]: "the file starts with the UTF-8 byte order mark" for row in marked.collect()}
    return {path: f"input is not valid {charset}: {problem}" for path, problem in found.items()}


def _one_form(path: str | Column) -> Column:
    """A path with one slash after its scheme, as listings write it; file metadata write three."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", F.lit("$1:/"))


def _first_record(stream, charset: str, delimiter: str, escape: str) -> list[str] | None:
    """The cells of the first line of a CSV stream that isn't empty; None when there is none, or when it never ends."""
    import codecs
    import csv
    import io

    kind = "utf-8-sig" if charset == "UTF-8" else charset
    decoder, text = codecs.getincrementaldecoder(kind)("replace"), ""
    form = {"delimiter": delimiter, "strict": True, **({} if escape == '"' else {"escapechar": escape, "doublequote": False})}
    while True:
        piece = stream.read(HEAD)
        text += decoder.decode(piece, final=not piece)
        lines = list(io.StringIO(text, newline=""))
        try:
            for cells in csv.reader(lines if not piece else lines[:-1], **form):
                if cells:
                    return cells
        except csv.Error:
            if not piece:
                return None
        if not piece:
            return None


def header_problems(spark: SparkSession, path: str | list[str], names: list[str], options: dict[str, str]) -> DataFrame:
    """(path, problem) of each CSV file whose header isn't ``names``; a file without a line has no header to judge."""
    exact = spark.conf.get("spark.sql.caseSensitive", "false") == "true"
    want = names if exact else [name.lower() for name in names]
    charset, delimiter, escape = options["encoding"], options["delimiter"], options["escape"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for path in batch["path"]:
                with open_bytes(path, "detect") as stream:
                    cells = _first_record(stream, charset, delimiter, escape)
                if cells is None:
                    continue
                if len(cells) != len(want):
                    bad.append((path, f"the header has {len(cells)} column(s), the schema has {len(want)}"))
                elif (cells if exact else [cell.lower() for cell in cells]) != want:
                    bad.append((path, "the header doesn't name the columns of the schema"))
            yield pd.DataFrame(bad, columns=["path", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return _dealt(files).mapInPandas(judge, "path string, problem string")


def _dealt(files: DataFrame) -> DataFrame:
    """Files over tasks, a few each: a given number of partitions isn't merged again by adaptive execution."""
    tasks = max(1, -(-files.count() // FILES_PER_TASK))
    return files.repartition(tasks, "path")


def _first_bytes(count: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for batch in batches:
            heads = []
            for path in batch["path"]:
                if path.lower().endswith(".deflate"):
                    with open_bytes(path, None) as stream:
                        heads.append(zlib.decompressobj().decompress(stream.read(4096), count))
                else:
                    with open_bytes(path, "detect") as stream:
                        heads.append(stream.read(count))
            yield pd.DataFrame({"path": batch["path"], "head": heads})

    return read


def file_heads(spark: SparkSession, path: str | list[str], count: int = 3) -> DataFrame:
    """(path, head): the first decompressed bytes of each data file, read on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return _dealt(files).mapInPandas(_first_bytes(count), "path string, head binary")


def require_no_bom(spark: SparkSession, path: str | list[str], charset: str, label: str = "input") -> None:
    """Refuses files that start with the UTF-8 mark although another charset was named."""
    if charset == "UTF-8":
        return
    marked = file_heads(spark, path).filter(F.col("head") == F.lit(UTF8_MARK))
    files, first = marked.agg(F.count(F.lit(1)), F.min("path")).first()
    if files:
        raise GateError(
            f"{label} is not valid {charset}: {files} file(s) start with the UTF-8 byte order mark, "
            f"the first is {first}; set encoding to UTF-8"
        )


def _bad_in_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """number, split, length, offset of each split: its bytes and the place of the first that breaks UTF-8.

    A line end is no part of any longer character, so lines are judged by themselves.
    """
    place, length, offset = None, 0, None

    def row():
        columns = [*place, length, offset]
        return pa.RecordBatch.from_arrays([pa.array([value], pa.int64()) for value in columns], names=["number", "split", "length", "offset"])

    for batch in batches:
        for found, rows in split_runs(batch):
            if found != place:
                if place is not None:
                    yield row()
                place, length, offset = found, 0, None
            text = b"\n".join([*rows.column("line").to_pylist(), b""])
            if offset is None:
                try:
                    text.decode("utf-8")
                except UnicodeDecodeError as error:
                    offset = length + error.start
            length += len(text)
    if place is not None:
        yield row()


def first_bad_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset) of the first byte of each file that is not valid UTF-8; files without one are left out.

    Splits are judged apart; their lengths, summed in order, give the place in the file.
    """
    found = split_lines(spark, path).mapInArrow(_bad_in_splits, "number LONG, split LONG, length LONG, offset LONG")
    before = Window.partitionBy("number").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)) + F.col("offset"))
    first = placed.groupBy("number").agg(F.min("offset").alias("offset")).filter("offset IS NOT NULL")
    named = first.join(split_files(spark, path), "number")
    # The line reader has dropped a byte order mark.
    marks = file_heads(spark, path).select(_one_form("path").alias("form"), (F.col("head") == F.lit(UTF8_MARK)).alias("marked"))
    plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    known = named.select(_one_form(plain).alias("form"), "offset").join(marks, "form", "left")
    return known.select(F.col("form").alias("path"), (F.col("offset") + F.when(F.col("marked"), 3).otherwise(0)).alias("offset"))


def require_utf8(spark: SparkSession, path: str) -> None:
    """Strict UTF-8: the native line check first, and only on failure the byte offset of the first bad byte."""
    bad = raw_lines(spark, path).filter(undecodable(F.col("bytes"), "UTF-8")).select("file").limit(1).count()
    if bad:
        first = first_bad_bytes(spark, path).orderBy("path").first()
        where = path if first is None else first["path"]
        at = 0 if first is None else first["offset"]
        raise GateError(f"Input {where} is not valid UTF-8 at byte offset {at}")


def _hash_in_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with open_bytes(path, None) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) per file, lower-case hex. The scheme decides how a file is read, its size doesn't."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    streamed = F.lower(F.substring_index("path", ":", 1)).isin(STREAMED)
    listed = scan.select("path", F.col("length").alias("bytes")).filter(streamed)
    pieces = _dealt(listed).mapInPandas(_hash_in_pieces, "path string, bytes long, sha256 string")
    whole = scan.filter(~streamed).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return pieces.unionByName(whole)


def file_facts(spark: SparkSession, path: str) -> dict:
    """Bytes and SHA-256 of one file; Spark's scans leave out an empty one."""
    rows = checksums(spark, path).limit(2).collect()
    if not rows and file_system(spark, path).getFileStatus(hadoop_path(spark, path)).isFile():
        return {"bytes": 0, "sha256": hashlib.sha256().hexdigest()}
    if len(rows) != 1:
        raise GateError("input must name one file")
    return {"bytes": rows[0]["bytes"], "sha256": rows[0]["sha256"]}


def expected_digest(value: str | None) -> str | None:
    if value is None:
        return None
    if not re.fullmatch(r"[0-9a-fA-F]{64}", value.strip()):
        raise GateError("expectedSha256 must be 64 hexadecimal characters")
    return value.strip().lower()


def file_checksum(spark: SparkSession, path: str, expected_sha256: str | None = None) -> GateResult:
    """Size and SHA-256 of one file, compared with an expected digest when given."""
    started, expected = utc_now(), expected_digest(expected_sha256)
    metrics = {key: str(value) for key, value in file_facts(spark, path).items()}
    if expected and expected != metrics["sha256"]:
        message = f"Expected SHA-256 {expected} but found {metrics['sha256']}"
        return failed("file-checksum", message, metrics, started)
    message = f"SHA-256 {metrics['sha256']} for {metrics['bytes']} bytes in {path}"
    return succeeded("file-checksum", message, metrics, started)


__all__ = [
    "checksums", "expected_digest", "file_checksum", "file_facts", "file_heads", "file_inventory", "first_bad_bytes",
    "require_decodable", "require_no_bom", "require_utf8", "undecodable",
]
