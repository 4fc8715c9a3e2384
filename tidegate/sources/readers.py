"""Scans: by format name, strict CSV, raw lines with their file, file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.results import GateError
from tidegate.sources.options import allow_charset, clean_schema, csv_options


def read_dataset(
    spark: SparkSession, fmt: str, path: str | list[str], options: dict[str, str] | None = None, schema=None
) -> DataFrame:
    """Any Spark format by name, from one path or several; JSON fails on the first malformed record."""
    options = dict(options or {})
    if fmt.lower() == "json":
        options.setdefault("mode", "FAILFAST")
    if fmt.lower() == "csv" and "encoding" in options:
        allow_charset(spark, options["encoding"])
    reader = spark.read.format(fmt).options(**options)
    schema = clean_schema(schema)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_csv_strict(
    spark: SparkSession, path: str, *, header=True, delimiter: str = ",", escape: str = '"', multi_line=True,
    infer_schema=False, schema=None, encoding: str | None = None,
) -> DataFrame:
    """CSV that fails on the first malformed record, on headers that differ from the schema and on stray quotes.

    ``multi_line=False`` lets Spark split large files; quoted line ends then are errors.
    """
    options = csv_options(
        spark, header=header, delimiter=delimiter, escape=escape, multi_line=multi_line, infer_schema=infer_schema,
        encoding=encoding,
    )
    return read_dataset(spark, "csv", path, options, schema)


def require_data_files(df: DataFrame, label: str = "input") -> DataFrame:
    """Refuses an input in which Spark's listing finds no file; a file with only a header is one."""
    if not df.inputFiles():
        raise GateError(f"{label} contains no data files (Spark skips names starting with _ or .)")
    return df


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, bytes) of every line, decompressed; a partition directory cannot take the place of the line."""
    taken = {name.lower() for name in spark.read.format("text").load(path).columns}
    line = next(name for number in range(len(taken) + 1) if (name := f"line{number}") not in taken)
    lines = spark.read.schema(f"{line} string").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col(line).cast("binary").alias("bytes"))


def file_inventory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the files below ``path``, sorted; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    )
    return files.select("path", "length", "modificationTime").orderBy("path")


def storage_footprint(files: DataFrame) -> DataFrame:
    """Number and total size of the listed files."""
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes")
    )
