"""Lines of text files in the order of their splits, for passes that sum up a split at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """number, split, line (bytes) in the order of the files; a number stands for a file, a split is known by its start."""
    taken = {name.lower() for name in spark.read.format("text").load(path).columns}
    column = next(name for number in range(len(taken) + 1) if (name := f"line{number}") not in taken)
    lines = spark.read.schema(f"{column} string").option("lineSep", "\n").text(path)
    number, split = F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.file_block_start")
    return lines.select(number.alias("number"), split.alias("split"), F.col(column).cast("binary").alias("line"))


def split_files(spark: SparkSession, path: str) -> DataFrame:
    """number, file: names apart, so that they aren't sent along with every line."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    once = files.groupBy(F.xxhash64("file").alias("number")).agg(F.min("file").alias("file"), F.max("file").alias("last"))
    one = F.when(F.col("file") == F.col("last"), F.col("file")).otherwise(F.raise_error(F.lit("two files share a number")))
    return once.select("number", one.alias("file"))


def split_runs(batch: pa.RecordBatch):
    """(place, slice) of the rows of each split in a batch; a place is (number, split)."""
    numbers, splits = batch.column("number").to_numpy(), batch.column("split").to_numpy()
    change = (numbers[1:] != numbers[:-1]) | (splits[1:] != splits[:-1])
    starts = np.flatnonzero(np.r_[True, change]).tolist() if len(numbers) else []
    for start, stop in zip(starts, [*starts[1:], len(numbers)]):
        yield (int(numbers[start]), int(splits[start])), batch.slice(start, stop - start)
