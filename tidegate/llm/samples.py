"""Bounded samples of rows, the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PIECES = 256


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_column).cast("long").cast("string").cast("binary")), F.lit(divisor))


def some_ids(table: DataFrame, id_column: str, rows: int, seed: int) -> DataFrame:
    """The distinct ids of ``rows`` rows with the lowest hashes: a top-k, so no task holds more than that."""
    hashed = table.select(F.col(id_column).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    return hashed.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows)


def texts_of(docs: DataFrame, marked: DataFrame, id_column: str, text_column: str, rows: int, seed: int) -> DataFrame:
    """id, text and mark of the documents in ``marked`` (id, mark), whose size the caller has bounded: it is broadcast.

    Of each mark at most ``rows`` rows stay, also if one id is on many: those with the lowest hashes of id and text.
    """
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    joined = plain.join(F.broadcast(marked), "id")
    # The text's hash orders rows of one id; those that are equal in it, too, are equal or one in 2^64.
    # Most often each id is on one row, and nothing is to be ranked; ids alone tell.
    if all(row["count"] <= rows for row in joined.groupBy("mark").count().collect()):
        return joined
    joined = joined.withColumn("piece", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(PIECES)))
    # First within pieces, so that no task gets all rows of an id.
    for unit in (["mark", "piece"], ["mark"]):
        ordered = Window.partitionBy(*unit).orderBy(F.xxhash64("id", F.lit(seed)), "id", F.xxhash64("text"))
        joined = joined.withColumn("place", F.row_number().over(ordered)).filter(F.col("place") <= rows).drop("place")
    return joined.drop("piece")
