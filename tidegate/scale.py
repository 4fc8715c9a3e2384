"""Helpers that keep a plan even when one key holds a large share of the rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# How many pieces a key is split into before rows of one key meet in one task.
SALTS = 32


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a local session may lack one and gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tidegate-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_measured(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates of the rows taken while they are written."""
    seen = Observation()
    written = materialize(df.observe(seen, *measures), name)
    return written, seen.get


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """``materialize`` in as many buckets by ``key`` as the session has shuffle partitions: what groups or joins the result
    by ``key`` later doesn't shuffle it. Only a table can say that it has buckets; its name is needed until it is resolved."""
    spark, table = df.sparkSession, f"spark_catalog.default.bucketed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        df.write.format("parquet").bucketBy(buckets, key).option("path", scratch_path(spark, name)).saveAsTable(table)
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within it sends at most ``rows`` rows to Python in one Arrow batch, or the session's fewer. Spark bounds a
    batch by rows, whatever they hold, and keeps two sizes of it while it grows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def salt(columns: list[str], salts: int = SALTS) -> Column:
    """A piece number that is the same on every retry of a task."""
    return F.pmod(F.xxhash64(*[F.col(name) for name in columns]), F.lit(salts))


def same_keys(keys: list[str]) -> Column:
    """Null-safe equality of the key columns of two tables aliased l and r."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return condition


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """All columns of ``left`` and the other columns of ``right``."""
    joined = left.alias("l").join(right.alias("r"), same_keys(keys), how)
    added = [F.col(f"r.{name}") for name in right.columns if name not in keys]
    return joined.select(*[F.col(f"l.{name}") for name in left.columns], *added)


def splits_hot_keys(spark: SparkSession) -> bool:
    """Whether Spark measures shuffled partitions and splits the oversized ones of a join by itself."""
    keys = ["spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"]
    return all(spark.conf.get(key, "true").lower() == "true" for key in keys)


def spread_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", *, spread_by: list[str] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """keyed_join of a large table that may hold a third of its rows under one key; ``how`` is inner or left.

    Adaptive execution splits the partition of a hot key and repeats the other side's part of it, at no cost when no key
    is hot. In a session without it, the rows of a key are dealt over ``salts`` pieces and the small side is repeated
    once per piece. Neither side is broadcast unless Spark has measured it to be below its own threshold.
    """
    if splits_hot_keys(big.sparkSession):
        return keyed_join(big, small, keys, how)
    piece = "__piece"
    dealt = big.withColumn(piece, salt(spread_by or big.columns, salts))
    pieces = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    return keyed_join(dealt, small.withColumn(piece, F.explode(pieces)), [*keys, piece], how).drop(piece)


def newest_per(df: DataFrame, key: list[str], order: list[str], n: int, *, rank: str | None = None,
               salts: int = SALTS) -> DataFrame:
    """The ``n`` newest rows of each key, by ``order`` descending.

    Two limits in a row: first within pieces of a key, then over what is left, at most ``salts * n`` rows per key.
    """
    piece, number = "__piece", "__number"
    newest = [F.col(name).desc() for name in order]
    first = (
        df.withColumn(piece, salt(order, salts))
        .withColumn(number, F.row_number().over(Window.partitionBy(*key, piece).orderBy(*newest)))
        .filter(F.col(number) <= n)
        .drop(piece, number)
    )
    last = first.withColumn(number, F.row_number().over(Window.partitionBy(*key).orderBy(*newest)))
    kept = last.filter(F.col(number) <= n)
    return kept.withColumnRenamed(number, rank) if rank else kept.drop(number)


def number_within(df: DataFrame, group: list[str], position: str, name: str, *, stretches: int = 100) -> DataFrame:
    """0-based row number within a group by a unique whole-number position, without one task per group.

    A group is cut where about equal shares of its rows lie, however its positions are spread; rows are numbered within a
    stretch and shifted by the sizes of the stretches before. Cuts are approximate, so they are stored: each use must
    see the same ones.
    """
    shares = [number / stretches for number in range(1, stretches)]
    cuts = df.groupBy(*group).agg(F.percentile_approx(position, shares, 1000).alias("__cuts"))
    cuts = materialize(cuts, "cuts")
    before = F.size(F.filter("__cuts", lambda cut: cut < F.col(position)))
    # A struct is never null itself, so window and join can share one shuffle even where a group is null.
    unit = "__unit"
    cut = keyed_join(df, cuts, group).withColumn(unit, F.struct(*group, before.alias("__stretch"))).drop("__cuts")
    sizes = cut.groupBy(unit).agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy(*[F.col(unit)[key] for key in group]).orderBy(F.col(f"{unit}.__stretch"))
    before = F.sum("__size").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(unit, F.coalesce(before, F.lit(0)).alias("__offset"))
    local = cut.withColumn("__row", F.row_number().over(Window.partitionBy(unit).orderBy(position)) - 1)
    joined = local.join(offsets, unit)
    return joined.withColumn(name, F.col("__row") + F.col("__offset")).drop(unit, "__offset", "__row")
