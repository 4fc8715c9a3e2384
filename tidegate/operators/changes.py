"""Snapshots that follow each other: differences, upserts, late merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.quality import row_digest
from tidegate.operators.runs import keep_newest, latest_of
from tidegate.scale import same_keys


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(columns..., change, changed): insert, update, delete or unchanged per key; a deleted row shows its old values."""
    rest = [name for name in new.columns if name not in key]

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*[F.col(column) for column in rest], F.lit(True).alias("__there")).alias(name))

    a, b = packed(old, "__old"), packed(new, "__new")
    joined = a.alias("l").join(b.alias("r"), same_keys(key), "full_outer")
    missing_old, missing_new = F.col("__old").isNull(), F.col("__new").isNull()
    change = (
        F.when(missing_old, "insert").when(missing_new, "delete")
        .when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("update")
    )
    row = F.coalesce("__new", "__old")
    keys = [F.coalesce(F.col(f"r.{name}"), F.col(f"l.{name}")).alias(name) for name in key]
    return joined.select(*keys, *[row[name].alias(name) for name in rest], change.alias("change")).withColumn(
        "changed", F.col("change") != "unchanged"
    )


def upsert_latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last written."""
    return latest_of(df, key, order)


def merge_early(loaded: DataFrame, early: DataFrame, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` of what was loaded and of the early arrivals that it does not contain."""
    fresh = early.select(*loaded.columns)
    fresh = fresh.withColumn("__digest", row_digest(fresh, nulls=True))
    known = loaded.select(row_digest(loaded, nulls=True).alias("__digest")).groupBy("__digest").agg(F.lit(1).alias("__one"))
    added = fresh.join(known, "__digest", "left_anti").select(*loaded.columns)
    return keep_newest(loaded.unionByName(added), order, n)
