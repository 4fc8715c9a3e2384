"""Round-trip statistics of checked backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.states import is_reachable
from tidegate.scale import keyed_join


def _bin(value: Column) -> Column:
    """A bin about 1% wide at any scale, in the order of the values: it has the sign, the power of two and 64 steps within.

    Zero has a bin of its own and values that are no number, which Spark sorts last, another.
    """
    size = F.floor((F.log2(F.abs(value)) + 1100) * 64).cast("long")
    return (
        F.when(F.isnan(value), F.lit(1 << 20)).when(F.abs(value) == float("inf"), F.signum(value).cast("long") * (1 << 19))
        .when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * size)
    )


def exact_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., median): the middle value, or the mean of the middle pair, without gathering a group.

    Equal values are combined first; bin sizes then tell which one or two bins of each group hold the middle, and only
    those are sorted.
    """
    equal = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("bin", _bin(F.col("v")))
    group = Window.partitionBy(*by)
    before = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bins = equal.groupBy(*by, "bin").agg(F.sum("n").alias("size")).select(
        *by, "bin", "size",
        F.coalesce(F.sum("size").over(before), zero).alias("start"), F.sum("size").over(group).alias("total"),
    )
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = bins.filter((F.col("start") <= high) & (F.col("start") + F.col("size") > low)).select(
        *by, "bin", "start", low.alias("low"), high.alias("high")
    )
    found = keyed_join(equal, middle, [*by, "bin"])
    in_bin = Window.partitionBy(*by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("n").over(in_bin), zero)
    placed = found.withColumn("first", first).withColumn("last", F.col("first") + F.col("n") - 1)
    hit = placed.filter(
        (F.col("low").between(F.col("first"), F.col("last"))) | (F.col("high").between(F.col("first"), F.col("last")))
    )
    return hit.groupBy(*by).agg(((F.min("v") + F.max("v")) / 2).alias("median"))


def latency_stats(
    df: DataFrame, by: list[str], *, at: str = "at", state: str = "state", latency: str = "latency_ms"
) -> DataFrame:
    """checks, reachable, latest, median, worst, availability per group.

    latest, median and worst are over the answered checks and null without one; availability is -1 without any check.
    """
    key = by or ["__all"]
    samples = df if by else df.withColumn("__all", F.lit(1))
    answered = F.col(latency).isNotNull()
    counts = samples.groupBy(*key).agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(is_reachable(F.col(state))).alias("reachable"),
        F.max_by(F.when(answered, F.col(latency)), F.when(answered, F.col(at))).alias("latest"),
        F.max(latency).alias("worst"),
    )
    medians = exact_median(samples, key, latency)
    joined = keyed_join(counts, medians, key, "left")
    rows = joined.select(
        *key, "checks", "reachable", "latest", "median", "worst",
        availability(F.col("reachable"), F.col("checks")).alias("availability"),
    )
    if by:
        return rows
    # A table without any sample still has one answer.
    none = df.sparkSession.range(1).select(F.lit(1).alias("__all"))
    return none.join(rows, "__all", "left").select(
        F.coalesce("checks", F.lit(0).cast("long")).alias("checks"),
        F.coalesce("reachable", F.lit(0).cast("long")).alias("reachable"),
        "latest", "median", "worst", F.coalesce("availability", F.lit(-1.0)).alias("availability"),
    )


def availability(reachable: Column, checks: Column) -> Column:
    return F.when(checks == 0, -1.0).otherwise(reachable / checks)
