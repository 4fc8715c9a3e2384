"""Monotonic counters that restart, and sums over the last minutes.

Time is cut into buckets; a bucket of one key is the unit of work, and what a bucket needs from the one before crosses
over as a summary or as a few context rows. One busy key is thereby spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def _bucket(at: Column, minutes: int) -> Column:
    return F.floor(micros(at) / (minutes * 60_000_000))


def counter_increase(
    df: DataFrame, key: list[str], at: str, counter: str, *, started: str = "started_at", order: list[str] | None = None,
    bucket_minutes: int = 60,
) -> DataFrame:
    """Adds ``increase``: growth since the reading before, within one process (equal ``started``) and never negative."""
    place = [at, *(order or [])]
    reading = F.struct(F.col(started).alias("started"), F.col(counter).alias("counter"))
    # The unit is one struct column: never null itself, it joins with plain equality, so that the rows shuffled for the
    # window stay where they are for the join.
    cut = df.withColumn("__unit", F.struct(*key, _bucket(F.col(at), bucket_minutes).alias("__bucket")))
    local = cut.withColumn("__before", F.lag(reading).over(Window.partitionBy("__unit").orderBy(*place)))
    lasts = cut.groupBy("__unit").agg(F.max_by(reading, F.struct(*place)).alias("__last"))
    chain = Window.partitionBy(*[F.col("__unit")[name] for name in key]).orderBy(F.col("__unit.__bucket"))
    entries = lasts.select("__unit", F.lag("__last").over(chain).alias("__entry"))
    joined = local.join(entries, "__unit", "left").select(*df.columns, F.coalesce("__before", "__entry").alias("__before"))
    same = F.col("__before.started") == F.col(started)
    growth = F.greatest(F.lit(0), F.col(counter) - F.col("__before.counter"))
    return joined.withColumn("increase", F.when(same, growth).otherwise(0).cast("long")).drop("__before")


def rolling_sum(
    df: DataFrame, key: list[str], at: str, value: str, *, minutes: int = 10, name: str = "rolling",
    bucket_minutes: int = 60,
) -> DataFrame:
    """Adds the sum of ``value`` over the last ``minutes`` up to each row, both ends included."""
    window, width = minutes * 60_000_000, bucket_minutes * 60_000_000
    timed = df.withColumn("__at", micros(F.col(at)))
    own = F.floor(F.col("__at") / width)
    # A row also enters the later buckets that can still see it.
    seen = F.sequence(own, F.floor((F.col("__at") + window) / width))
    copies = timed.withColumn("__own", own).withColumn("__bucket", F.explode(seen))
    frame = Window.partitionBy(*key, "__bucket").orderBy("__at").rangeBetween(-window, 0)
    summed = copies.withColumn(name, F.sum(value).over(frame))
    return summed.filter(F.col("__bucket") == F.col("__own")).drop("__at", "__own", "__bucket")
