"""Tiered usage costs in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.scale import spread_join

# Free allowances, billing steps and prices of stored backups; the longest month and the largest backup.
FREE_GB, PRICE_GB = 10, "0.015"
FREE_CLASS_A, PRICE_CLASS_A = 1_000_000, "4.50"
FREE_CLASS_B, PRICE_CLASS_B = 10_000_000, "0.36"
STEP = 1_000_000
MAX_HOURS, MAX_GB = 744, 1_000_000

AMOUNT = r"\A[0-9]+(\.[0-9]{1,10})?\z"
BILL = "decimal(28,10)"


def amount(text: Column, whole_digits: int = 12) -> Column:
    """A non-negative decimal with at most ten places, or null."""
    return F.when(text.rlike(AMOUNT), text.try_cast(f"decimal({whole_digits + 10},10)"))


def _steps(used: Column, free: int) -> Column:
    """Started steps above the allowance."""
    over = F.greatest(F.ceil(used).cast("long") - free, F.lit(0).cast("long"))
    return F.floor((over + (STEP - 1)) / STEP)


def usd(value: Column) -> Column:
    """$12.35: half-up cents."""
    return F.concat(F.lit("$"), F.round(value, 2).cast("decimal(28,2)").cast("string"))


def backup_cost(gb: Column, class_a: Column, class_b: Column) -> Column:
    billable = F.greatest(F.ceil(gb).cast("long") - FREE_GB, F.lit(0).cast("long"))

    def priced(units: Column, price: str) -> Column:
        return units.cast("decimal(15,0)") * F.lit(price).cast("decimal(6,3)")

    parts = [
        priced(billable, PRICE_GB), priced(_steps(class_a, FREE_CLASS_A), PRICE_CLASS_A),
        priced(_steps(class_b, FREE_CLASS_B), PRICE_CLASS_B),
    ]
    return (parts[0] + parts[1] + parts[2]).cast(BILL)


def usage_cost(usage: DataFrame, rates: DataFrame, *, spread_by: list[str] | None = None) -> DataFrame:
    """Adds compute, backup, lower_bound, total and problem to usage (plan, hours, gb_months, class_a, class_b).

    ``rates`` has (plan, monthly, hourly, disk, complete); amounts are decimal text. A monthly plan costs the same
    whatever the hours. The total is null for a plan with unknown parts, the lower bound counts what is known; a row
    with an unknown plan or a bad amount has a problem and no figures.
    """
    priced = rates.select(
        "plan", amount(F.col("monthly"), 8).alias("__monthly"), amount(F.col("hourly"), 8).alias("__hourly"),
        amount(F.col("disk"), 8).alias("__disk"), F.col("complete").alias("__complete"), F.lit(True).alias("__known"),
    )
    joined = spread_join(usage, priced, ["plan"], "left", spread_by=spread_by)
    hours, gb = amount(F.col("hours"), 8), amount(F.col("gb_months"), 12)
    class_a, class_b = amount(F.coalesce("class_a", F.lit("0"))), amount(F.coalesce("class_b", F.lit("0")))
    problem = (
        F.when(F.col("__known").isNull(), "unknown plan")
        .when(hours.isNull() | gb.isNull() | class_a.isNull() | class_b.isNull(), "not a decimal amount")
        .when(hours > MAX_HOURS, "hours out of range").when(gb > MAX_GB, "backup out of range")
    )
    by_hour = F.floor(F.col("__hourly") * hours, F.lit(10)).cast(BILL)
    compute = F.coalesce(F.col("__monthly").cast(BILL), by_hour)
    fine = F.col("problem").isNull()
    bound = (F.col("compute") + F.coalesce(F.col("__disk"), F.lit(0).cast(BILL)) + F.col("backup")).cast(BILL)
    whole = fine & F.col("__complete") & F.col("__disk").isNotNull()
    return (
        joined.withColumn("problem", problem)
        .withColumn("compute", F.when(fine, compute))
        .withColumn("backup", F.when(fine, backup_cost(gb, class_a, class_b)))
        .withColumn("lower_bound", F.when(fine, bound))
        .withColumn("total", F.when(whole, F.col("lower_bound")))
        .drop("__monthly", "__hourly", "__disk", "__complete", "__known")
    )
