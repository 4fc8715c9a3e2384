"""How runs ended: tones, their mix, and the share that succeeded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.states import FAILED, RUNNING, SUCCESS, WAITING, run_tone


def with_tone(df: DataFrame, state: str = "state") -> DataFrame:
    return df.withColumn("tone", run_tone(F.col(state)))


def mix_columns(tone: Column) -> list[Column]:
    return [F.count_if(tone == value).alias(value.lower()) for value in (SUCCESS, FAILED, RUNNING, WAITING)]


def share(success: Column, failure: Column) -> Column:
    """The share of finished runs that succeeded; -1 when none has finished."""
    finished = success + failure
    return F.when(finished == 0, -1.0).otherwise(success / finished)


def run_mix(df: DataFrame, by: tuple[str, ...] = (), state: str = "state") -> DataFrame:
    """success, failed, running, waiting per group; runs in no known tone are not counted."""
    return df.groupBy(*by).agg(*mix_columns(run_tone(F.col(state))))


def success_share(df: DataFrame, by: tuple[str, ...] = (), state: str = "state") -> DataFrame:
    mixed = run_mix(df, by, state)
    return mixed.select(*by, share(F.col("success"), F.col("failed")).alias("success_share"))
