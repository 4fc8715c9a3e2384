"""Windowed mixes and quality counters, ends that count once, and runs matched from their events.

Each takes and returns a streaming DataFrame; the caller writes it. Windows are emitted when the watermark has passed
their end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.states import run_tone
from tidegate.functions.text import is_blank
from tidegate.operators.mix import mix_columns, share
from tidegate.operators.quality import cell_texts, row_digest
from tidegate.scale import SALTS


def windowed_mix(
    events: DataFrame, *, at: str = "ts", state: str = "state", delay: str = "10 minutes", width: str = "10 minutes",
    slide: str | None = None, by: tuple[str, ...] = (),
) -> DataFrame:
    """(window_start, window_end, by..., success, failed, running, waiting, success_share), tumbling or sliding."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    mixed = events.withWatermark(at, delay).groupBy(window, *by).agg(*mix_columns(run_tone(F.col(state))))
    return mixed.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "success", "failed",
        "running", "waiting", share(F.col("success"), F.col("failed")).alias("success_share"),
    )


def windowed_quality(
    rows: DataFrame, cells: list[str], *, at: str = "ts", delay: str = "10 minutes", width: str = "1 hour"
) -> DataFrame:
    """(window_start, rows, blank_cells, blank_rows, duplicate_rows) of the given columns per window.

    Copies are combined by their digest first; state holds one entry per different row of an open window.
    """
    given = rows.select(*cells)
    blanks = [is_blank(text).cast("long") for text in cell_texts(given)]
    total = sum(blanks[1:], blanks[0])
    judged = rows.withWatermark(at, delay).select(at, row_digest(given).alias("__digest"), total.alias("__blanks"))
    copies = judged.groupBy(F.window(at, width), "__digest").agg(F.count(F.lit(1)).alias("n"), F.max("__blanks").alias("blanks"))
    counted = copies.groupBy(F.window(F.window_time("window"), width).alias("whole")).agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("blanks")).alias("blank_cells"),
        F.sum(F.when(F.col("blanks") == len(blanks), F.col("n")).otherwise(0)).cast("long").alias("blank_rows"),
        F.sum(F.col("n") - 1).alias("duplicate_rows"),
    )
    return counted.select(F.col("whole.start").alias("window_start"), "rows", "blank_cells", "blank_rows", "duplicate_rows")


def dedupe_ends(
    events: DataFrame, *, run: str = "run_id", kind: str = "kind", at: str = "ts", delay: str = "10 minutes",
    salts: int = SALTS,
) -> DataFrame:
    """Each run's end once: further ends within the watermark are dropped, and ends later than it too.

    Copies meet in two steps, first in pieces, so that one run repeated very often is no single task's work.
    """
    ends = events.filter(F.col(kind) == "end").withWatermark(at, delay)
    pieces = ends.withColumn("__piece", F.pmod(F.spark_partition_id(), F.lit(salts)))
    once = pieces.dropDuplicatesWithinWatermark([run, "__piece"]).drop("__piece")
    return once.dropDuplicatesWithinWatermark([run])


def match_runs(
    begins: DataFrame, ends: DataFrame, *, run: str = "run_id", at: str = "ts", timeout: str = "30 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """(run, started_at, ended_at, duration_ms): begins with their end within ``timeout``; null when there was none.

    ``begins`` and ``ends`` hold one row per run (see dedupe_ends).
    """
    b = begins.select(F.col(run).alias("b_run"), F.col(at).alias("started_at")).withWatermark("started_at", delay)
    e = ends.select(F.col(run).alias("e_run"), F.col(at).alias("ended_at")).withWatermark("ended_at", delay)
    within = F.expr(f"e_run = b_run AND ended_at >= started_at AND ended_at <= started_at + INTERVAL {timeout}")
    return b.join(e, within, "left_outer").select(
        F.col("b_run").alias(run), "started_at", "ended_at",
        (F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("duration_ms"),
    )
