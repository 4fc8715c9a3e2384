"""Run history: newest runs, feeds, retention, counters, active runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.text import elapsed_millis
from tidegate.scale import keyed_join, newest_per, spread_join

# How much of each history is kept or shown.
RIBBON, RECENT, SAMPLES, ACTIVITY_KEEP, KEEP_PER_PROFILE = 10, 8, 120, 500, 200
KEEP_DAYS = 14


def with_newest_runs(
    pipelines: DataFrame, runs: DataFrame, key: str, order: list[str], *, n: int = RIBBON, fields: list[str] | None = None
) -> DataFrame:
    """Each pipeline with its ``n`` newest runs as an array, newest first; one without runs has an empty array."""
    shown = fields or [name for name in runs.columns if name != key]
    newest = newest_per(runs, [key], order, n, rank="__place")
    item = F.struct("__place", *shown)
    arrays = newest.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("runs"))
    joined = keyed_join(pipelines, arrays, [key], "left")
    typed = F.transform("runs", lambda run: F.struct(*[run[name].alias(name) for name in shown]))
    return joined.withColumn("runs", F.coalesce(typed, F.array()))


def recent_feed(*feeds: DataFrame, n: int = RECENT, at: str = "started_at", key: str = "key") -> DataFrame:
    """The ``n`` newest items of several sources, newest first."""
    merged = reduce(lambda left, right: left.unionByName(right), feeds)
    return merged.orderBy(F.col(at).desc(), F.col(key).asc()).limit(n)


def within_days(df: DataFrame, at: str, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Rows not older than ``days``; a row exactly that old stays."""
    return df.filter(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


def retain(
    df: DataFrame, key: list[str], order: list[str], *, n: int = KEEP_PER_PROFILE, days: int | None = None,
    now: Column | None = None, at: str | None = None,
) -> DataFrame:
    """What a history keeps: the newest ``n`` rows per key, and nothing older than ``days`` before ``now``."""
    young = df if days is None else within_days(df, at or order[0], now, days)
    return newest_per(young, key, order, n)


def keep_newest(df: DataFrame, order: list[str], n: int = ACTIVITY_KEEP) -> DataFrame:
    """The newest ``n`` rows of a log, newest first."""
    return df.orderBy(*[F.col(name).desc() for name in order]).limit(n)


def last_samples(
    df: DataFrame, key: list[str], order: list[str], *, n: int = SAMPLES, state: str | None = None
) -> DataFrame:
    """The last ``n`` samples of each backend with their place, 1 for the oldest kept; unconfigured ones never count."""
    recorded = df if state is None else df.filter(F.coalesce(F.col(state) != "NOT_CONFIGURED", F.lit(True)))
    newest = newest_per(recorded, key, order, n, rank="__newest")
    # At most n rows of a key are left here, already together.
    kept = F.count(F.lit(1)).over(Window.partitionBy(*key)).cast("int")
    return newest.withColumn("place", kept - F.col("__newest") + 1).drop("__newest")


def latest_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; rows of a key are combined before the shuffle."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(*[F.col(name).alias(f"__{name}") for name in key]).agg(newest).select("row.*")


def runs_of(
    df: DataFrame, profile, job: str | None = None, n: int = KEEP_PER_PROFILE, *, profile_column: str = "profile_id",
    job_column: str = "job_name", order: tuple[str, ...] = ("started_at", "id"),
) -> DataFrame:
    """The newest runs of one profile, optionally of one job only, newest first."""
    mine = df.filter(F.col(profile_column) == F.lit(profile))
    mine = mine if job is None else mine.filter(F.col(job_column) == F.lit(job))
    return keep_newest(mine, list(order), n)


def search(df: DataFrame, query: str, columns: list[str], *, kind=None, kind_column: str = "kind") -> DataFrame:
    """Rows of a kind (None for all) whose columns contain the query, whatever the case."""
    found = df if kind is None else df.filter(F.col(kind_column) == F.lit(kind))
    text = query.strip().lower()
    if not text:
        return found
    hits = [F.coalesce(F.contains(F.lower(F.col(name)), F.lit(text)), F.lit(False)) for name in columns]
    return found.filter(reduce(lambda a, b: a | b, hits))


def by_source(df: DataFrame, source: str | None, column: str = "source") -> DataFrame:
    return df if source is None else df.filter(F.col(column) == F.lit(source))


def runs_by_id(events: DataFrame, run: str = "run_id", job: str = "job", kind: str = "kind", ok: str = "ok",
               at: str = "ts") -> DataFrame:
    """(run, job, started_at, ended, ended_at, ok) per begun run; the first end counts, later ones do not."""
    begin, end = F.col(kind) == "begin", F.col(kind) == "end"
    return (
        events.filter(F.col(kind).isin("begin", "end"))
        .groupBy(run)
        .agg(
            F.min_by(F.when(begin, F.col(job)), F.when(begin, F.col(at))).alias(job),
            F.min(F.when(begin, F.col(at))).alias("started_at"),
            F.min(F.when(end, F.col(at))).alias("ended_at"),
            F.min_by(F.when(end, F.col(ok)), F.when(end, F.col(at))).alias(ok),
        )
        .filter(F.col("started_at").isNotNull())
    )


def run_counters(events: DataFrame, **names) -> DataFrame:
    """One row: started, succeeded, failed, rejected."""
    ok, kind = names.get("ok", "ok"), names.get("kind", "kind")
    runs = runs_by_id(events, **names)
    ended = F.col("ended_at").isNotNull()
    counts = runs.agg(
        F.count(F.lit(1)).alias("started"), F.count_if(ended & F.col(ok)).alias("succeeded"),
        F.count_if(ended & ~F.coalesce(F.col(ok), F.lit(False))).alias("failed"), F.lit(0).cast("long").alias("rejected"),
    )
    zero = F.lit(0).cast("long")
    refused = events.agg(
        zero.alias("started"), zero.alias("succeeded"), zero.alias("failed"),
        F.count_if(F.col(kind) == "rejected").alias("rejected"),
    )
    return counts.unionByName(refused).agg(
        *[F.sum(name).alias(name) for name in ("started", "succeeded", "failed", "rejected")]
    )


def active_runs(events: DataFrame, now: Column, **names) -> DataFrame:
    """(run, job, started_at, elapsed_ms) of runs without an end, oldest first, then by job."""
    run, job = names.get("run", "run_id"), names.get("job", "job")
    running = runs_by_id(events, **names).filter(F.col("ended_at").isNull())
    return running.select(
        run, job, "started_at", elapsed_millis(F.col("started_at"), now).alias("elapsed_ms")
    ).orderBy("started_at", job, run)


def duration_share(df: DataFrame, group: list[str], duration: str, *, spread_by: list[str] | None = None) -> DataFrame:
    """Adds ``share``: the root of each duration over the longest of its group, 1 when that is not positive."""
    length = F.when(F.col(duration) < 0, 0).otherwise(F.col(duration))
    longest = df.groupBy(*group).agg(F.max(length).alias("__longest"))
    joined = spread_join(df, longest, group, spread_by=spread_by)
    share = F.when(F.col("__longest") <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(length / F.col("__longest"))))
    return joined.withColumn("share", F.when(F.col(duration).isNotNull(), share)).drop("__longest")
