"""Alert rules over backends, import errors, pools, tasks and rejections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.states import pool_exhausted

# Levels in order, targets, and the texts of the rules.
LEVELS = ["FAILED", "WARNING"]
SETTINGS, MONITOR, PIPELINE = "SETTINGS", "MONITOR", "PIPELINE"
DOWN, UNAUTHORIZED, DEGRADED = " 不可达", " 认证失败", " 状态异常"
IMPORT_ERRORS = "%d 个 DAG 文件无法解析"
POOL_TITLE, POOL_DETAIL = "资源池 %s 已满", "共 %d 个槽位，运行 %d，排队 %d，空闲 0。"
RETRIES, TASK_NAME = "%d 个任务等待重试", "%s · %s"
REJECTED = "引擎拒绝了 %d 次运行"
REJECTED_DETAIL = "同时运行数已达上限 %d，新的运行请求被拒绝。稍后再试，或提高引擎的并发上限。"


def _alert(rule: int, key, level, title, detail, target, dag_id=None, position=None) -> list[Column]:
    def column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return [
        column(key).alias("key"), column(level).alias("level"), column(title).alias("title"),
        column(detail).alias("detail"), column(target).alias("target"), column(dag_id).alias("dag_id"),
        F.lit(rule).alias("rule"), (F.lit("") if position is None else position).alias("position"),
    ]


def backend_alerts(backends: DataFrame) -> DataFrame:
    """From (key, name, state, summary, position): one alert per backend that is down, unauthorized or degraded."""
    state = F.col("state")
    suffix = F.when(state == "DOWN", "down").when(state == "UNAUTHORIZED", "unauthorized").when(state == "DEGRADED", "degraded")
    text = F.when(state == "DOWN", DOWN).when(state == "UNAUTHORIZED", UNAUTHORIZED).otherwise(DEGRADED)
    warning = state == "DEGRADED"
    return backends.filter(suffix.isNotNull()).select(
        *_alert(
            0, F.concat(F.col("key"), F.lit(":"), suffix), F.when(warning, "WARNING").otherwise("FAILED"),
            F.concat(F.col("name"), text), F.col("summary"), F.when(warning, MONITOR).otherwise(SETTINGS),
            position=F.format_string("%020d", F.col("position").cast("long")),
        )
    )


def import_error_alert(errors: DataFrame) -> DataFrame:
    """From (filename, position): one alert for all files that cannot be parsed; ``alert_names`` lists them."""
    return errors.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        *_alert(1, "import-errors", "FAILED", F.format_string(IMPORT_ERRORS, "n"), None, MONITOR)
    )


def pool_alerts(pools: DataFrame) -> DataFrame:
    """From (name, slots, running, queued, scheduled, open): one alert per full pool with waiting work."""
    full = pool_exhausted(F.col("slots"), F.col("open"), F.col("queued"), F.col("scheduled"))
    waiting = F.col("queued") + F.col("scheduled")
    return pools.filter(full).select(
        *_alert(
            2, F.concat(F.lit("pool:"), F.col("name")), "WARNING", F.format_string(POOL_TITLE, "name"),
            F.format_string(POOL_DETAIL, "slots", "running", waiting), MONITOR, position=F.col("name"),
        )
    )


def waiting_for_retry(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("state") == "up_for_retry")


def retry_alert(tasks: DataFrame) -> DataFrame:
    """From (dag_id, task_id, state, position): one alert for all tasks that wait for a retry; ``alert_names`` lists them."""
    counts = waiting_for_retry(tasks).agg(F.count(F.lit(1)).alias("n"), F.min("dag_id").alias("first"), F.max("dag_id").alias("last"))
    single = F.col("first") == F.col("last")
    return counts.filter("n > 0").select(
        *_alert(
            3, "retries", "WARNING", F.format_string(RETRIES, "n"), None,
            F.when(single, PIPELINE).otherwise(MONITOR), F.when(single, F.col("first")),
        )
    )


def rejection_alert(rejections: DataFrame) -> DataFrame:
    """From (rejected_recently, max_concurrent_runs): an alert when runs were turned away lately."""
    return rejections.filter(F.col("rejected_recently") > 0).select(
        *_alert(
            4, "engine:rejected", "WARNING", F.format_string(REJECTED, "rejected_recently"),
            F.format_string(REJECTED_DETAIL, "max_concurrent_runs"), MONITOR,
        )
    )


def alert_names(errors: DataFrame | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """(key, position, name): what the alerts about files and tasks are about, a row per name, as many as there are."""
    listed = []
    if errors is not None:
        listed.append(errors.select(F.lit("import-errors").alias("key"), F.col("position").cast("long"), F.col("filename").alias("name")))
    if tasks is not None:
        name = F.format_string(TASK_NAME, "dag_id", "task_id")
        listed.append(waiting_for_retry(tasks).select(F.lit("retries").alias("key"), F.col("position").cast("long"), name.alias("name")))
    return reduce(lambda a, b: a.unionByName(b), listed)


def alerts(
    backends: DataFrame | None = None, errors: DataFrame | None = None, pools: DataFrame | None = None,
    tasks: DataFrame | None = None, rejections: DataFrame | None = None, *, ranked: bool = False,
) -> DataFrame:
    """(key, level, title, detail, target, dag_id) of every rule that fires, by level, then rule, then input order."""
    rules = [(backend_alerts, backends), (import_error_alert, errors), (pool_alerts, pools), (retry_alert, tasks),
             (rejection_alert, rejections)]
    fired = reduce(lambda a, b: a.unionByName(b), [rule(df) for rule, df in rules if df is not None])
    level = F.array_position(F.array(*[F.lit(name) for name in LEVELS]), F.col("level"))
    ordered = fired.orderBy(level, "rule", "position")
    return ordered if ranked else ordered.drop("rule", "position")
