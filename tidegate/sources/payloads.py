"""Rows from nested API answers: arrays of pipelines, runs, tasks, pools and errors in JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.states import ACTIVE_STATES
from tidegate.functions.text import log_line


def flatten_payload(df: DataFrame, json_col: str, array_field: str, schema: str, *, keep: list[str] | None = None) -> DataFrame:
    """One row per element of ``array_field`` with its place; an answer without that array has no rows."""
    parsed = F.from_json(F.col(json_col), f"struct<`{array_field}`: array<struct<{schema}>>>")
    kept = keep if keep is not None else [name for name in df.columns if name != json_col]
    rows = df.select(*kept, F.posexplode(parsed[array_field]).alias("position", "item"))
    return rows.select(*kept, "position", "item.*")


def _text(name: str, default: Column | str = "") -> Column:
    return F.coalesce(F.col(name), default if isinstance(default, Column) else F.lit(default)).alias(name)


def _number(name: str, default: int = 0) -> Column:
    return F.coalesce(F.col(name), F.lit(default)).alias(name)


def _instant(name: str) -> Column:
    return F.col(name).try_cast("timestamp").alias(name)


def tag_texts(tags: Column) -> Column:
    """Tags are plain texts or objects with a name."""
    return F.transform(
        tags,
        lambda tag: F.when(F.schema_of_variant(tag) == "STRING", F.try_variant_get(tag, "$", "string")).otherwise(
            F.coalesce(F.try_variant_get(tag, "$.name", "string"), F.lit(""))
        ),
    )


def pipelines(df: DataFrame, json_col: str, **options) -> DataFrame:
    schema = (
        "dag_id: string, dag_display_name: string, is_paused: boolean, description: string, timetable_summary: string, "
        "tags: array<variant>, has_import_errors: boolean, next_dagrun_run_after: string"
    )
    rows = flatten_payload(df, json_col, "dags", schema, **options)
    own = {"position", *[part.split(":")[0].strip() for part in schema.split(",")]}
    return rows.select(
        *[name for name in rows.columns if name not in own], "position", _text("dag_id"),
        _text("dag_display_name", F.coalesce("dag_id", F.lit(""))),
        F.coalesce("is_paused", F.lit(False)).alias("is_paused"), _text("description"), _text("timetable_summary"),
        F.coalesce(tag_texts(F.col("tags")), F.array().cast("array<string>")).alias("tags"),
        F.coalesce("has_import_errors", F.lit(False)).alias("has_import_errors"), _instant("next_dagrun_run_after"),
    )


def pipeline_runs(df: DataFrame, json_col: str, **options) -> DataFrame:
    schema = (
        "dag_run_id: string, dag_id: string, state: string, run_type: string, queued_at: string, start_date: string, "
        "end_date: string, duration: double, run_after: string, conf: map<string,string>, note: string, triggered_by: string"
    )
    rows = flatten_payload(df, json_col, "dag_runs", schema, **options)
    kept = rows.columns[: rows.columns.index("position")]
    return rows.select(
        *kept, "position", _text("dag_run_id"), _text("dag_id"), _text("state"), _text("run_type"), _instant("queued_at"),
        _instant("start_date"), _instant("end_date"), F.round(F.col("duration") * 1000).cast("long").alias("duration_ms"),
        _instant("run_after"), "conf", _text("note"), _text("triggered_by"),
    )


def pipeline_tasks(df: DataFrame, json_col: str, **options) -> DataFrame:
    schema = "task_id: string, task_display_name: string, downstream_task_ids: array<string>, operator_name: string"
    rows = flatten_payload(df, json_col, "tasks", schema, **options)
    kept = rows.columns[: rows.columns.index("position")]
    return rows.select(
        *kept, "position", _text("task_id"), _text("task_display_name", F.coalesce("task_id", F.lit(""))),
        F.coalesce("downstream_task_ids", F.array().cast("array<string>")).alias("downstream"), _text("operator_name"),
    )


_INSTANCE = (
    "task_id: string, task_display_name: string, map_index: int, state: string, try_number: int, max_tries: int, "
    "start_date: string, end_date: string, duration: double, operator_name: string, operator: string, dag_id: string, "
    "dag_run_id: string, queued_when: string"
)


def task_instances(df: DataFrame, json_col: str, **options) -> DataFrame:
    rows = flatten_payload(df, json_col, "task_instances", _INSTANCE, **options)
    kept = rows.columns[: rows.columns.index("position")]
    operator = F.when(F.coalesce("operator_name", F.lit("")) != "", F.col("operator_name")).otherwise(
        F.coalesce("operator", F.lit(""))
    )
    return rows.select(
        *kept, "position", _text("task_id"), _text("task_display_name", F.coalesce("task_id", F.lit(""))),
        _number("map_index", -1), "state", _number("try_number"), _number("max_tries"), _instant("start_date"),
        _instant("end_date"), F.round(F.col("duration") * 1000).cast("long").alias("duration_ms"),
        operator.alias("operator"),
    )


def active_tasks(df: DataFrame, json_col: str, **options) -> DataFrame:
    """Task instances that run or wait now; those without an id are left out."""
    rows = flatten_payload(df, json_col, "task_instances", _INSTANCE, **options)
    kept = rows.columns[: rows.columns.index("position")]
    live = rows.filter((F.coalesce("task_id", F.lit("")) != "") & F.col("state").isin(ACTIVE_STATES))
    return live.select(
        *kept, "position", _text("dag_id"), _text("dag_run_id"), "task_id", _text("task_display_name", F.col("task_id")),
        _number("map_index", -1), _text("state"), _number("try_number"), _number("max_tries"), _instant("start_date"),
        _instant("queued_when"),
    )


def import_errors(df: DataFrame, json_col: str, **options) -> DataFrame:
    schema = "import_error_id: long, filename: string, timestamp: string, stack_trace: string"
    rows = flatten_payload(df, json_col, "import_errors", schema, **options)
    kept = rows.columns[: rows.columns.index("position")]
    return rows.select(
        *kept, "position", F.coalesce("import_error_id", F.lit(0).cast("long")).alias("id"), _text("filename"),
        _instant("timestamp"), _text("stack_trace"),
    )


def pools(df: DataFrame, json_col: str, **options) -> DataFrame:
    schema = (
        "name: string, slots: int, running_slots: int, queued_slots: int, scheduled_slots: int, deferred_slots: int, "
        "open_slots: int"
    )
    rows = flatten_payload(df, json_col, "pools", schema, **options)
    kept = rows.columns[: rows.columns.index("position")]
    counts = [F.coalesce(f"{name}_slots", F.lit(0)).alias(name) for name in ("running", "queued", "scheduled", "deferred", "open")]
    return rows.select(*kept, "position", _text("name"), _number("slots"), *counts)


def log_lines(df: DataFrame, json_col: str, *, keep: list[str] | None = None) -> DataFrame:
    """One row per line of a log answer, whose content mixes texts, arrays and objects."""
    kept = keep if keep is not None else [name for name in df.columns if name != json_col]
    content = F.from_json(F.col(json_col), "struct<content: array<variant>>")["content"]
    entries = df.select(*kept, F.posexplode(content).alias("entry", "value"))
    shape = F.schema_of_variant("value")
    parts = F.when(shape.startswith("ARRAY"), F.try_variant_get("value", "$", "array<variant>")).otherwise(F.array("value"))
    lines = entries.select(*kept, "entry", F.posexplode(parts).alias("part", "value"))

    def field(name: str) -> Column:
        return F.try_variant_get("value", f"$.{name}", "string")

    event = F.coalesce(field("event"), F.to_json("value"))
    line = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string")).otherwise(
        log_line(field("timestamp"), field("level"), event)
    )
    return lines.select(*kept, "entry", "part", line.alias("line"))
