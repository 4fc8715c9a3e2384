"""Queries of the streaming operators: the given tables as a stream, run until what is there has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import alerts as rules
from tidegate.plans.contracts import CSV_WRITE
from tidegate.plans.history import (
    MIX_SQL, ROLLING_SQL, SAMPLE_SQL, STATS_SQL, event_state, readings,
)
from tidegate.plans.registry import query, table
from tidegate.scale import scratch_path
from tidegate.streaming import machines, tables, windows


# Parts in which a table arrives, files of a part, and by how much the late third of the rows before a cut comes later.
ARRIVALS, FILES, LATE = 3, 4, "9 minutes"
_ARRIVED: dict[tuple, str] = {}


def event_stream(spark: SparkSession, sf_dir: str, *, closing: bool = False) -> DataFrame:
    """The events in the order of their times, but for some late ones, over several micro-batches.

    With ``closing``, a last part moves the watermark past the end of the table: one row of each type, a day later, with an
    id below 0. Its windows and runs stay open, so it adds no row to a result.
    """
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    key = (spark.sparkContext.applicationId, sf_dir, closing)
    if key not in _ARRIVED:
        folder = scratch_path(spark, "arrivals")
        low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
        shown = F.unix_micros(F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr(f"INTERVAL {LATE}")).otherwise(F.col("ts")))
        part = F.least(F.lit(ARRIVALS - 1), F.floor((shown - low) * ARRIVALS / ((high or 0) - (low or 0) + 1))).cast("int")
        for number in range(ARRIVALS):
            events.filter(F.coalesce(part, F.lit(0)) == number).repartition(FILES).write.mode("append").parquet(folder)
        if closing:
            last = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
            rows = last.select("ts", F.posexplode(F.array(F.lit("view"), F.lit("click"))).alias("n", "event_type"))
            rows = rows.withColumn("event_id", (-10 - F.col("n")).cast("long"))
            rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                          for f in events.schema.fields]).write.mode("append").parquet(folder)
        _ARRIVED[key] = folder
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(_ARRIVED[key])


def emitted(stream: DataFrame, name: str) -> DataFrame:
    """What the stream has emitted when everything there has been read."""
    output = scratch_path(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{output}-progress").trigger(availableNow=True)
    writer.start(output).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(output)


def updated(stream: DataFrame, name: str, key: list[str]) -> DataFrame:
    """The newest row of each key when everything there has been read, open windows included."""
    spark, base = stream.sparkSession, scratch_path(stream.sparkSession, name)
    tables.keep_updates(stream, f"{base}/out", f"{base}/progress").awaitTermination()
    return tables.newest(spark, f"{base}/out", key)


def plain(*names: str) -> list:
    """Timestamps as they are stored in the tables, without a zone."""
    return [F.col(name).cast("timestamp_ntz").alias(name) for name in names]


SHARE_SQL = """CASE WHEN success + failed = 0 THEN -1.0 ELSE success / CAST(success + failed AS DOUBLE) END AS success_share"""


@query(f"""
    SELECT *, {SHARE_SQL} FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start,
        time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS window_end, {MIX_SQL} FROM events GROUP BY 1, 2)""")
def stream_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir).withColumn("state", event_state(F.col("event_type")))
    out = updated(windows.windowed_mix(events), "mix", ["window_start", "window_end"])
    return out.select(*plain("window_start", "window_end"), "success", "failed", "running", "waiting", "success_share")


@query(f"""
    SELECT *, {SHARE_SQL} FROM (SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, {MIX_SQL} FROM (
        SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM events
        UNION ALL SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE FROM events) GROUP BY 1, 2)""")
def stream_mix_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir).withColumn("state", event_state(F.col("event_type")))
    out = updated(windows.windowed_mix(events, slide="5 minutes"), "sliding", ["window_start", "window_end"])
    return out.select(*plain("window_start", "window_end"), "success", "failed", "running", "waiting", "success_share")


@query("""SELECT DISTINCT user_id || ':' || date_trunc('hour', ts) AS run_id, 'end' AS kind FROM events WHERE event_type = 'click'""")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").cast("string")
    ends = event_stream(spark, sf_dir).select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), hour).alias("run_id"),
        F.when(F.col("event_type") == "click", "end").otherwise("begin").alias("kind"), "ts",
    )
    return emitted(windows.dedupe_ends(ends, delay="2 hours"), "ends").select("run_id", "kind")


@query("""
    SELECT b.event_id AS run_id, b.ts AS started_at, e.ts AS ended_at,
           CAST(epoch_us(e.ts) // 1000 - epoch_us(b.ts) // 1000 AS BIGINT) AS duration_ms
    FROM events b LEFT JOIN events e ON e.event_id = b.event_id + 1 AND e.event_type = 'click'
         AND e.ts >= b.ts AND e.ts <= b.ts + INTERVAL 5 MINUTE
    WHERE b.event_type = 'view'""")
def stream_match_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir, closing=True)
    begins = events.filter(F.col("event_type") == "view").select(F.col("event_id").alias("run_id"), "ts")
    ends = event_stream(spark, sf_dir, closing=True).filter(F.col("event_type") == "click").select((F.col("event_id") - 1).alias("run_id"), "ts")
    matched = emitted(windows.match_runs(begins, ends, timeout="5 minutes"), "matched")
    return matched.select("run_id", *plain("started_at", "ended_at"), "duration_ms")


@query("""
    WITH b AS (SELECT event_id, min(ts) AS at FROM events WHERE event_type = 'view' GROUP BY 1),
    e AS (SELECT event_id, min(ts) AS at FROM events WHERE event_type = 'click' GROUP BY 1),
    m AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS mark FROM events WHERE event_type IN ('view', 'click'))
    SELECT CAST(b.event_id AS VARCHAR) AS run, CASE WHEN e.at <= b.at + INTERVAL 5 MINUTE THEN 'finished' WHEN e.at IS NOT NULL THEN 'late'
        WHEN (epoch_us(b.at) + 300000000) // 1000 + 1 <= mark THEN 'unfinished' ELSE 'running' END AS status,
        b.at AS started_at, e.at AS ended_at, CAST(epoch_us(e.at) // 1000 - epoch_us(b.at) // 1000 AS BIGINT) AS duration_ms
    FROM m, b LEFT JOIN e ON e.event_id = b.event_id + 1 AND e.at >= b.at""")
def stream_run_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id")
    events = event_stream(spark, sf_dir).select(
        F.when(kind == "view", number).otherwise(number - 1).alias("run_id"), F.when(kind == "view", "begin").when(kind == "click", "end").alias("kind"), "ts")
    lives = emitted(machines.run_lives(events, timeout_minutes=5), "lives")
    last = lives.groupBy("run").agg(F.max("version").alias("version"))
    return lives.join(last, ["run", "version"]).select("run", "status", *plain("started_at", "ended_at"), "duration_ms")


@query("""
    SELECT date_trunc('hour', ts) AS window_start, count(*) AS "rows",
           CAST(sum(CAST(event_type = 'view' AS BIGINT) + CAST(event_id % 3 = 0 AS BIGINT)) AS BIGINT) AS blank_cells,
           count(*) FILTER (event_type = 'view' AND event_id % 3 = 0) AS blank_rows,
           count(*) - count(DISTINCT (CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END,
               CASE WHEN event_id % 3 = 0 THEN '' ELSE coalesce(CAST(props AS VARCHAR), '') END)) AS duplicate_rows
    FROM events GROUP BY 1""")
def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = emitted(windows.windowed_quality(cells_of(event_stream(spark, sf_dir, closing=True)), ["kind", "props"]), "quality")
    return out.select(*plain("window_start"), "rows", "blank_cells", "blank_rows", "duplicate_rows")


@query("""
    WITH c AS (SELECT ts, event_type = 'view' AS a, event_id % 3 = 0 AS b, CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END AS kind,
        CASE WHEN event_id % 3 = 0 THEN '' ELSE coalesce(CAST(props AS VARCHAR), '') END AS props FROM events),
    d AS (SELECT *, ts - lag(ts) OVER (PARTITION BY kind, props ORDER BY ts) <= INTERVAL 1 HOUR AS follows FROM c)
    SELECT date_trunc('hour', ts) AS window_start, count(*) AS "rows", CAST(sum(CAST(a AS BIGINT) + CAST(b AS BIGINT)) AS BIGINT) AS blank_cells,
        count(*) FILTER (a AND b) AS blank_rows, count(*) FILTER (follows) AS duplicate_rows
    FROM d GROUP BY 1""")
def stream_quality_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = cells_of(event_stream(spark, sf_dir, closing=True))
    out = emitted(machines.quality_across_windows(events, ["kind", "props"]), "across")
    return out.select(*plain("window_start"), "rows", "blank_cells", "blank_rows", "duplicate_rows")


def cells_of(events: DataFrame) -> DataFrame:
    return events.select(
        "ts", F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("kind"),
        F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("props")).alias("props"),
    )


@query(ROLLING_SQL)
def stream_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "delta")
    stream = tables.rolling_rejections(
        readings(event_stream(spark, sf_dir)), f"{base}/out", f"{base}/state", f"{base}/progress", key=["event_type"], order=["event_id"]
    )
    stream.awaitTermination()
    return tables.newest(spark, f"{base}/out", ["event_type", "event_id"]).select("event_type", "event_id", "increase", "rolling")


@query(f"""
    SELECT event_type, {STATS_SQL}, arg_max(CASE event_type WHEN 'error' THEN 'DOWN' WHEN 'signup' THEN 'DEGRADED' ELSE 'UP' END, ts) AS latest_state
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM ({SAMPLE_SQL}))
    WHERE n <= 120 GROUP BY event_type""")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, kind = scratch_path(spark, "latest"), F.col("event_type")
    samples = event_stream(spark, sf_dir).select(
        "event_type", "event_id", F.col("ts").alias("at"),
        F.when(kind == "error", "DOWN").when(kind == "signup", "DEGRADED").otherwise("UP").alias("state"),
        F.when((kind != "error") & (F.col("event_id") % 7 != 0), F.col("value")).alias("latency_ms"),
    )
    stream = tables.latest_state(
        samples, f"{base}/out", f"{base}/state", f"{base}/progress", key=["event_type"], order=["at", "event_id"]
    )
    stream.awaitTermination()
    return tables.newest(spark, f"{base}/out", ["event_type"])


@query("""
    WITH b AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events),
    p AS (SELECT CAST(least(2, floor((epoch_us(ts) + CASE WHEN event_id % 3 = 0 THEN 540000000 ELSE 0 END - low) * 3 / (high - low + 1))) AS INTEGER) AS batch,
        count(*) FILTER (event_type = 'error') AS n FROM events, b GROUP BY 1),
    l AS (SELECT *, lag(n) OVER (ORDER BY batch) AS before FROM p WHERE n > 0)
    SELECT batch, 'import-errors' AS key, 'FAILED' AS level, n || ' 个 DAG 文件无法解析' AS title, CAST(NULL AS VARCHAR) AS detail, 'MONITOR' AS target,
        CAST(NULL AS VARCHAR) AS dag_id, CASE WHEN before IS NULL THEN 'insert' ELSE 'update' END AS change, true AS changed
    FROM l WHERE before IS NULL OR before <> n""")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "alerts")

    def fired(batch: DataFrame) -> DataFrame:
        errors = batch.filter(F.col("event_type") == "error").select(
            F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("filename"), F.col("event_id").alias("position")
        )
        return rules.alerts(errors=errors)

    stream = tables.alert_changes(event_stream(spark, sf_dir), fired, f"{base}/out", f"{base}/state", f"{base}/progress")
    stream.awaitTermination()
    return tables.appended(spark, f"{base}/out")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "landing")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    customers.write.options(**CSV_WRITE).csv(f"{base}/in")
    ragged = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    ragged.write.mode("append").options(**CSV_WRITE).csv(f"{base}/in")
    stream = tables.ingest_landing(
        spark, f"{base}/in", f"{base}/out", f"{base}/bad", f"{base}/progress",
        schema="c_custkey BIGINT, c_name STRING, c_mktsegment STRING",
    )
    stream.awaitTermination()
    return tables.appended(spark, f"{base}/out").drop("batch")


