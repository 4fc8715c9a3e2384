"""Queries of the run-history operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions import maps, text
from tidegate.functions.sql import register_sql_functions
from tidegate.functions.states import is_active, run_tone
from tidegate.operators import alerts as rules
from tidegate.operators import changes, costs, counters, latency, levels, mix, ranges, runs
from tidegate.plans.registry import query, table
from tidegate.scale import newest_per
from tidegate.sources import payloads

# How the given tables stand in for run states; the same cases in SQL.
STATES = {"click": " Success", "purchase": "SUCCEEDED", "error": "upstream_failed", "view": "up_for_retry", "signup": "running"}
TONE_SQL = {"success": ("click", "purchase"), "failed": ("error",), "waiting": ("view",), "running": ("signup",)}


def event_state(column: Column) -> Column:
    state = None
    for kind, value in STATES.items():
        state = F.when(column == kind, value) if state is None else state.when(column == kind, value)
    return state


def count_sql(tone: str) -> str:
    kinds = ", ".join(f"'{kind}'" for kind in TONE_SQL[tone])
    return f"count(*) FILTER (event_type IN ({kinds}))"


MIX_SQL = ", ".join(f"{count_sql(tone)} AS {tone}" for tone in ("success", "failed", "running", "waiting"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("state", event_state(F.col("event_type")))


@query(f"SELECT user_id, {MIX_SQL} FROM events GROUP BY user_id")
def run_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.run_mix(event_runs(spark, sf_dir), ("user_id",))


@query("""
    SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus IN ('F', 'O')) = 0 THEN -1.0
        ELSE count(*) FILTER (o_orderstatus = 'O') / CAST(count(*) FILTER (o_orderstatus IN ('F', 'O')) AS DOUBLE) END AS success_share
    FROM orders GROUP BY o_custkey""")
def success_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    state = F.when(status == "O", "success").when(status == "F", "failed").otherwise("queued")
    return mix.success_share(table(spark, sf_dir, "orders").withColumn("state", state), ("o_custkey",))


@query("""
    SELECT event_id, CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED'
           WHEN 'view' THEN 'WAITING' ELSE 'RUNNING' END AS tone FROM events WHERE event_type IN ('view', 'signup')""")
def active_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    toned = mix.with_tone(event_runs(spark, sf_dir))
    return toned.filter(is_active(F.col("tone"))).select("event_id", "tone")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_type", "event_id", F.col("ts").alias("at"),
        F.when(kind == "error", "DOWN").when(kind == "signup", "DEGRADED").otherwise("UP").alias("state"),
        F.when((kind != "error") & (F.col("event_id") % 7 != 0), F.col("value")).alias("latency_ms"),
    )


SAMPLE_SQL = """
    SELECT event_type, user_id, event_id, ts, event_type <> 'error' AS up,
           CASE WHEN event_type <> 'error' AND event_id % 7 <> 0 THEN value END AS latency FROM events"""
STATS_SQL = """
    count(*) AS checks, count(*) FILTER (up) AS reachable, arg_max(latency, ts) FILTER (latency IS NOT NULL) AS latest,
    median(latency) AS median, max(latency) AS worst, count(*) FILTER (up) / CAST(count(*) AS DOUBLE) AS availability"""


@query(f"SELECT event_type, {STATS_SQL} FROM ({SAMPLE_SQL}) GROUP BY event_type")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.latency_stats(samples(spark, sf_dir), ["event_type"])


@query(f"SELECT {STATS_SQL} FROM ({SAMPLE_SQL})")
def latency_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.latency_stats(samples(spark, sf_dir), [])


@query("""
    SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    WHERE n <= 10""")
def newest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return newest_per(events, ["user_id"], ["ts", "event_id"], runs.RIBBON)


@query("""
    SELECT c_custkey, coalesce(n, 0) AS shown, coalesce(keys, '') AS keys FROM customer LEFT JOIN (
        SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey DESC) AS keys
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
        WHERE r <= 10 GROUP BY o_custkey) ON o_custkey = c_custkey""")
def pipelines_with_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    joined = runs.with_newest_runs(customers, orders, "c_custkey", ["o_orderdate", "o_orderkey"], fields=["o_orderkey"])
    keys = F.array_join(F.transform("runs", lambda run: run["o_orderkey"].cast("string")), ",")
    return joined.select("c_custkey", F.size("runs").cast("long").alias("shown"), keys.alias("keys"))


@query("""
    SELECT * FROM (
        SELECT 'job:' || event_id AS key, event_type AS name, false AS pipeline, ts AS started_at FROM events
        UNION ALL SELECT 'dag:' || o_orderkey, o_orderpriority, true, o_orderdate FROM orders)
    ORDER BY started_at DESC, key LIMIT 8""")
def recent_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select(
        F.concat(F.lit("job:"), F.col("event_id").cast("string")).alias("key"), F.col("event_type").alias("name"),
        F.lit(False).alias("pipeline"), F.col("ts").alias("started_at"),
    )
    pipelines = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("dag:"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("name"),
        F.lit(True).alias("pipeline"), F.col("o_orderdate").alias("started_at"),
    )
    return runs.recent_feed(jobs, pipelines)


def latest_ts(spark: SparkSession, sf_dir: str) -> Column:
    return F.lit(table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


@query("""
    SELECT event_type, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events
        WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY) WHERE n <= 200""")
def retention_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    kept = runs.retain(events, ["event_type"], ["ts", "event_id"], days=runs.KEEP_DAYS, now=latest_ts(spark, sf_dir))
    return kept.select("event_type", "event_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY")
def ttl_14d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.within_days(table(spark, sf_dir, "events"), "ts", latest_ts(spark, sf_dir)).select("event_id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def keep_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.keep_newest(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"])


@query("""
    SELECT event_type, event_id, CAST(count(*) OVER (PARTITION BY event_type) - n + 1 AS INTEGER) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_id % 5 <> 0)
    WHERE n <= 120""")
def last_120_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_id") % 5 == 0, "NOT_CONFIGURED").otherwise("UP")
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", state.alias("state"))
    kept = runs.last_samples(events, ["event_type"], ["ts", "event_id"], state="state")
    return kept.select("event_type", "event_id", "place")


@query("""
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
    FROM events) WHERE n = 1""")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return runs.latest_of(events, ["user_id"], ["ts", "event_id"]).drop("ts")


READING_SQL = """
    SELECT event_type, event_id, ts, date_trunc('day', ts) AS started_at, (event_id * 7919) % 1000 AS rejected FROM events"""
INCREASE_SQL = f"""
    SELECT *, CASE WHEN lag(started_at) OVER w = started_at THEN greatest(0, rejected - lag(rejected) OVER w) ELSE 0 END AS increase
    FROM ({READING_SQL}) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"""
ROLLING_SQL = f"""
    SELECT event_type, event_id, CAST(increase AS BIGINT) AS increase, CAST(sum(increase) OVER (
        PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling
    FROM ({INCREASE_SQL})"""


def readings(events: DataFrame) -> DataFrame:
    return events.select(
        "event_type", "event_id", "ts", F.date_trunc("day", "ts").alias("started_at"),
        ((F.col("event_id") * 7919) % 1000).alias("rejected"),
    )


@query(f"SELECT event_type, event_id, CAST(increase AS BIGINT) AS increase FROM ({INCREASE_SQL})")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = counters.counter_increase(
        readings(table(spark, sf_dir, "events")), ["event_type"], "ts", "rejected", order=["event_id"]
    )
    return grown.select("event_type", "event_id", "increase")


@query(ROLLING_SQL)
def rolling_10min(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = counters.counter_increase(
        readings(table(spark, sf_dir, "events")), ["event_type"], "ts", "rejected", order=["event_id"]
    )
    return counters.rolling_sum(grown, ["event_type"], "ts", "increase").select("event_type", "event_id", "increase", "rolling")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN longest <= 0 THEN 1.0 ELSE least(1.0, sqrt(l_quantity / longest)) END AS share
    FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS longest FROM lineitem)""")
def duration_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return runs.duration_share(lines, ["l_orderkey"], "l_quantity", spread_by=["l_linenumber", "l_partkey"])


RUN_SQL = """
    SELECT user_id || ':' || CAST(ts AS DATE) AS run_id, 'user ' || user_id AS job, ts, value < 50 AS ok,
           CASE event_type WHEN 'view' THEN 'begin' WHEN 'click' THEN 'end' WHEN 'error' THEN 'rejected' ELSE 'other' END AS kind
    FROM events"""
BY_RUN_SQL = f"""
    SELECT run_id, min(ts) FILTER (kind = 'begin') AS started_at, arg_min(job, ts) FILTER (kind = 'begin') AS job,
           min(ts) FILTER (kind = 'end') AS ended_at, arg_min(ok, ts) FILTER (kind = 'end') AS ok
    FROM ({RUN_SQL}) GROUP BY run_id HAVING count(*) FILTER (kind = 'begin') > 0"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(user, F.lit(":"), F.to_date("ts").cast("string")).alias("run_id"), F.concat(F.lit("user "), user).alias("job"),
        "ts", (F.col("value") < 50).alias("ok"),
        F.when(kind == "view", "begin").when(kind == "click", "end").when(kind == "error", "rejected").otherwise("other").alias("kind"),
    )


@query(f"""
    SELECT count(*) AS started, count(*) FILTER (ended_at IS NOT NULL AND ok) AS succeeded,
           count(*) FILTER (ended_at IS NOT NULL AND NOT ok) AS failed,
           (SELECT count(*) FROM events WHERE event_type = 'error') AS rejected FROM ({BY_RUN_SQL})""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_counters(run_events(spark, sf_dir))


@query(f"""
    SELECT run_id, job, started_at, CAST((epoch_us((SELECT max(ts) FROM events)) // 1000) - (epoch_us(started_at) // 1000) AS BIGINT) AS elapsed_ms
    FROM ({BY_RUN_SQL}) WHERE ended_at IS NULL""")
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.active_runs(run_events(spark, sf_dir), latest_ts(spark, sf_dir))


@query("""
    SELECT event_id, event_type, ts FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 ORDER BY ts DESC, event_id DESC LIMIT 500""")
def merge_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    loaded, early = events.filter(F.col("event_id") % 2 == 0), events.filter(F.col("event_id") % 3 == 0)
    return changes.merge_early(loaded, early, ["ts", "event_id"], runs.ACTIVITY_KEEP)


@query("""
    SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 7 = 3 THEN 'update' ELSE 'unchanged' END AS change, c_custkey % 7 = 3 AS changed
    FROM customer WHERE c_custkey % 7 NOT IN (1, 2)
    UNION ALL SELECT c_custkey, c_name, c_acctbal, 'delete', true FROM customer WHERE c_custkey % 7 = 1
    UNION ALL SELECT c_custkey, c_name, c_acctbal, 'insert', true FROM customer WHERE c_custkey % 7 = 2""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("c_custkey") % 7
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    edited = F.when(part == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    new = customers.filter(part != 1).withColumn("c_acctbal", edited)
    return changes.snapshot_diff(customers.filter(part != 2), new, ["c_custkey"])


@query("""
    SELECT user_id, event_type, event_id, props FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props", "ts")
    return changes.upsert_latest(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
    WITH advisory AS (
        SELECT p_brand || '/' || p_type AS advisory, p_brand AS brand, min(p_size) + 3 AS lo, min(p_size) + 9 AS hi,
               max(p_size) - 4 AS lo2, max(p_size) - 1 AS last2 FROM part GROUP BY p_brand, p_type)
    SELECT p_partkey, advisory FROM part JOIN advisory ON brand = p_brand
    WHERE (p_size >= lo AND p_size < hi)
       OR (p_size >= lo2 AND (p_size < last2 OR (p_size = last2 AND p_partkey % 4 = 0)))
       OR (p_size = 7 AND p_partkey % 4 = 1)""")
def version_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string"))
    items = parts.select("p_partkey", F.lit("parts").alias("ecosystem"), F.upper("p_brand").alias("name"), version.alias("version"))

    def event(kind: str, size: Column) -> Column:
        text_of = size.cast("string")
        return F.struct(*[(text_of if name == kind else F.lit(None).cast("string")).alias(name)
                          for name in ("introduced", "fixed", "last_affected")])

    low, high = F.min("p_size"), F.max("p_size")
    spans = F.array(
        F.array(event("fixed", low + 9), event("introduced", low + 3)),
        F.array(event("introduced", high - 4), event("last_affected", F.concat((high - 1).cast("string"), F.lit(".0")))),
    )
    advisories = parts.groupBy("p_brand", "p_type").agg(spans.alias("ranges")).select(
        F.concat_ws("/", "p_brand", "p_type").alias("id"), F.lit("parts").alias("ecosystem"), F.col("p_brand").alias("name"),
        F.array(F.lit("v7.1")).alias("versions"), "ranges",
    )
    return ranges.match_ranges(items, advisories).select("p_partkey", "advisory")


@query("""
    WITH placed AS (
        SELECT conv_id || ':' || turn AS id, conv_id * 1000 + turn AS position,
               CAST(CASE WHEN conv_id % 10 = 0 THEN 0 ELSE turn END AS INTEGER) AS level FROM conversations)
    SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY position) - 1 AS row FROM placed""")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")

    def place(number: Column) -> Column:
        return F.concat(conv, F.lit(":"), number.cast("string"))

    back = F.when(F.col("conv_id") % 10 == 0, place(F.lit(0))).otherwise(place(turn + 2))
    nodes = table(spark, sf_dir, "conversations").select(
        place(turn).alias("id"), F.array(place(turn + 1), back, F.lit("unknown")).alias("downstream"),
        (F.col("conv_id") * 1000 + turn).alias("position"),
    )
    return levels.graph_levels(nodes)


def segment_rates(customers: DataFrame) -> DataFrame:
    """Rates of four market segments by their place in the alphabet: odd ones pay by month, even ones by hour."""
    number = F.row_number().over(Window.orderBy("plan"))
    named = customers.select(F.col("c_mktsegment").alias("plan")).distinct().withColumn("n", number).filter("n < 5")
    text = F.col("n").cast("string")
    return named.select(
        "plan", F.when(F.col("n") % 2 == 1, F.concat(text, F.lit("7.5"))).alias("monthly"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("0.0"), text, F.lit("1"))).alias("hourly"),
        F.when(F.col("n") != 3, F.concat(text, F.lit(".25"))).alias("disk"), (F.col("n") != 4).alias("complete"),
    )


@query("""
    WITH named AS (SELECT plan, row_number() OVER (ORDER BY plan) AS n FROM (SELECT DISTINCT c_mktsegment AS plan FROM customer)),
    rates AS (SELECT plan, CASE WHEN n % 2 = 1 THEN CAST(n || '7.5' AS DECIMAL(18,10)) END AS monthly,
                     CASE WHEN n % 2 = 0 THEN CAST('0.0' || n || '1' AS DECIMAL(18,10)) END AS hourly,
                     CASE WHEN n <> 3 THEN CAST(n || '.25' AS DECIMAL(18,10)) END AS disk, n <> 4 AS complete FROM named WHERE n < 5),
    usage AS (SELECT c_custkey, c_mktsegment AS plan, c_custkey % 760 AS hours, (c_custkey % 3000) AS gb,
                     c_custkey * 2000 AS a, c_custkey * 15000 AS b FROM customer),
    priced AS (SELECT usage.*, disk, complete, CASE WHEN rates.plan IS NULL THEN 'unknown plan' WHEN hours > 744 THEN 'hours out of range' END AS problem,
        coalesce(monthly, hourly * hours) AS compute,
        greatest(gb - 10, 0) * 0.015 + ((greatest(a - 1000000, 0) + 999999) // 1000000) * 4.50
          + ((greatest(b - 10000000, 0) + 999999) // 1000000) * 0.36 AS backup
        FROM usage LEFT JOIN rates ON rates.plan = usage.plan)
    SELECT c_custkey, problem,
        CASE WHEN problem IS NULL THEN CAST(round((compute + coalesce(disk, 0) + backup) * 10000) AS BIGINT) END AS bound,
        CASE WHEN problem IS NULL AND complete AND disk IS NOT NULL THEN CAST(round((compute + disk + backup) * 10000) AS BIGINT) END AS total,
        CASE WHEN problem IS NULL AND complete AND disk IS NOT NULL THEN '$' || CAST(round(compute + disk + backup, 2) AS DECIMAL(18,2)) END AS usd
    FROM priced""")
def tiered_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    usage = customers.select(
        "c_custkey", F.col("c_mktsegment").alias("plan"), (key % 760).cast("string").alias("hours"),
        (key % 3000).cast("string").alias("gb_months"), (key * 2000).cast("string").alias("class_a"),
        (key * 15000).cast("string").alias("class_b"),
    )
    priced = costs.usage_cost(usage, segment_rates(customers), spread_by=["c_custkey"])

    def scaled(name: str) -> Column:
        return F.round(F.col(name) * 10000).cast("long")

    return priced.select(
        "c_custkey", "problem", scaled("lower_bound").alias("bound"), scaled("total").alias("total"),
        costs.usd(F.col("total")).alias("usd"),
    )


def alert_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    key = F.col("s_suppkey")
    suppliers, orders, events = (table(spark, sf_dir, name) for name in ("supplier", "orders", "events"))
    state = F.when(key % 4 == 0, "DOWN").when(key % 4 == 1, "UNAUTHORIZED").when(key % 4 == 2, "DEGRADED").otherwise("UP")
    backends = suppliers.select(
        F.concat(F.lit("s"), key.cast("string")).alias("key"), F.col("s_name").alias("name"), state.alias("state"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("summary"), key.alias("position"),
    )
    errors = events.filter(F.col("event_type") == "error").select(
        F.concat(F.lit("dags/"), F.col("user_id").cast("string"), F.lit(".py")).alias("filename"), F.col("event_id").alias("position")
    )
    pools = orders.groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("running"), F.count_if(F.col("o_orderstatus") == "O").alias("queued"),
        F.count_if(F.col("o_orderstatus") == "P").alias("scheduled"),
    ).select(
        F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderpriority").startswith("1"), -1).otherwise(16).alias("slots"),
        "running", "queued", "scheduled", F.lit(0).alias("open"),
    )
    tasks = orders.select(
        F.lit("nightly").alias("dag_id"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("task_id"),
        F.when(F.col("o_orderstatus") == "P", "up_for_retry").otherwise("running").alias("state"), F.col("o_orderkey").alias("position"),
    )
    rejections = events.agg(
        F.count_if(F.col("event_type") == "error").alias("rejected_recently"), F.lit(4).cast("long").alias("max_concurrent_runs")
    )
    return {"backends": backends, "errors": errors, "pools": pools, "tasks": tasks, "rejections": rejections}


ALERT_SQL = f"""
    SELECT 's' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN ':down' WHEN 1 THEN ':unauthorized' ELSE ':degraded' END AS key,
           CASE s_suppkey % 4 WHEN 2 THEN 'WARNING' ELSE 'FAILED' END AS level,
           s_name || CASE s_suppkey % 4 WHEN 0 THEN '{rules.DOWN}' WHEN 1 THEN '{rules.UNAUTHORIZED}' ELSE '{rules.DEGRADED}' END AS title,
           'nation ' || s_nationkey AS detail, CASE s_suppkey % 4 WHEN 2 THEN 'MONITOR' ELSE 'SETTINGS' END AS target,
           CAST(NULL AS VARCHAR) AS dag_id FROM supplier WHERE s_suppkey % 4 <> 3
    UNION ALL SELECT 'import-errors', 'FAILED', (SELECT count(*) FROM events WHERE event_type = 'error') || ' 个 DAG 文件无法解析',
        NULL, 'MONITOR', NULL
    UNION ALL SELECT 'pool:' || o_orderpriority, 'WARNING', '资源池 ' || o_orderpriority || ' 已满',
        '共 16 个槽位，运行 ' || count(*) FILTER (o_orderstatus = 'F') || '，排队 ' || count(*) FILTER (o_orderstatus <> 'F') || '，空闲 0。',
        'MONITOR', NULL FROM orders WHERE o_orderpriority NOT LIKE '1%' GROUP BY o_orderpriority HAVING count(*) FILTER (o_orderstatus <> 'F') > 0
    UNION ALL SELECT 'retries', 'WARNING', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') || ' 个任务等待重试',
        NULL, 'PIPELINE', 'nightly'
    UNION ALL SELECT 'engine:rejected', 'WARNING', '引擎拒绝了 ' || (SELECT count(*) FROM events WHERE event_type = 'error') || ' 次运行',
        '同时运行数已达上限 4，新的运行请求被拒绝。稍后再试，或提高引擎的并发上限。', 'MONITOR', NULL"""


@query(ALERT_SQL)
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.alerts(**alert_inputs(spark, sf_dir))


@query("""SELECT 'import-errors' AS key, event_id AS position, 'dags/' || user_id || '.py' AS name FROM events WHERE event_type = 'error'
          UNION ALL SELECT 'retries', o_orderkey, 'nightly · t' || o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def alert_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = alert_inputs(spark, sf_dir)
    return rules.alert_names(inputs["errors"], inputs["tasks"])


@query("""SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL' AND (contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt'))""")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.search(table(spark, sf_dir, "part"), "  BOLT ", ["p_name", "p_brand"], kind="SMALL", kind_column="p_type")
    return found.select("p_partkey", "p_name")


@query("SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.by_source(table(spark, sf_dir, "documents"), "src3").select("doc_id", "lang")


@query("SELECT event_id FROM events WHERE user_id = 7 AND event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 200")
def runs_of_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.runs_of(
        table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), 7, "click", profile_column="user_id",
        job_column="event_type", order=("ts", "event_id"),
    )
    return found.select("event_id")


def duration_sql(ms: str) -> str:
    s = f"({ms} // 1000)"
    return f"""CASE WHEN {s} < 10 THEN (({ms} + 50) // 100) // 10 || '.' || (({ms} + 50) // 100) % 10 || ' s'
        WHEN {s} < 60 THEN {s} || ' s' WHEN {s} < 3600 THEN {s} // 60 || ' min ' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') || ' s'
        WHEN {s} < 86400 THEN {s} // 3600 || ' h ' || lpad(CAST(({s} % 3600) // 60 AS VARCHAR), 2, '0') || ' min'
        ELSE (({s} * 10 + 43200) // 86400) // 10 || '.' || (({s} * 10 + 43200) // 86400) % 10 || ' d' END"""


def bytes_sql(n: str) -> str:
    tenths, whole = f"(({n} * 20 + 1024) // 2048)", f"(({n} * 2 + 1024) // 2048)"
    mega = f"(({n} * 20 + 1048576) // 2097152)", f"(({n} * 2 + 1048576) // 2097152)"
    return f"""CASE WHEN {n} < 1024 THEN {n} || ' B'
        WHEN {n} < 10240 THEN {tenths} // 10 || '.' || {tenths} % 10 || ' KB' WHEN {n} < 1048576 THEN {whole} || ' KB'
        WHEN {n} < 10485760 THEN {mega[0]} // 10 || '.' || {mega[0]} % 10 || ' MB' ELSE {mega[1]} || ' MB' END"""


PREVIEW_SQL = r"""CASE WHEN length(line) <= 40 THEN line ELSE substr(line, 1, 39) || '…' END"""
LINE_SQL = r"""trim(regexp_replace(text, '\s+', ' ', 'g'))"""


@query(f"""
    SELECT doc_id, {PREVIEW_SQL} AS preview, {duration_sql('(n_chars * doc_id)')} AS duration, {bytes_sql('(n_chars * 37)')} AS bytes,
           format('{{:,}}', n_chars * 1000) AS thousands
    FROM (SELECT *, {LINE_SQL} AS line FROM documents)""")
def human_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.preview(F.col("text"), 40).alias("preview"), text.human_duration(size * F.col("doc_id")).alias("duration"),
        text.human_bytes(size * 37).alias("bytes"), text.thousands(size * 1000).alias("thousands"),
    )


@query(f"""
    SELECT doc_id, {PREVIEW_SQL} AS preview, {duration_sql('(n_chars * doc_id)')} AS duration, {bytes_sql('(n_chars * 37)')} AS bytes,
           CASE lang WHEN 'en' THEN 'SUCCESS' WHEN 'fr' THEN 'FAILED' ELSE 'NONE' END AS tone, false AS blank
    FROM (SELECT *, {LINE_SQL} AS line FROM documents)""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql_functions(spark)
    states = F.when(F.col("lang") == "en", "\tSucceeded ").when(F.col("lang") == "fr", "FAILED").otherwise(F.col("lang"))
    docs = table(spark, sf_dir, "documents").withColumn("state", states)
    return docs.selectExpr(
        "doc_id", "preview(text, 40) AS preview", "human_duration(n_chars * doc_id) AS duration", "human_bytes(n_chars * 37) AS bytes",
        "run_tone(state) AS tone", "is_blank(text) AS blank",
    )


@query("""
    WITH aged AS (SELECT event_id, user_id, ts, value, (epoch_us((SELECT max(ts) FROM events)) // 1000 - epoch_us(ts) // 1000) // 1000 AS s FROM events)
    SELECT event_id, CASE WHEN s < 5 THEN '刚刚' WHEN s < 60 THEN s || ' 秒前' WHEN s < 3600 THEN s // 60 || ' 分钟前'
           WHEN s < 86400 THEN s // 3600 || ' 小时前' ELSE s // 86400 || ' 天前' END AS age,
           user_id || '.py' AS short, '2024  ERROR  user ' || user_id AS line FROM aged""")
def ages_and_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    file = F.concat(F.lit("dags/"), user, F.lit("\\"), user, F.lit(".py"))
    return table(spark, sf_dir, "events").select(
        "event_id", text.ago(F.col("ts"), latest_ts(spark, sf_dir)).alias("age"), text.short_name(file).alias("short"),
        text.log_line(F.lit("2024"), F.lit("error"), F.concat(F.lit("user "), user)).alias("line"),
    )


@query("""SELECT event_id, 'v' || event_type AS kept, 1 AS entries, CAST(json_extract(props, '$.k') AS BIGINT) AS duration FROM events""")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.create_map(
        F.lit(" kind "), F.concat(F.lit("v"), "event_type"), F.lit(" "), F.lit("x"), F.lit("empty"), F.lit(" \t"),
    )
    cleaned = maps.clean_params(params)
    metrics = maps.parse_map(F.regexp_replace("props", '"k"', '"durationMillis"'))
    return table(spark, sf_dir, "events").select(
        "event_id", cleaned["kind"].alias("kept"), F.size(cleaned).alias("entries"), maps.duration_metric(metrics).alias("duration")
    )


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1,234,' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 1 THEN p_size || ' B'
          WHEN 2 THEN CASE WHEN p_size < 10 THEN p_size || '.0 s' ELSE p_size || ' s' END ELSE 'n/a' END AS shown FROM part""")
def metric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("p_partkey") % 4
    key = F.when(part == 0, "rows").when(part == 1, "bytes").when(part == 2, "durationMillis").otherwise("columns")
    value = (
        F.when(part == 0, (F.col("p_size") + 1_234_000).cast("string")).when(part == 1, F.col("p_size").cast("string"))
        .when(part == 2, (F.col("p_size") * 1000).cast("string")).otherwise("n/a")
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.metric_text(key, value).alias("shown"))


@query("""
    SELECT event_id, 'dag' || user_id AS dag_id, 'run' || event_id AS dag_run_id, event_type AS state,
           CAST(round(value * 1000) AS BIGINT) AS duration_ms, '' AS note,
           CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'NONE' END AS tone FROM events
    UNION ALL SELECT event_id, '', 'second', 'success', NULL, 'n', 'SUCCESS' FROM events""")
def payload_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.struct(
        F.concat(F.lit("run"), F.col("event_id").cast("string")).alias("dag_run_id"),
        F.concat(F.lit("dag"), F.col("user_id").cast("string")).alias("dag_id"), F.col("event_type").alias("state"),
        F.col("value").alias("duration"), F.lit(None).cast("string").alias("note"),
    )
    second = F.struct(
        F.lit("second").alias("dag_run_id"), F.lit(None).cast("string").alias("dag_id"), F.lit("success").alias("state"),
        F.lit(None).cast("double").alias("duration"), F.lit("n").alias("note"),
    )
    answers = table(spark, sf_dir, "events").select(
        "event_id", F.to_json(F.struct(F.array(first, second).alias("dag_runs"))).alias("body")
    )
    rows = payloads.pipeline_runs(answers, "body")
    tone = run_tone(F.when(F.col("state") == "click", "success").when(F.col("state") == "error", "failed").otherwise(F.col("state")))
    return rows.select("event_id", "dag_id", "dag_run_id", "state", "duration_ms", "note", tone.alias("tone"))


@query("""
    SELECT event_id, 0 AS entry, 0 AS part, 'plain ' || event_type AS line FROM events
    UNION ALL SELECT event_id, 1, 0, 'in ' || user_id FROM events
    UNION ALL SELECT event_id, 1, 1, 'T1  INFO  nested' FROM events
    UNION ALL SELECT event_id, 2, 0, 'WARNING  ' || event_type FROM events""")
def payload_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string(
        '{"content": ["plain %s", ["in %d", {"timestamp": "T1", "level": "info", "event": "nested"}], '
        '{"level": "warning", "event": "%s"}]}', "event_type", "user_id", "event_type",
    )
    answers = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return payloads.log_lines(answers, "body")


@query("""
    SELECT p_partkey, 'p' || p_partkey AS dag_id, 'p' || p_partkey AS dag_display_name, p_size > 25 AS is_paused,
           'a,' || p_type || ',' AS tags FROM part""")
def payload_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string(
        '{"dags": [{"dag_id": "p%d", "is_paused": %s, "tags": ["a", {"name": "%s"}, {"other": 1}]}]}', "p_partkey",
        (F.col("p_size") > 25).cast("string"), "p_type",
    )
    answers = table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))
    rows = payloads.pipelines(answers, "body")
    return rows.select("p_partkey", "dag_id", "dag_display_name", "is_paused", F.array_join("tags", ",").alias("tags"))


@query("""
    SELECT o_orderkey, 't' || o_orderkey AS task_id, -1 AS map_index, CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'queued' END AS state
    FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def payload_active_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    state = F.when(status == "O", "running").when(status == "P", "queued").otherwise("success")
    body = F.format_string(
        '{"task_instances": [{"task_id": "t%d", "state": "%s"}, {"task_id": "", "state": "running"}]}', "o_orderkey", state
    )
    answers = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    return payloads.active_tasks(answers, "body").select("o_orderkey", "task_id", "map_index", "state")


@query("""
    SELECT c_custkey, 0 AS position, 'pool' || c_custkey AS name, c_nationkey AS slots, c_nationkey % 3 AS running, 0 AS queued,
           CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS scheduled, 0 AS deferred, c_nationkey - c_nationkey % 3 AS open FROM customer
    UNION ALL SELECT c_custkey, 1, '', 0, 0, 0, 0, 7, 0 FROM customer""")
def payload_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    first = F.to_json(F.struct(
        F.concat(F.lit("pool"), F.col("c_custkey").cast("string")).alias("name"), nation.alias("slots"), (nation % 3).alias("running_slots"),
        F.when(F.col("c_custkey") % 2 == 0, 2).alias("scheduled_slots"), (nation - nation % 3).alias("open_slots"),
    ))
    body = F.format_string('{"pools": [%s, {"deferred_slots": 7, "slots": null}], "total_entries": 2}', first)
    return payloads.pools(table(spark, sf_dir, "customer").select("c_custkey", body.alias("body")), "body")


@query("""
    SELECT event_id, position, event_id * 2 AS id, 'dags/' || event_type || '.py' AS filename,
           CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) END AS micros, 'line 1' || chr(10) || user_id AS stack_trace
    FROM events, (SELECT 0 AS position) WHERE event_type = 'error'
    UNION ALL SELECT event_id, 1, 0, '', NULL, '' FROM events WHERE event_type = 'error'""")
def payload_import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("event_id") % 5 == 0, "never").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    first = F.to_json(F.struct(
        (F.col("event_id") * 2).alias("import_error_id"), F.format_string("dags/%s.py", "event_type").alias("filename"),
        stamp.alias("timestamp"), F.format_string("line 1\n%d", "user_id").alias("stack_trace"),
    ))
    listed = F.format_string('{"import_errors": [%s, {"filename": null}]}', first)
    # An answer without the array, or one that is no JSON, has no rows.
    body = F.when(F.col("event_type") == "error", listed).when(F.col("event_type") == "view", '{"detail": "forbidden"}').otherwise("<html>")
    rows = payloads.import_errors(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body")
    return rows.select("event_id", "position", "id", "filename", F.unix_micros("timestamp").alias("micros"), "stack_trace")


@query("""
    SELECT o_orderkey, 0 AS position, 'load' || o_orderkey AS task_id, 'load' || o_orderkey AS task_display_name,
           'check,' || o_orderstatus AS downstream, o_orderpriority AS operator_name FROM orders
    UNION ALL SELECT o_orderkey, 1, 'check', 'Check "all"', '', '' FROM orders""")
def payload_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.to_json(F.struct(
        F.concat(F.lit("load"), F.col("o_orderkey").cast("string")).alias("task_id"), F.col("o_orderpriority").alias("operator_name"),
        F.array(F.lit("check"), F.col("o_orderstatus")).alias("downstream_task_ids"),
    ))
    body = F.format_string('{"tasks": [%s, {"task_id": "check", "task_display_name": "Check \\"all\\""}]}', first)
    rows = payloads.pipeline_tasks(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")), "body")
    return rows.withColumn("downstream", F.array_join("downstream", ","))


@query("""
    SELECT l_orderkey, l_linenumber, 't' || l_linenumber AS task_id, CASE WHEN l_linenumber > 3 THEN l_linenumber ELSE -1 END AS map_index,
           CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'success' END AS state, l_linenumber AS try_number, 0 AS max_tries,
           CAST(l_quantity * 1000 AS BIGINT) AS duration_ms, CASE WHEN l_linenumber % 2 = 0 THEN 'Bash' ELSE 'Python' END AS operator
    FROM lineitem""")
def payload_task_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, flag = F.col("l_linenumber"), F.col("l_returnflag")
    body = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("t"), number.cast("string")).alias("task_id"), F.when(number > 3, number).alias("map_index"),
        F.when(flag == "R", "failed").when(flag == "A", "success").alias("state"), number.alias("try_number"),
        F.col("l_quantity").alias("duration"), F.when(number % 2 == 0, "").otherwise("Python").alias("operator_name"),
        F.lit("Bash").alias("operator"),
    )).alias("task_instances")))
    answers = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", body.alias("body"))
    rows = payloads.task_instances(answers, "body")
    return rows.select("l_orderkey", "l_linenumber", "task_id", "map_index", "state", "try_number", "max_tries", "duration_ms", "operator")
