import datetime as dt
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tidegate import scale
from tidegate.functions import maps, text
from tidegate.functions.sql import register_sql_functions
from tidegate.functions.states import run_tone
from tidegate.operators import alerts as rules
from tidegate.operators import changes, costs, counters, latency, levels, mix, quality, ranges, runs
from tidegate.scale import materialize
from tidegate.sources import payloads

T0 = dt.datetime(2026, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


SAMPLE = "backend string, at timestamp, state string, latency_ms long"


def test_latency(spark):
    rows = [("a", at(i), "DOWN" if v is None else "UP", v) for i, v in enumerate([10, None, 30, 20, None])]
    rows += [("b", at(0), "UP", 10), ("b", at(1), "DEGRADED", 40), ("c", at(0), "DOWN", None)]
    df = spark.createDataFrame(rows, SAMPLE)
    got = {row["backend"]: tuple(row)[1:] for row in latency.latency_stats(df, ["backend"]).collect()}
    assert got == {"a": (5, 3, 20, 20.0, 30, 0.6), "b": (2, 2, 40, 25.0, 40, 1.0), "c": (1, 0, None, None, None, 0.0)}
    none = latency.latency_stats(df.limit(0), []).first()
    assert tuple(none) == (0, 0, None, None, None, -1.0)


def test_mix(spark):
    states = ["success"] * 14 + ["failed"] * 2 + ["Upstream_Failed "] + ["RUNNING"] + [None, "odd"]
    df = spark.createDataFrame([(state,) for state in states], "state string")
    assert mix.run_mix(df).first().asDict() == {"success": 14, "failed": 3, "running": 1, "waiting": 0}
    assert mix.success_share(df).first()[0] == 14 / 17
    assert mix.success_share(df.filter("state = 'RUNNING'")).first()[0] == -1
    known = {" Succeeded\t": "SUCCESS", "deferred": "RUNNING", "restarting": "RUNNING", "queued": "WAITING", "scheduled": "WAITING",
             "up_for_reschedule": "WAITING", "awaiting_input": "WAITING", "skipped": "NONE", None: "NONE", " failed": "FAILED"}
    assert {state: one(spark, run_tone, state) for state in known} == known


def test_counter_with_restart(spark):
    rows = [("e", at(0), T0, 2), ("e", at(60), T0, 5), ("e", at(120), at(100), 1), ("e", at(4000), at(100), 7), ("e", at(4600), at(100), 7)]
    df = spark.createDataFrame(rows, "engine string, ts timestamp, started_at timestamp, rejected long")
    grown = counters.counter_increase(df, ["engine"], "ts", "rejected")
    assert [row["increase"] for row in grown.orderBy("ts").collect()] == [0, 3, 0, 6, 0]
    summed = counters.rolling_sum(grown, ["engine"], "ts", "increase")
    # The increase at 4000 s still counts exactly ten minutes later.
    assert [row["rolling"] for row in summed.orderBy("ts").collect()] == [0, 3, 3, 6, 6]


def test_run_events(spark):
    rows = [(1, "a", "begin", None, at(0)), (2, "b", "begin", None, at(1)), (1, None, "end", True, at(2)), (1, None, "end", False, at(3)),
            (3, "c", "begin", None, at(4)), (2, None, "end", False, at(5)), (4, "a", "begin", None, at(0)), (None, None, "rejected", None, at(6)),
            (9, None, "end", True, at(7))]
    df = spark.createDataFrame(rows, "run_id long, job string, kind string, ok boolean, ts timestamp")
    assert runs.run_counters(df).first().asDict() == {"started": 4, "succeeded": 1, "failed": 1, "rejected": 1}
    active = runs.active_runs(df, F.lit(at(10))).collect()
    assert [(row["run_id"], row["job"], row["elapsed_ms"]) for row in active] == [(4, "a", 10000), (3, "c", 6000)]
    assert runs.active_runs(df, F.lit(at(-10))).first()["elapsed_ms"] == 0


def test_retention(spark):
    df = spark.createDataFrame([(p, i, at(i)) for p in (1, 2) for i in range(205)], "profile_id int, id long, started_at timestamp")
    kept = runs.retain(df, ["profile_id"], ["started_at", "id"])
    assert {row[0]: (row[1], row[2]) for row in kept.groupBy("profile_id").agg(F.count("*"), F.min("id")).collect()} == {1: (200, 5), 2: (200, 5)}
    border = spark.createDataFrame([(1, at(0)), (2, at(-1))], "id long, started_at timestamp")
    young = runs.within_days(border, "started_at", F.lit(at(14 * 86400)))
    assert [row["id"] for row in young.collect()] == [1]
    log = spark.range(503).withColumn("at", F.timestamp_seconds("id"))
    assert [row["id"] for row in runs.keep_newest(log, ["at", "id"]).collect()] == list(range(502, 2, -1))
    assert runs.runs_of(df.withColumn("job_name", F.lit("x")), 2, "x", 3).select("id").collect()[0]["id"] == 204


def test_graph(spark):
    def place(nodes):
        rows = [(name, after, i) for i, (name, after) in enumerate(nodes)]
        df = spark.createDataFrame(rows, "id string, downstream array<string>, position long")
        return {row["id"]: (row["level"], row["row"]) for row in levels.graph_levels(df).collect()}

    assert place([("a", ["b"]), ("b", ["c"]), ("c", ["gone"])]) == {"a": (0, 0), "b": (1, 0), "c": (2, 0)}
    diamond = [("a", ["b", "c"]), ("b", ["d"]), ("c", ["d"]), ("d", []), ("lone", [])]
    assert place(diamond) == {"a": (0, 0), "b": (1, 0), "c": (1, 1), "d": (2, 0), "lone": (0, 1)}
    cycle = [("a", ["b"]), ("b", ["c"]), ("c", ["b", "d"]), ("d", [])]
    assert place(cycle) == {"a": (0, 0), "b": (0, 1), "c": (0, 2), "d": (0, 3)}
    assert place([("a", ["c"]), ("b", ["c"]), ("a2", ["b"]), ("c", [])])["c"] == (2, 0)
    assert place([("x", [])]) == {"x": (0, 0)}


def test_graph_rounds(spark, monkeypatch):
    writes = []

    def write(df, name):
        writes.append(name)
        return materialize(df, name)

    monkeypatch.setattr(scale, "materialize", write)
    monkeypatch.setattr(levels, "materialize", write)
    chain = spark.range(200).select(
        F.col("id").cast("string"), F.array((F.col("id") + 1).cast("string")).alias("downstream"), F.col("id").alias("position"))
    got = {row["id"]: row["level"] for row in levels.graph_levels(chain).collect()}
    assert got == {str(number): number for number in range(200)}
    assert len(writes) <= 20
    # Trees, joins and a cycle, against the longest ways by hand.
    chance = random.Random(5)
    after = {str(n): [str(chance.randrange(n + 1, 60)) for _ in range(chance.choice([0, 1, 1, 2, 3]))] for n in range(59)} | {"59": []}
    after["50"] = [*after["50"], "48"]
    after["48"] = [*after["48"], "50"]
    levels_of = dict.fromkeys(after, 0)
    for _ in range(60):
        levels_of = {n: max((levels_of[s] + 1 for s in after if n in after[s]), default=0) for n in after}
    rows = [(name, targets, int(name)) for name, targets in after.items()]
    found = levels.graph_levels(spark.createDataFrame(rows, "id string, downstream array<string>, position long"))
    # A way that goes round the cycle is longer than any without one.
    endless = {n for n in after if levels_of[n] >= 59 or n in ("48", "50")}
    while more := {n for n in after if n not in endless and any(n in after[s] for s in endless)}:
        endless |= more
    assert {row["id"]: row["level"] for row in found.collect()} == {n: 0 if n in endless else level for n, level in levels_of.items()}


def span(*events):
    keys = ("introduced", "fixed", "last_affected")
    return [{key: event.get(key) for key in keys} for event in events]


def plainly(version, spans):
    """Whether one of the spans holds the version: the last event at or before it decides."""
    def key(text):
        parts = [int(part) for part in text.lstrip("v").split(".")]
        return tuple(parts + [0] * (6 - len(parts)))

    at = key(version)
    for events in spans:
        inside = False
        for event in sorted(events, key=lambda e: key(next(v for v in e.values() if v))):
            if event["introduced"] and at >= key(event["introduced"]):
                inside = True
            elif event["fixed"] and at >= key(event["fixed"]):
                inside = False
            elif event["last_affected"] and at > key(event["last_affected"]):
                inside = False
        if inside:
            return True
    return False


EARLY = span({"introduced": "0"}, {"fixed": "7.3"})
MIDDLE = span({"introduced": "9.1"}, {"last_affected": "9.4.2"})
BROKEN_OFF = span({"introduced": "11"}, {"fixed": "11.5"}, {"introduced": "12.0.7"}, {"fixed": "13"})


def test_ranges(spark):
    versions = ["0.1", "7.2.9", "v7", "7.3", "7.3.0", "9.0.9", "9.1", "v9.4.2", "9.4.3", "11", "11.4.99", "11.5", "12.0.6", "12.0.7", "13", "14.1"]
    kinds = [[], [EARLY], [MIDDLE], [BROKEN_OFF], [EARLY, BROKEN_OFF], [MIDDLE, EARLY, BROKEN_OFF]]
    rows = [(version, spans, plainly(version, spans)) for spans in kinds for version in versions]
    assert {row[2] for row in rows} == {True, False}
    df = spark.createDataFrame(rows, f"version string, ranges {ranges.RANGES}, expected boolean")
    judged = df.withColumn("got", ranges.in_ranges(maps.release(F.col("version")), F.col("ranges")))
    assert judged.filter("got <> expected").collect() == []
    numbered = [(f"K{number}", spans) for number, spans in enumerate(kinds)]
    every = spark.createDataFrame([("gh", "pkg", version) for version in versions], "ecosystem string, name string, version string")
    known = spark.createDataFrame([(name, "gh", "PKG", ["13"], spans) for name, spans in numbered],
                                  f"id string, ecosystem string, name string, versions array<string>, ranges {ranges.RANGES}")
    found = sorted((row["version"], row["advisory"]) for row in ranges.match_ranges(every, known).collect())
    assert found == sorted((v, name) for v in versions for name, spans in numbered if v == "13" or plainly(v, spans))
    items = spark.createDataFrame([("gh", "Act/Checkout", "9.2"), ("gh", "act/checkout", "6"), ("mvn", "act/checkout", "9.2")],
                                  "ecosystem string, name string, version string")
    advisories = spark.createDataFrame([("A1", "gh", "act/CHECKOUT", ["v6"], [MIDDLE]), ("A2", "gh", "other", None, [EARLY])],
                                       f"id string, ecosystem string, name string, versions array<string>, ranges {ranges.RANGES}")
    assert sorted(tuple(row) for row in ranges.match_ranges(items, advisories).collect()) == [
        ("gh", "Act/Checkout", "9.2", "A1"), ("gh", "act/checkout", "6", "A1")]


RATES = [("month", "17.35", None, "1.05", True), ("hour", None, "0.0417", "3.3", True), ("no-disk", None, "0.25", None, False), ("rest", "8", None, "0", False)]


def dollars(plan, hours, gb, a, b):
    """(lower bound, total) of a known plan, worked out with Python's decimals."""
    _, monthly, hourly, disk, complete = next(rate for rate in RATES if rate[0] == plan)
    steps = lambda used, free: max(0, -(-(used - free) // 1_000_000))
    backup = max(0, math.ceil(Decimal(gb)) - 10) * Decimal("0.015") + steps(int(a), 1_000_000) * Decimal("4.5") + steps(int(b), 10_000_000) * Decimal("0.36")
    compute = Decimal(monthly) if monthly else Decimal(hourly) * Decimal(hours)
    bound = compute + Decimal(disk or 0) + backup
    cents = "$" + str(bound.quantize(Decimal("0.01"), ROUND_HALF_UP))
    return cents, cents if complete and disk is not None else None


def test_costs(spark):
    rates = spark.createDataFrame(RATES, "plan string, monthly string, hourly string, disk string, complete boolean")
    cases = [(plan, hours, gb, a, b) for plan in ("month", "hour", "no-disk", "rest") for hours, gb, a, b in (
        ("0", "0", "0", "0"), ("3.25", "10", "1000000", "10000000"), ("744", "10.01", "1000001", "10000001"), ("100", "812.4", "7500000", "99999999"))]
    schema = "plan string, hours string, gb_months string, class_a string, class_b string"
    usage = spark.createDataFrame(cases, schema)
    shown = [costs.usd(F.col(name)).alias(name) for name in ("lower_bound", "total")]
    got = {tuple(row)[:5]: (row["lower_bound"], row["total"], row["problem"]) for row in
           costs.usage_cost(usage, rates).select("plan", "hours", "gb_months", "class_a", "class_b", *shown, "problem").collect()}
    assert got == {case: (*dollars(*case), None) for case in cases}
    wrong = [("hour", hours, "1", "0", "0") for hours in ("", "-1", "NaN", "Infinity", "1e2", "745")] + [("nothing", "1", "1", "0", "0"), ("hour", "1", "-2", "0", "0")]
    for row in costs.usage_cost(spark.createDataFrame(wrong, schema), rates).collect():
        assert row["problem"] and row["total"] is None and row["lower_bound"] is None


def test_alerts(spark):
    backends = spark.createDataFrame([("engine", "Engine", "UP", "fine", 0), ("airflow", "Airflow", "DEGRADED", "slow", 1)],
                                     "key string, name string, state string, summary string, position int")
    errors = spark.createDataFrame([("dags/b.py", 0), ("dags/a.py", 1)], "filename string, position int")
    pools = spark.createDataFrame([("default_pool", 16, 16, 2, 1, 0), ("free", -1, 0, 5, 0, 0), ("idle", 4, 4, 0, 0, 0)],
                                  "name string, slots int, running int, queued int, scheduled int, open int")
    tasks = spark.createDataFrame([("etl", "load", "up_for_retry", 0), ("etl", "save", "up_for_retry", 1), ("x", "y", "running", 2)],
                                  "dag_id string, task_id string, state string, position int")
    rejections = spark.createDataFrame([(3, 4)], "rejected_recently long, max_concurrent_runs int")
    got = rules.alerts(backends, errors, pools, tasks, rejections).collect()
    assert [row["key"] for row in got] == ["import-errors", "airflow:degraded", "pool:default_pool", "retries", "engine:rejected"]
    assert got[0]["detail"] is None and got[0]["title"].startswith("2 ")
    assert (got[3]["target"], got[3]["dag_id"], got[3]["detail"]) == ("PIPELINE", "etl", None)
    names = rules.alert_names(errors, tasks).orderBy("key", "position").collect()
    assert [tuple(row) for row in names] == [("import-errors", 0, "dags/b.py"), ("import-errors", 1, "dags/a.py"),
                                             ("retries", 0, "etl · load"), ("retries", 1, "etl · save")]
    many = spark.range(250).selectExpr("CONCAT('f', id) AS filename", "id AS position")
    assert rules.alert_names(errors=many).count() == 250 and rules.alerts(errors=many).first()["title"].startswith("250 ")
    mixed = tasks.unionByName(spark.createDataFrame([("b", "t", "up_for_retry", 5)], tasks.schema))
    row = rules.alerts(tasks=mixed).first()
    assert (row["target"], row["dag_id"]) == ("MONITOR", None)
    assert rules.alerts(errors=errors.limit(0), tasks=tasks.limit(0), rejections=rejections.selectExpr("0L AS rejected_recently", "4 AS max_concurrent_runs")).count() == 0


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, "c", 1.0)], "id int, name string, x double")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2.0), (4, "d", 1.0)], "id int, name string, x double")
    diff = {row["id"]: (row["change"], row["changed"], row["x"]) for row in changes.snapshot_diff(old, new, ["id"]).collect()}
    assert diff == {1: ("unchanged", False, None), 2: ("update", True, 2.0), 3: ("delete", True, 1.0), 4: ("insert", True, 1.0)}
    loaded = spark.createDataFrame([(3, None), (1, "a")], "at int, text string")
    early = spark.createDataFrame([(3, None), (4, "b"), (2, "c")], "at int, text string")
    assert [row["at"] for row in changes.merge_early(loaded, early, ["at"], 3).collect()] == [4, 3, 2]
    blank = spark.createDataFrame([(3, ""), (5, None)], "at int, text string")
    assert {(row["at"], row["text"]) for row in changes.merge_early(loaded, blank, ["at"], 9).collect()} == {(1, "a"), (3, None), (3, ""), (5, None)}


def test_floors_and_reports(spark):
    measured = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "module string, executed long")
    floors = spark.createDataFrame([("a", 8), ("b", 2), ("c", 1)], "module string, floor long")
    got = {row["module"]: (row["ok"], row["message"]) for row in quality.floor_gate(measured, floors, "module").collect()}
    assert got == {"a": (True, None), "b": (False, "b executed 1 tests, expected at least 2"), "c": (False, "c: no reports")}
    documents = [
        ("one", '<?xml version="1.0"?><testsuite name="x" tests="5" skipped="1"><testcase name="a"><skipped/></testcase>'
                '<testcase name="b"><skipped message="m">why</skipped></testcase><testcase name="c"/></testsuite>'),
        ("many", '<testsuites><testsuite tests="3"/><testsuite tests="4" skipped="2"><testcase name="a"/></testsuite></testsuites>'),
        ("odd", "<other/>"), ("bad", '<testsuite tests="x"/>'),
    ]
    reports = spark.createDataFrame(documents, "module string, document string")
    totals = {row["module"]: (row["executed"], row["skipped"], row["problem"]) for row in quality.suite_totals(reports, "module").collect()}
    assert totals["one"] == (3, 2, None) and totals["many"] == (5, 2, None)
    more = [("cut", '<testsuite tests="7"><testcase'), ("cut", '<testsuite tests="5"/>'), ("half", '<testsuites><testsuite tests="4"/><tests'),
            ("less", '<testsuite tests="-3"/>'), ("none", "<testsuites/>"), ("null", None), ("blank", "")]
    broken = {row["module"]: row["problem"] for row in quality.suite_totals(spark.createDataFrame(more, "module string, document string"), "module").collect()}
    assert broken == {"cut": "cannot parse", "half": "cannot parse", "less": "negative count", "none": None, "null": "cannot parse", "blank": "cannot parse"}
    summed = spark.createDataFrame([("a", 9, None), ("a", 9, "cannot parse"), ("b", 9, None)], "module string, executed long, problem string")
    judged = {row["module"]: (row["ok"], row["message"]) for row in quality.floor_gate(summed, floors, "module").collect()}
    assert judged == {"a": (False, "a: cannot parse"), "b": (True, None), "c": (False, "c: no reports")}
    assert totals["odd"][2] == "unexpected root element <other>" and totals["bad"][2] == "non-integer tests"


def test_texts(spark):
    assert one(spark, lambda c: text.preview(c, 5), " 中文 \n\t😀 abc ") == "中文 😀…"
    assert one(spark, lambda c: text.preview(c, 9), None) == ""
    durations = {400: "0.4 s", 1200: "1.2 s", 48000: "48 s", 185000: "3 min 05 s", 7620000: "2 h 07 min", -5: "0.0 s", 129600000: "1.5 d",
                 10_000: "10 s", 86_400_000_000_000_000: "1.00e+09 d"}
    assert {ms: one(spark, text.human_duration, ms, "long") for ms in durations} == durations
    sizes = {512: "512 B", 1536: "1.5 KB", 64 << 20: "64 MB", 1023: "1023 B", 5 << 60: "5.0 EB", 12_900_000: "12 MB"}
    assert {n: one(spark, text.human_bytes, n, "long") for n in sizes} == sizes
    register_sql_functions(spark)
    for ms, shown in durations.items():
        assert spark.sql(f"SELECT human_duration({ms}L)").first()[0] == shown
    for n, shown in sizes.items():
        assert spark.sql(f"SELECT human_bytes({n}L)").first()[0] == shown
    assert tuple(spark.sql("SELECT is_blank(' '), is_blank('x'), run_tone(' FAILED'), preview('a  b c', 4)").first()) == (True, False, "FAILED", "a b…")
    assert one(spark, text.thousands, 1234567, "long") == "1,234,567"
    shown = {("rows", "1234567"): "1,234,567", ("bytes", "2048"): "2.0 KB", ("durationMillis", "1500"): "1.5 s", ("rows", "many"): "many",
             ("sha256", "12"): "12", ("rows", "1.5"): "1.5"}
    for (key, value), want in shown.items():
        assert one(spark, lambda c, key=key: text.metric_text(F.lit(key), c), value) == want
    assert one(spark, text.short_name, "a/b\\c.py") == "c.py" and one(spark, text.short_name, "c.py") == "c.py"
    ages = {3: "刚刚", 5: "5 秒前", 180: "3 分钟前", 7200: "2 小时前", 4 * 86400: "4 天前", -9: "刚刚"}
    assert {s: one(spark, lambda c, s=s: text.ago(F.lit(at(0)), F.lit(at(s))), "x") for s in ages} == ages


def test_maps(spark):
    df = spark.sql("SELECT map(' a ', '1', 'a', '2', ' ', 'x', 'b', ' ', 'c', NULL, 'd', ' v ') AS m")
    assert df.select(maps.clean_params(F.col("m"))).first()[0] == {"a": "2", "d": " v "}
    assert one(spark, maps.parse_map, "not json") == {} and one(spark, maps.parse_map, '{"a":"b"}') == {"a": "b"}
    for value, want in (("12", 12), ("x", 0), (None, 0)):
        assert one(spark, lambda c: maps.duration_metric(F.create_map(F.lit("durationMillis"), c)), value) == want
    assert [int(part) for part in one(spark, maps.release, "v4.1.3-rc.1+7")] == [4, 1, 3]


def test_payloads(spark):
    body = ('{"dags": [{"dag_id": "a", "tags": ["x", {"name": "y"}, {"z": 1}]}, {"dag_id": "b", "dag_display_name": "B", '
            '"is_paused": true, "next_dagrun_run_after": "2026-01-01T00:00:00Z"}]}')
    rows = payloads.pipelines(spark.createDataFrame([(1, body), (2, "{}")], "id int, body string"), "body").collect()
    assert [(r["id"], r["dag_display_name"], r["is_paused"], r["tags"]) for r in rows] == [(1, "a", False, ["x", "y", ""]), (1, "B", True, [])]
    assert rows[1]["next_dagrun_run_after"] == T0
    log = ('{"content": ["plain", ["in", {"timestamp": "T", "level": "info", "event": "e"}], {"event": "only"}, {"k": 1}]}')
    lines = payloads.log_lines(spark.createDataFrame([(log,)], "body string"), "body").orderBy("entry", "part").collect()
    assert [row["line"] for row in lines] == ["plain", "in", "T  INFO  e", "only", '{"k":1}']
    pools = '{"pools": [{"name": "p", "slots": -1, "queued_slots": 3}]}'
    row = payloads.pools(spark.createDataFrame([(pools,)], "body string"), "body").first()
    assert (row["name"], row["slots"], row["queued"], row["open"]) == ("p", -1, 3, 0)
    tasks = '{"task_instances": [{"task_id": "t", "state": null, "duration": 1.25, "operator": "op"}]}'
    row = payloads.task_instances(spark.createDataFrame([(tasks,)], "body string"), "body").first()
    assert (row["task_display_name"], row["map_index"], row["state"], row["duration_ms"], row["operator"]) == ("t", -1, None, 1250, "op")
    errors = '{"import_errors": [{"import_error_id": 7, "filename": "f.py"}]}'
    row = payloads.import_errors(spark.createDataFrame([(errors,)], "body string"), "body").first()
    assert (row["id"], row["filename"], row["stack_trace"], row["timestamp"]) == (7, "f.py", "", None)
    graph = '{"tasks": [{"task_id": "t", "downstream_task_ids": ["u"]}, {"task_id": "u"}]}'
    rows = payloads.pipeline_tasks(spark.createDataFrame([(graph,)], "body string"), "body").collect()
    assert [row["downstream"] for row in rows] == [["u"], []]


def test_search(spark):
    df = spark.createDataFrame([("Row-Count", "counts", "spark"), ("echo", "Says ROW", "jvm"), ("noop", None, "jvm")], "name string, summary string, kind string")
    assert [r["name"] for r in runs.search(df, " row ", ["name", "summary"]).collect()] == ["Row-Count", "echo"]
    assert [r["name"] for r in runs.search(df, "", ["name"], kind="jvm").collect()] == ["echo", "noop"]
    assert runs.by_source(df.withColumnRenamed("kind", "source"), None).count() == 3


def test_duration_share(spark):
    df = spark.createDataFrame([("a", 1, 100), ("a", 2, 25), ("a", 3, -5), ("b", 4, 0), ("b", 5, None)], "g string, id int, ms long")
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", adaptive)
        got = {row["id"]: row["share"] for row in runs.duration_share(df, ["g"], "ms").collect()}
        assert got == {1: 1.0, 2: 0.5, 3: 0.0, 4: 1.0, 5: None}
    spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_limits_are_checked(spark):
    from tidegate.results import GateError

    with pytest.raises(GateError, match="limit must be positive"):
        text.preview(F.lit("x"), 0)


def test_ranges_of_a_busy_package(spark):
    chance = random.Random(11)
    numbers = [f"{major}.{minor}" for major in range(12) for minor in range(9)]
    shapes = [("introduced",), ("introduced", "fixed"), ("introduced", "last_affected"), ("fixed", "introduced"),
              ("introduced", "fixed", "introduced", "last_affected")]
    rows = []
    for number in range(60):
        spans = [span(*[{kind: text} for kind, text in zip(shape, sorted(chance.sample(numbers, len(shape)), key=lambda v: [int(p) for p in v.split(".")]))])
                 for shape in chance.choices(shapes, k=chance.randrange(3))]
        rows.append((f"A{number % 50}", "gh", "busy", chance.sample(numbers, 2) if number % 5 == 0 else None, spans))
    rows.append(("same", "gh", "busy", None, [span({"introduced": "3"}, {"fixed": "3"}), span({"last_affected": "4"}, {"introduced": "4"})]))
    schema = f"id string, ecosystem string, name string, versions array<string>, ranges {ranges.RANGES}"
    items = [(n, "gh", "busy", version) for n, version in enumerate(numbers * 2)] + [(900, "gh", "busy", None), (901, None, "busy", "3.1"), (902, "gh", None, "x")]
    got = ranges.match_ranges(spark.createDataFrame(items, "n long, ecosystem string, name string, version string"), spark.createDataFrame(rows, schema))
    want = sorted({(n, advisory) for n, _, _, version in items[:-3] for advisory, _, _, listed, spans in rows
                   if version in (listed or []) or plainly(version, spans)})
    assert sorted((row["n"], row["advisory"]) for row in got.collect()) == want


def test_pieces_grow_by_the_logarithm(spark):
    """A package with 20,000 releases and 2,000 spans, endless ones included: lookups, pieces and pairs stay close to the hits."""
    releases = spark.range(20000).select(F.lit("gh").alias("ecosystem"), F.lit("p").alias("__name"), F.array(F.col("id").cast("decimal(38,0)")).alias("at"))
    at = lambda number: F.array(number.cast("decimal(38,0)"))
    spans = spark.range(2000).select(
        F.lit("gh").alias("ecosystem"), F.lit("p").alias("__name"), F.col("id").cast("string").alias("advisory"),
        at(F.when(F.col("id") < 5, F.col("id") * 3000).otherwise(F.col("id") * 9)).alias("low"), F.lit(False).alias("low_open"),
        F.when(F.col("id") >= 5, at(F.col("id") * 9 + 4)).alias("high"), F.lit(True).alias("high_open"))
    hits = ranges.span_hits(releases, spans)
    assert hits.count() == 1995 * 4 + sum(20000 - 3000 * number for number in range(5))
    places = spark.range(1).select(F.explode(ranges.dyadic(F.lit(3).cast("long"), F.lit(40_000_000_000).cast("long"))).alias("piece")).select("piece.*")
    pieces = [(row["number"] << row["level"], 1 << row["level"]) for row in places.collect()]
    assert len(pieces) <= 72 and sum(length for _, length in pieces) == 40_000_000_000 - 2
    ends = sorted(pieces)
    assert ends[0][0] == 3 and all(a + length == b for (a, length), (b, _) in zip(ends, ends[1:]))
