"""Stateful streams over several micro-batches, against the definition on the whole table."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.test_streams import T0, Source, at, run
from tidegate.streaming import machines


def newest(out):
    rows = {}
    for row in sorted(out.collect(), key=lambda r: r["version"]):
        rows[row["run"]] = (row["status"], row["started_at"], row["ended_at"], row["duration_ms"])
    return rows


def test_lives_of_runs(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "run_id long, kind string, ts timestamp")
    source.add([(1, "begin", at(0)), (2, "begin", at(1)), (3, "end", at(9)), (4, "begin", at(2)), (None, "begin", at(3)), (6, "pause", at(3))])
    source.add([(1, "end", at(5)), (1, "end", at(6)), (3, "begin", at(3)), (5, "begin", at(20))])
    source.add([(9, "begin", at(60))])
    source.add([(10, "begin", at(61))])
    source.add([(4, "end", at(55))])
    out = run(machines.run_lives(source.stream()), tmp_path, "lives")
    assert newest(out) == {
        "1": ("finished", at(0), at(5), 300_000), "2": ("unfinished", at(1), None, None), "3": ("finished", at(3), at(9), 360_000),
        "4": ("late", at(2), at(55), 53 * 60_000), "5": ("unfinished", at(20), None, None), "9": ("running", at(60), None, None),
        "10": ("running", at(61), None, None),
    }
    four = [(row["version"], row["status"]) for row in out.filter("run = '4'").orderBy("version").collect()]
    assert four == [(1, "running"), (2, "unfinished"), (3, "late")]


def lives_by_definition(rows, mark, timeout):
    """Status, begin and end of each run of (run, kind, time), when the watermark has come to ``mark``."""
    begins, ends = {}, {}
    for run_id, kind, ts in rows:
        firsts = begins if kind == "begin" else ends
        firsts[run_id] = min(firsts.get(run_id, ts), ts)
    found = {}
    for run_id, began in begins.items():
        ended = ends.get(run_id)
        ended = ended if ended is not None and ended >= began else None
        status = "unfinished" if began + timeout < mark else "running"
        if ended is not None:
            status = "finished" if ended <= began + timeout else "late"
        length = None if ended is None else (ended - began) // dt.timedelta(milliseconds=1)
        found[str(run_id)] = (status, began, ended, length)
    return found


def test_states_are_few_for_many_runs(spark, tmp_path):
    chance = random.Random(7)
    rows = []
    for run_id in range(3000):
        began = T0 + dt.timedelta(seconds=chance.randrange(6 * 3600))
        rows.append((run_id, "begin", began))
        if run_id % 3:
            rows.append((run_id, "end", began + dt.timedelta(seconds=chance.randrange(-300, 3600))))
    rows.sort(key=lambda row: row[2])
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        source = Source(spark, tmp_path / "in", "run_id long, kind string, ts timestamp")
        # Every fifth row of the last eight minutes before a file's end comes with the next one.
        cuts, arrivals = [at(100), at(200), at(300)], [[], [], [], []]
        for number, row in enumerate(rows):
            arrivals[sum(row[2] + dt.timedelta(minutes=8 * (number % 5 == 0)) >= cut for cut in cuts)].append(row)
        for arrival in arrivals:
            source.add(arrival)
        source.add([(5000, "begin", None), (None, "begin", at(3)), (9000, "begin", at(500))])
        out = str(tmp_path / "lives")
        writer = machines.run_lives(source.stream()).writeStream.format("parquet").option("checkpointLocation", out + "-progress")
        query = writer.trigger(availableNow=True).start(out)
        query.awaitTermination()
        got = newest(spark.read.parquet(out))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == lives_by_definition([*rows, (9000, "begin", at(500))], at(490), dt.timedelta(minutes=30))
    assert {status for status, *_ in got.values()} == {"finished", "late", "unfinished", "running"}
    # A call to the state store for each run took most of the time.
    assert max(operator["numRowsTotal"] for p in query.recentProgress for operator in p["stateOperators"]) < 1500


def brute(rows, within):
    """(start of the hour -> rows, duplicates): each row but the first of a chain has an equal one at most ``within`` before."""
    counts, last = {}, {}
    for ts, a in sorted(rows, key=lambda r: r[0]):
        start = ts.replace(minute=0, second=0, microsecond=0)
        n, copies = counts.get(start, (0, 0))
        follows = a in last and ts - last[a] <= within
        counts[start], last[a] = (n + 1, copies + follows), ts
    return counts


def test_copies_across_windows(spark, tmp_path):
    chance = random.Random(4)
    rows = [(T0 + dt.timedelta(seconds=chance.randrange(6 * 3600)), chance.choice("abcdefgh") * chance.randint(1, 6)) for _ in range(400)]
    rows += [(at(59), "edge"), (at(60), "edge"), (at(121), "edge"), (at(119), "other"), (at(119), "other")]
    rows.sort()
    # Every third row of the last eight minutes before a file's end comes with the next one.
    cuts = [at(100), at(200), at(300)]
    arrivals = [[], [], [], []]
    for number, (ts, a) in enumerate(rows):
        shown = ts + dt.timedelta(minutes=8) if number % 3 == 0 else ts
        arrivals[sum(shown >= cut for cut in cuts)].append((ts, a))
    source = Source(spark, tmp_path / "in", "ts timestamp, a string")
    for arrival in arrivals:
        source.add(arrival)
    source.add([(at(5000), "end"), (None, "x")])
    out = run(machines.quality_across_windows(source.stream(), ["a"]), tmp_path, "copies")
    got = {row["window_start"]: (row["rows"], row["duplicate_rows"]) for row in out.collect()}
    assert got == brute(rows, dt.timedelta(minutes=60)) and sum(copies for _, copies in got.values()) > 50


def test_chains():
    assert machines.merged([], 5, 7, 2) == ([(5, 7)], False, [])
    assert machines.merged([(1, 3), (9, 9)], 5, 7, 2) == ([(1, 9)], True, [9])
    assert machines.merged([(6, 9)], 5, 5, 2) == ([(5, 9)], False, [6])
    assert machines.merged([(1, 2)], 5, 5, 2) == ([(1, 2), (5, 5)], False, [])
    assert machines.merged([(1, 9)], 4, 4, 2) == ([(1, 9)], True, [])
