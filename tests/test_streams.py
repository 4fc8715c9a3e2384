"""Streams over several micro-batches against the batch operators."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidegate.operators import alerts as rules
from tidegate.operators.counters import counter_increase, rolling_sum
from tidegate.operators.mix import run_mix
from tidegate.streaming import tables, windows

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


class Source:
    """A folder that a stream reads one file at a time."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.count = spark, str(folder), schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        # Files are read in the order of their time stamps.
        for name in os.listdir(self.folder):
            path = os.path.join(self.folder, name)
            if os.path.getmtime(path) > 2_000_000_000 or name.startswith((".", "_")):
                continue
            self.count += 1
            os.utime(path, (2_000_000_000 + self.count, 2_000_000_000 + self.count))

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)

    def table(self):
        return self.spark.read.schema(self.schema).parquet(self.folder)


def run(stream, tmp_path, name):
    out = str(tmp_path / name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", out + "-progress").trigger(availableNow=True)
    writer.start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_windowed_mix(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "ts timestamp, state string")
    source.add([(at(i), ["success", "failed", "running", None][i % 4]) for i in range(25)])
    source.add([(at(i), "queued") for i in range(20, 40)])
    source.add([(at(i), "queued") for i in range(40, 60)] + [(at(0), "failed")])
    out = run(windows.windowed_mix(source.stream()), tmp_path, "mix")
    got = {row["window_start"]: (row["success"], row["failed"], row["running"], row["waiting"]) for row in out.collect()}
    # The failed run of minute 0 came last, after its window was closed.
    batch = run_mix(source.table().withColumn("w", F.window("ts", "10 minutes")["start"]), ("w",))
    want = {row["w"]: (row["success"], row["failed"], row["running"], row["waiting"]) for row in batch.collect()}
    first = want.pop(T0)
    want[T0] = (first[0], first[1] - 1, first[2], first[3])
    assert got == {start: value for start, value in want.items() if start <= at(30)}


def test_rolling_rejections(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "engine string, ts timestamp, started_at timestamp, rejected long")
    source.add([("e", at(0), T0, 2), ("e", at(1), T0, 5), ("f", at(0), T0, 1)])
    source.add([("e", at(4), T0, 9), ("e", at(11), T0, 10)])
    # The first is eight minutes late and counts, the second eleven and doesn't; two share a time.
    source.add([("e", at(3), T0, 7), ("e", at(0), T0, 100), ("e", at(11), T0, 12), ("e", at(12), at(12), 4), ("f", at(9), T0, 6)])
    source.add([("e", at(13), at(12), 5), (None, at(13), T0, 5)])
    source.add([("e", at(70), at(12), 6), (None, at(14), T0, 8)])
    base = str(tmp_path / "rolling")
    tables.rolling_rejections(source.stream(), base + "/out", base + "/state", base + "/progress", key=["engine"],
                              order=["rejected"], trigger={"availableNow": True}).awaitTermination()
    out = tables.newest(spark, base + "/out", ["engine", "ts", "rejected"])
    got = {(row["engine"], row["ts"], row["rejected"]): (row["increase"], row["rolling"]) for row in out.collect()}
    late = (F.col("engine") == "e") & (F.col("rejected") == 100)
    batch = rolling_sum(
        counter_increase(source.table().filter(~F.coalesce(late, F.lit(False))), ["engine"], "ts", "rejected", order=["rejected"]), ["engine"], "ts", "increase"
    )
    want = {(row["engine"], row["ts"], row["rejected"]): (row["increase"], row["rolling"]) for row in batch.collect()}
    assert got == want and want[("e", at(3), 7)] == (2, 5) and want[("e", at(4), 9)] == (2, 7)
    assert len([name for name in os.listdir(base + "/state") if name.startswith("version=")]) == 2


def test_latest_state(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "backend string, at timestamp, state string, latency_ms long")
    for batch in range(3):
        source.add([("a", at(batch * 100 + i), "UP", i) for i in range(100)] + [("b", at(batch), "NOT_CONFIGURED", None)])
    base = str(tmp_path / "latest")
    query = tables.latest_state(source.stream(), base + "/out", base + "/state", base + "/progress", key=["backend"], order=["at"])
    query.awaitTermination()
    rows = spark.read.parquet(base + "/out/batch=2").collect()
    assert [(row["backend"], row["checks"], row["latest"], row["median"], row["latest_state"]) for row in rows] == [("a", 120, 99, 59.5, "UP")]


def test_ends_count_once(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "run_id long, kind string, ts timestamp")
    source.add([(1, "end", at(0)), (1, "end", at(1)), (2, "begin", at(1)), (2, "end", at(2))])
    source.add([(1, "end", at(3)), (3, "end", at(60))])
    source.add([(6, "end", at(61))])
    source.add([(4, "end", at(5)), (5, "end", at(62))])
    out = run(windows.dedupe_ends(source.stream()), tmp_path, "ends")
    # The end of run 4 is older than the watermark.
    assert sorted(row["run_id"] for row in out.collect()) == [1, 2, 3, 5, 6]


def test_matched_runs(spark, tmp_path):
    begins = Source(spark, tmp_path / "b", "run_id long, ts timestamp")
    ends = Source(spark, tmp_path / "e", "run_id long, ts timestamp")
    begins.add([(1, at(0)), (2, at(1)), (3, at(2))])
    ends.add([(1, at(5)), (3, at(50))])
    begins.add([(9, at(300))])
    ends.add([(9, at(300))])
    begins.add([(10, at(301))])
    ends.add([(10, at(301))])
    out = run(windows.match_runs(begins.stream(), ends.stream()), tmp_path, "runs")
    got = {row["run_id"]: row["duration_ms"] for row in out.collect()}
    assert {key: got[key] for key in (1, 2, 3)} == {1: 300_000, 2: None, 3: None}


def test_windowed_quality(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "ts timestamp, a string, b string")
    source.add([(at(i), " " if i % 2 else "x", None if i % 3 else "y") for i in range(60)])
    source.add([(at(200), "x", "y")])
    out = run(windows.windowed_quality(source.stream(), ["a", "b"]), tmp_path, "quality").collect()
    assert [tuple(row) for row in out] == [(T0, 60, 70, 20, 56)]


def test_alert_changes(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "filename string, position int")
    source.add([("a.py", 0)])
    source.add([("a.py", 0), ("b.py", 1)])
    source.add([("a.py", 0), ("b.py", 1)])
    base = str(tmp_path / "alerts")
    tables.alert_changes(
        source.stream(), lambda batch: rules.alerts(errors=batch), base + "/out", base + "/state", base + "/progress"
    ).awaitTermination()
    rows = tables.appended(spark, base + "/out").orderBy("batch").collect()
    assert [(row["batch"], row["change"], row["title"][:2]) for row in rows] == [(0, "insert", "1 "), (1, "update", "2 ")]


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_landing(spark, tmp_path, write, files_per_batch):
    write("landing/a.csv", "id,name\n1,a\n2,b\n")
    write("landing/b.csv", b"id,name\n3,caf\xe9\n")
    write("landing/c.csv", "id,name\nx,y\n")
    write("landing/wide + %20.csv", "id,name,more\n5,e,f\n")
    write("landing/other.csv", "id,title\n6,g\n")
    write("landing/ragged.csv", "id,name\n7,h\n8\n")
    write("landing/MALFORMED_RECORD ok.csv", "ID,Name\n9,i\n")
    write("landing/empty.csv", "")
    write("landing/quote.csv", 'id,name\n10,"j"k\n')
    base = str(tmp_path / "work")

    def ingest():
        tables.ingest_landing(
            spark, str(tmp_path / "landing"), base + "/out", base + "/bad", base + "/progress", schema="id INT, name STRING",
            files_per_batch=files_per_batch,
        ).awaitTermination()

    ingest()
    write("landing/d.csv", 'id,name\n4,"d\nd"\n')
    ingest()
    ingest()
    rows = tables.appended(spark, base + "/out").orderBy("id").collect()
    assert [(row["id"], row["name"]) for row in rows] == [(1, "a"), (2, "b"), (4, "d\nd"), (9, "i")]
    bad = {os.path.basename(row["path"]): row["problem"] for row in spark.read.json(base + "/bad").collect()}
    assert set(bad) == {"b.csv", "c.csv", "wide + %20.csv", "other.csv", "ragged.csv", "quote.csv"}
    assert bad["wide + %20.csv"] == "the header has 3 column(s), the schema has 2"
    listed = spark.read.json(base + "/bad-manifest").collect()
    assert len(listed) == 9 and sum(row["problem"] is not None for row in listed) == 6
    assert bad["b.csv"].startswith("input is not valid UTF-8") and "x" not in json.dumps(bad["c.csv"])
