"""Operators against brute force on data in which one key holds a third of the rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidegate.operators.counters import counter_increase, rolling_sum
from tidegate.operators.latency import exact_median
from tidegate.operators.quality import quality_counts
from tidegate.scale import newest_per, number_within

MINUTE = 60


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = []
    for number in range(6000):
        key = "hot" if number % 3 == 0 else rng.choice(["a", "b", "c", None])
        value = rng.choice([None, 0.0, -3.5, 7.25, round(rng.uniform(-50, 5000), 2), 1e9 * rng.random()])
        made.append((key, number, rng.randrange(0, 90 * 24 * 3600), value, rng.randrange(0, 4), rng.randrange(0, 50)))
    return made


@pytest.fixture(scope="module")
def table(spark, rows):
    schema = "key string, id long, second long, value double, started long, counter long"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("second")).repartition(8).cache()


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("n", [1, 10, 1500])
def test_newest(table, rows, n):
    got = {(row["key"], row["id"]) for row in newest_per(table, ["key"], ["second", "id"], n).collect()}
    want = {(key, row[1]) for key, group in by_key(rows).items() for row in sorted(group, key=lambda r: (-r[2], -r[1]))[:n]}
    assert got == want


def test_median(table, rows):
    got = {row["key"]: row["median"] for row in exact_median(table, ["key"], "value").collect()}
    want = {key: statistics.median(row[3] for row in group if row[3] is not None) for key, group in by_key(rows).items()}
    assert got == want


def test_counters(table, rows):
    grown = counter_increase(table, ["key"], "ts", "counter", started="started", order=["id"])
    summed = rolling_sum(grown, ["key"], "ts", "increase", minutes=300)
    got = {row["id"]: (row["increase"], row["rolling"]) for row in summed.collect()}
    want = {}
    for group in by_key(rows).values():
        ordered = sorted(group, key=lambda r: (r[2], r[1]))
        increases = []
        for before, row in zip([None, *ordered], ordered):
            same = before is not None and before[4] == row[4]
            increases.append(max(0, row[5] - before[5]) if same else 0)
        for row, increase in zip(ordered, increases):
            window = sum(i for r, i in zip(ordered, increases) if row[2] - 300 * MINUTE <= r[2] <= row[2])
            want[row[1]] = (increase, window)
    assert got == want


def test_numbers(table, rows):
    got = {row["id"]: row["n"] for row in number_within(table, ["key"], "id", "n").collect()}
    want = {row[1]: i for group in by_key(rows).values() for i, row in enumerate(sorted(group, key=lambda r: r[1]))}
    assert got == want


def test_copies(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("a"), F.when(F.col("id") % 3 == 0, " ").alias("b")
    )
    row = quality_counts(df).first()
    assert row.asDict() == {"rows": 9000, "columns": 2, "blankCells": 9000, "blankRows": 0, "duplicateRows": 2999}
