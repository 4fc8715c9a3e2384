import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidegate.results import GateError
from tidegate.sources import versions

SCHEMA = "id long, at long, value string"
NONE = dt.timedelta(0)


def rows(spark, root):
    return {row["id"]: (row["at"], row["value"]) for row in versions.read_version(spark, root).collect()}


def base(spark, n=1000):
    return spark.range(n).select("id", F.lit(1).cast("long").alias("at"), F.lit("old").alias("value"))


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "table")
    assert versions.commit(base(spark), root, ["id"], buckets=50) == 1
    first = set(os.listdir(root))
    new = spark.createDataFrame([(3, 2, "new"), (3, 1, "older"), (5, 0, "late"), (7, 1, "tie"), (5000, 1, "added"), (None, 1, "null"), (None, 2, "null2")], SCHEMA)
    done = versions.upsert(new, root, ["at"])
    assert done["version"] == 2 and done["touched"] <= 5
    want = {number: (1, "old") for number in range(1000)} | {3: (2, "new"), 7: (1, "tie"), 5000: (1, "added"), None: (2, "null2")}
    assert rows(spark, root) == want
    added = (set(os.listdir(root)) - first).pop()
    assert sum(name.startswith("__bucket") for name in os.listdir(f"{root}/{added}")) == done["touched"]
    # Running it again changes nothing but the number.
    assert versions.upsert(new, root, ["at"])["version"] == 3 and rows(spark, root) == want
    assert versions.upsert(new.limit(0), root, ["at"])["touched"] == 0


@pytest.mark.parametrize("step", ["_write", "_commit", "torn", "empty"])
def test_killed_between_steps(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "table")
    versions.commit(base(spark, 20), root, ["id"], buckets=4)
    before = rows(spark, root)
    new = spark.createDataFrame([(1, 2, "new")], SCHEMA)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        if step == "_write":
            real = versions._write
            patch.setattr(versions, "_write", lambda df, path: (real(df, path), die()))
        elif step == "_commit":
            patch.setattr(versions, "_commit", die)
        if step in ("_write", "_commit"):
            with pytest.raises(KeyboardInterrupt):
                versions.upsert(new, root, ["at"])
        else:
            with open(f"{root}/_manifests/0000000001.json") as whole, open(f"{root}/_manifests/0000000002.json", "w") as cut:
                cut.write(whole.read()[:60] if step == "torn" else "")
    assert rows(spark, root) == before
    assert versions.upsert(new, root, ["at"])["version"] == (3 if step in ("torn", "empty") else 2)
    assert rows(spark, root) == before | {1: (2, "new")}


def test_another_writer(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    versions.commit(base(spark, 20), root, ["id"], buckets=4)
    new, real = spark.createDataFrame([(1, 2, "new")], SCHEMA), versions._write

    def slow(df, path):
        folder = real(df, path)
        monkeypatch.setattr(versions, "_write", real)
        versions.upsert(spark.createDataFrame([(2, 2, "first")], SCHEMA), root, ["at"])
        return folder

    monkeypatch.setattr(versions, "_write", slow)
    with pytest.raises(GateError, match="Another commit came first"):
        versions.upsert(new, root, ["at"])
    assert rows(spark, root)[2] == (2, "first") and rows(spark, root)[1] == (1, "old")


def test_expire_keeps_what_is_read(spark, tmp_path):
    root = str(tmp_path / "table")
    versions.commit(base(spark, 200), root, ["id"], buckets=8)
    for number in range(3):
        versions.upsert(spark.createDataFrame([(number, 5, "new")], SCHEMA), root, ["at"])
    # Data that no manifest names, of a writer that was killed or still writes.
    versions._write(base(spark, 5).withColumn("__bucket", F.lit(0)), root)
    before = rows(spark, root)
    assert versions.expire(spark, root) == {"manifests": 0, "folders": 0}
    assert versions.expire(spark, root, keep=1, min_age=NONE) == {"manifests": 3, "folders": 1}
    assert rows(spark, root) == before and len(os.listdir(f"{root}/_manifests")) >= 1
    versions.commit(base(spark, 3), root, ["id"], buckets=8)
    assert versions.expire(spark, root, keep=1, min_age=NONE) == {"manifests": 1, "folders": 4}
    assert len(rows(spark, root)) == 3


def test_refusals(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(GateError, match="No version"):
        versions.read_version(spark, root)
    with pytest.raises(GateError, match="floating"):
        versions.commit(spark.createDataFrame([(1.0,)], "x double"), root, ["x"])
    versions.commit(base(spark, 0), root, ["id"])
    assert rows(spark, root) == {}
    with pytest.raises(GateError, match="columns"):
        versions.upsert(spark.range(1), root, ["id"])
    assert versions.upsert(base(spark, 2), root, ["at"])["touched"] == 2
    assert len(rows(spark, root)) == 2


def test_scratch_is_cleaned_by_age(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "scratch_dir", lambda _: str(tmp_path))
    ours, theirs = tmp_path / f"graph-ways-{'a' * 32}", tmp_path / "rocks"
    ours.mkdir()
    theirs.mkdir()
    assert versions.clean_scratch(spark) == 0
    os.utime(ours, (0, 0))
    os.utime(theirs, (0, 0))
    assert versions.clean_scratch(spark) == 1 and theirs.exists() and not ours.exists()
