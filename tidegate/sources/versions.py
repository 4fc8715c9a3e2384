"""A folder of versions: data is written first, then one small manifest commits it; readers take the newest whole one.

Nothing is renamed and nothing is written twice, so it also holds on object stores. Below the root lie folders
``data-...`` and ``_manifests/<number>.json``. A manifest names the folders of its version and ends with a checksum; one
that was cut off does not count. Whoever dies between two steps leaves the version before whole.
"""

from __future__ import annotations

import json
import re
import time
import uuid
import zlib
from datetime import timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tidegate.operators.runs import latest_of
from tidegate.results import GateError
from tidegate.scale import materialize_measured, scratch_dir
from tidegate.sources.paths import delete, exists, file_system, hadoop_path

MANIFEST = re.compile(r"(\d{10})\.json")
DATA = re.compile(r"data-[0-9a-f]{32}")
SCRATCH = re.compile(r"[A-Za-z0-9_.-]+-[0-9a-f]{32}")
BUCKET = "__bucket"


def _listed(spark: SparkSession, path: str, names: re.Pattern) -> dict[str, int]:
    """The names below ``path`` of the given form, with the time of their last change in milliseconds."""
    if not exists(spark, path):
        return {}
    found = file_system(spark, path).listStatus(hadoop_path(spark, path))
    return {name: status.getModificationTime() for status in found if names.fullmatch(name := status.getPath().getName())}


def _manifest(spark: SparkSession, root: str, name: str) -> dict | None:
    """A manifest's content; None if it was cut off."""
    path = f"{root}/_manifests/{name}"
    try:
        stream = file_system(spark, path).open(hadoop_path(spark, path))
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "ChecksumException":
            return None
        raise
    body, mark, check = text.rpartition("\n#")
    return json.loads(body) if mark and check == f"{zlib.crc32(body.encode()):08x}\n" else None


def _newest(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """The number of the last manifest, whole or not, and the content of the newest whole one."""
    names = sorted(_listed(spark, f"{root}/_manifests", MANIFEST), reverse=True)
    found = (content for name in names if (content := _manifest(spark, root, name)) is not None)
    return (int(names[0][:10]) if names else 0), next(found, None)


def _commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    path, body = f"{root}/_manifests/{number:010d}.json", json.dumps(content, sort_keys=True)
    try:
        out = file_system(spark, path).create(hadoop_path(spark, path), False)
    except Py4JJavaError as error:
        if exists(spark, path):
            raise GateError(f"Another commit came first: version {number}") from error
        raise
    out.write(bytearray(f"{body}\n#{zlib.crc32(body.encode()):08x}\n".encode()))
    out.close()


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, root: str) -> str:
    folder = f"data-{uuid.uuid4().hex}"
    df.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    return folder


def commit(df: DataFrame, root: str, key: list[str], *, buckets: int = 64) -> int:
    """Makes ``df`` the newest version and answers its number; readers of older versions are not disturbed.

    Rows lie in ``buckets`` folders by a hash of the key, so that ``upsert`` can replace some of them: choose the number
    so that a bucket fits a task, and keep in mind that a manifest has an entry for each. Rows that share a key are kept.
    """
    floating = [name for name in key if isinstance(df.schema[name].dataType, (FloatType, DoubleType))]
    if not key or floating:
        raise GateError("A version needs key columns that are no floating-point numbers")
    spark, (number, _) = df.sparkSession, _newest(df.sparkSession, root)
    dealt, seen = materialize_measured(
        df.withColumn(BUCKET, bucket_of(key, buckets)), "version", F.collect_set(BUCKET).alias("buckets"))
    folder = _write(dealt, root) if seen["buckets"] else None
    places = {str(bucket): f"{folder}/{BUCKET}={bucket}" for bucket in sorted(seen["buckets"])}
    _commit(spark, root, number + 1, {"schema": df.schema.jsonValue(), "key": key, "buckets": buckets, "places": places})
    return number + 1


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the newest version."""
    _, content = _newest(spark, root)
    if content is None:
        raise GateError("No version has been committed")
    return _read(spark, root, content, list(content["places"]))


def _read(spark: SparkSession, root: str, content: dict, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(content["schema"])
    paths = [f"{root}/{content['places'][bucket]}" for bucket in buckets if bucket in content["places"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(new: DataFrame, root: str, order: list[str]) -> dict:
    """Adds or replaces rows by key and answers {"version", "touched", "buckets"}.

    Of the rows of a key the highest by ``order`` stays, of equals a new one. Only the buckets that hold a new key are read
    and written again; the others are named by the new manifest as they are. If another writer commits meanwhile, this
    fails and changes nothing.
    """
    spark, (number, content) = new.sparkSession, _newest(new.sparkSession, root)
    if content is None:
        raise GateError("No version has been committed")
    key, buckets, schema = content["key"], content["buckets"], StructType.fromJson(content["schema"])
    if sorted(new.columns) != sorted(schema.fieldNames()):
        raise GateError("New rows must have the columns of the version")
    typed = new.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema])
    # New rows are combined by key first: a key may be on many of them.
    fresh = latest_of(typed, key, order).withColumn(BUCKET, bucket_of(key, buckets))
    fresh, seen = materialize_measured(fresh, "upsert", F.collect_set(BUCKET).alias("buckets"))
    touched = sorted(seen["buckets"])
    if not touched:
        return {"version": number, "touched": 0, "buckets": buckets}
    old = _read(spark, root, content, [str(bucket) for bucket in touched]).withColumn(BUCKET, bucket_of(key, buckets))
    both = old.withColumn("__new", F.lit(False)).unionByName(fresh.withColumn("__new", F.lit(True)))
    # Grouping by bucket and key needs no shuffle beyond that by bucket.
    together = both.repartition(BUCKET)
    merged = latest_of(together, [BUCKET, *key], [*order, "__new"]).drop("__new")
    folder = _write(merged, root)
    places = content["places"] | {str(bucket): f"{folder}/{BUCKET}={bucket}" for bucket in touched}
    _commit(spark, root, number + 1, content | {"places": places})
    return {"version": number + 1, "touched": len(touched), "buckets": buckets}


def expire(spark: SparkSession, root: str, *, keep: int = 2, min_age: timedelta = timedelta(days=1)) -> dict:
    """Deletes versions and data that nobody needs, and answers how many {"manifests", "folders"}.

    The newest ``keep`` versions stay, and each that was replaced less than ``min_age`` ago. Data go that no manifest left
    names and that are older than that: let it exceed the longest write and the longest read.
    """
    if keep < 1:
        raise GateError("keep must be at least 1")
    before = time.time() * 1000 - min_age.total_seconds() * 1000
    listed = _listed(spark, f"{root}/_manifests", MANIFEST)
    contents = {name: _manifest(spark, root, name) for name in sorted(listed)}
    whole = [name for name, content in contents.items() if content is not None]
    replaced = [name for name, later in zip(whole, whole[1:]) if listed[later] < before][: max(0, len(whole) - keep)]
    torn = [name for name in contents if contents[name] is None and whole and name < whole[-1] and listed[name] < before]
    # Manifests go first: a manifest must never name data that are gone.
    for name in [*replaced, *torn]:
        delete(spark, f"{root}/_manifests/{name}")
    used = {place.split("/")[0] for name in whole if name not in replaced for place in contents[name]["places"].values()}
    gone = [name for name, changed in _listed(spark, root, DATA).items() if name not in used and changed < before]
    for name in gone:
        delete(spark, f"{root}/{name}")
    return {"manifests": len(replaced) + len(torn), "folders": len(gone)}


def clean_scratch(spark: SparkSession, min_age: timedelta = timedelta(days=7)) -> int:
    """Deletes what this library wrote to the shared folder longer ago than any job may run; answers how many folders."""
    base, before = scratch_dir(spark), time.time() * 1000 - min_age.total_seconds() * 1000
    old = [name for name, changed in _listed(spark, base, SCRATCH).items() if changed < before]
    for name in old:
        delete(spark, f"{base}/{name}")
    return len(old)
