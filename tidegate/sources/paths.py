"""Path checks that belong to publishing: literal inputs, no overlap, confinement below a data root."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import SparkSession

from tidegate.results import GateError

GLOB_CHARACTERS = set("{}[]*?\\")


def hadoop_path(spark: SparkSession, value: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(value)


def file_system(spark: SparkSession, value: str):
    return hadoop_path(spark, value).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, value: str) -> bool:
    return file_system(spark, value).exists(hadoop_path(spark, value))


def delete(spark: SparkSession, value: str) -> None:
    file_system(spark, value).delete(hadoop_path(spark, value), True)


def require_literal(spark: SparkSession, value: str, label: str = "input") -> None:
    if GLOB_CHARACTERS & set(hadoop_path(spark, value).toString()):
        raise GateError(
            f"{label} must be a literal file or directory path; glob patterns cannot be overlap-checked"
        )


def _location(spark: SparkSession, value: str) -> tuple[tuple[str, str], str]:
    """(file system, path) with `..`, local links, host case and default port resolved; the root's path is empty."""
    system = file_system(spark, value)
    uri = system.makeQualified(hadoop_path(spark, value)).toUri().normalize()
    scheme, path = (uri.getScheme() or "").lower(), uri.getPath()
    if scheme == "file":
        path = os.path.realpath(path)
    host, port = (uri.getHost() or uri.getAuthority() or "").lower(), uri.getPort()
    if port == -1:
        port = system.getUri().getPort()
    if port == -1 and scheme == "hdfs":
        port = 8020
    return (scheme, f"{host}:{port}"), path.rstrip("/")


def _within(inner, outer) -> bool:
    return inner[0] == outer[0] and (inner[1] == outer[1] or inner[1].startswith(outer[1] + "/"))


def require_separate(spark: SparkSession, source: str, target: str) -> None:
    a, b = _location(spark, source), _location(spark, target)
    if _within(a, b) or _within(b, a):
        raise GateError("Input and output paths must not overlap")


def require_inside(spark: SparkSession, root: str, label: str, value: str) -> None:
    if not hadoop_path(spark, root).isAbsolute():
        raise GateError("data_root must be an absolute path")
    base, target = _location(spark, root), _location(spark, value)
    if not _within(target, base) or target[1] == base[1]:
        raise GateError(f"{label} must be inside the configured data root")


def plain_path(path: str) -> str:
    """A file's path in the form of listings: not escaped, one slash after the scheme."""
    return re.sub(r"^([A-Za-z0-9]+):/+", r"\1:/", unquote(path))
