"""What a gate answers: a status, a message and its metrics, also as a table row."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

SUCCEEDED = "SUCCEEDED"
FAILED = "FAILED"

RESULT_SCHEMA = (
    "jobName string, status string, message string, metrics map<string,string>, "
    "startedAt timestamp, finishedAt timestamp"
)


class GateError(ValueError):
    """Input or parameters break a contract; the message never holds cell or parameter values."""


# What a failed Spark job raises; inside a stream's batch function it arrives unconverted.
JOB_ERRORS = (GateError, PySparkException, Py4JJavaError)


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass(frozen=True)
class GateResult:
    name: str
    status: str
    message: str
    metrics: dict[str, str]
    started_at: datetime = field(default_factory=utc_now)
    finished_at: datetime = field(default_factory=utc_now)

    @property
    def ok(self) -> bool:
        return self.status == SUCCEEDED

    @property
    def duration_millis(self) -> int:
        return max(0, int((self.finished_at - self.started_at).total_seconds() * 1000))

    def all_metrics(self) -> dict[str, str]:
        """The metrics in key order, with the run's own duration."""
        return dict(sorted({**self.metrics, "durationMillis": str(self.duration_millis)}.items()))

    def to_json(self) -> str:
        return json.dumps(
            {
                "jobName": self.name,
                "status": self.status,
                "message": self.message,
                "metrics": self.all_metrics(),
            },
            ensure_ascii=False,
            separators=(",", ":"),
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        row = (self.name, self.status, self.message, self.all_metrics(), self.started_at, self.finished_at)
        return spark.createDataFrame([row], RESULT_SCHEMA)


def succeeded(name: str, message: str, metrics: dict[str, str], started_at: datetime) -> GateResult:
    return GateResult(name, SUCCEEDED, message, metrics, started_at)


def failed(name: str, message: str, metrics: dict[str, str], started_at: datetime) -> GateResult:
    return GateResult(name, FAILED, message, metrics, started_at)


def int64(value, key: str, minimum: int = 0) -> int:
    """A whole number between ``minimum`` and 2^63-1; the refused value is not repeated."""
    try:
        number = value if isinstance(value, int) and not isinstance(value, bool) else int(str(value).strip(), 10)
    except ValueError:
        number = None
    if number is None or not minimum <= number < 2**63 or "_" in str(value):
        raise GateError(f"{key} must be a 64-bit integer >= {minimum}")
    return number
