"""Streams that keep a small table of state on the shared folder, one version per micro-batch.

Each micro-batch is worked on by the batch operators, so a busy key is spread over tasks here as well. A version is
written before the next batch starts; a batch that runs again after a failure reads the same version it read before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tidegate.operators.changes import snapshot_diff
from tidegate.operators.counters import counter_increase, rolling_sum
from tidegate.operators.latency import latency_stats
from tidegate.operators.runs import SAMPLES, latest_of
from tidegate.results import JOB_ERRORS, GateError
from tidegate.scale import keyed_join, newest_per
from tidegate.sources.options import csv_options
from tidegate.sources.checks import header_problems, undecodable_files
from tidegate.sources.paths import delete, exists, file_system, hadoop_path, plain_path


class StateTable:
    """Versions of a table below ``path``; only the two newest are kept."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def _version(self, number: int) -> str:
        return f"{self.path}/version={number}"

    def before(self, batch: int) -> DataFrame:
        """What the state was when ``batch`` started."""
        found = self._newest_before(batch)
        if found is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._version(found))

    def _newest_before(self, batch: int) -> int | None:
        # Batches are numbered one by one, but one without data writes no version.
        if not exists(self.spark, self.path):
            return None
        listed = file_system(self.spark, self.path).listStatus(hadoop_path(self.spark, self.path))
        numbers = [int(entry.getPath().getName().split("=")[1]) for entry in listed if "=" in entry.getPath().getName()]
        return max((number for number in numbers if number < batch), default=None)

    def write(self, batch: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._version(batch))
        previous = self._newest_before(batch)
        older = None if previous is None else self._newest_before(previous)
        if older is not None:
            delete(self.spark, self._version(older))
        return self.spark.read.schema(self.schema).parquet(self._version(batch))


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _append(df: DataFrame, output: str, batch: int) -> None:
    """One folder per batch, replaced when the batch runs again."""
    df.write.mode("overwrite").parquet(f"{output}/batch={batch}")


def rolling_rejections(
    readings: DataFrame, output: str, state: str, checkpoint: str, *, key: list[str], at: str = "ts",
    started: str = "started_at", counter: str = "rejected", minutes: int = 10, delay_minutes: int = 10,
    order: list[str] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Appends each reading with its increase and the increases of the last minutes.

    A reading may be late by ``delay_minutes`` against the newest of its key; then it takes its place by (at, order), and
    later readings that it changes are appended once more: the newest version of a reading holds (see newest). Older ones
    are dropped. State is what a late reading can still touch: those of the delay and of the minutes before it.
    """
    columns, place = readings.columns, F.struct(at, *(order or []))
    numbers = [F.lit(0).cast("long").alias(name) for name in ("increase", "rolling")]
    table = StateTable(readings.sparkSession, state, readings.select("*", *numbers).schema)

    def back(count: int):
        return F.make_dt_interval(mins=F.lit(count))

    def work(batch_df: DataFrame, batch: int) -> None:
        kept = table.before(batch)
        seen = kept.groupBy(*key).agg(F.max(at).alias("__seen"))
        fresh = keyed_join(batch_df, seen, key, "left").filter(F.col("__seen").isNull() | (F.col(at) >= F.col("__seen") - back(delay_minutes)))
        nothing = F.lit(None).cast("long")
        rows = kept.select(*columns, F.col("increase").alias("__old"), F.col("rolling").alias("__sum"))
        rows = rows.unionByName(fresh.select(*columns, nothing.alias("__old"), nothing.alias("__sum")))
        first = rows.groupBy(*key).agg(F.min(place).alias("__first"), F.max(at).alias("__last"))
        grown = keyed_join(counter_increase(rows, key, at, counter, started=started, order=order), first, key)
        # The first reading kept has lost the one before it.
        settled = (place == F.col("__first")) & F.col("__old").isNotNull()
        grown = grown.withColumn("increase", F.when(settled, F.col("__old")).otherwise(F.col("increase")))
        summed = keyed_join(rolling_sum(grown, key, at, "increase", minutes=minutes), seen, key, "left")
        final = F.col("__sum").isNotNull() & (F.col(at) < F.col("__seen") - back(delay_minutes))
        summed = summed.withColumn("rolling", F.when(final, F.col("__sum")).otherwise(F.col("rolling")))
        changed = F.col("__old").isNull() | (F.col("__old") != F.col("increase")) | (F.col("__sum") != F.col("rolling"))
        _append(summed.filter(changed).select(*columns, "increase", "rolling"), output, batch)
        table.write(batch, summed.filter(F.col(at) >= F.col("__last") - back(delay_minutes + minutes)).select(*columns, "increase", "rolling"))

    return _start(readings, work, checkpoint, trigger)


def latest_state(
    samples: DataFrame, output: str, state: str, checkpoint: str, *, key: list[str], order: list[str],
    state_column: str = "state", latency: str = "latency_ms", n: int = SAMPLES, trigger: dict | None = None,
) -> StreamingQuery:
    """Keeps the last ``n`` samples of each backend; after each batch ``output`` holds its latest state and statistics."""
    table = StateTable(samples.sparkSession, state, samples.schema)

    def work(batch_df: DataFrame, batch: int) -> None:
        recorded = batch_df.filter(F.coalesce(F.col(state_column) != "NOT_CONFIGURED", F.lit(True)))
        kept = table.write(batch, newest_per(table.before(batch).unionByName(recorded), key, order, n))
        latest = latest_of(kept, key, order).select(*key, F.col(state_column).alias("latest_state"))
        stats = latency_stats(kept, key, at=order[0], state=state_column, latency=latency)
        keyed_join(stats, latest, key).write.mode("overwrite").parquet(f"{output}/batch={batch}")

    return _start(samples, work, checkpoint, trigger)


def alert_changes(
    stream: DataFrame, rules: Callable[[DataFrame], DataFrame], output: str, state: str, checkpoint: str, *,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Appends what changed among the alerts (by key) from one micro-batch to the next."""
    spark = stream.sparkSession
    schema = "key string, level string, title string, detail string, target string, dag_id string"
    table = StateTable(spark, state, schema)

    def work(batch_df: DataFrame, batch: int) -> None:
        now = table.write(batch, rules(batch_df).select("key", "level", "title", "detail", "target", "dag_id"))
        _append(snapshot_diff(table.before(batch), now, ["key"]).filter("changed"), output, batch)

    return _start(stream, work, checkpoint, trigger)


# Conditions and exception classes of Spark and its CSV parser for records, headers and bytes that break the
# format. Running again can't help against these.
DATA_CONDITIONS = {
    "MALFORMED_RECORD_IN_PARSING", "MALFORMED_CSV_RECORD", "MALFORMED_CHARACTER_CODING", "CANNOT_PARSE_DECIMAL", "INVALID_UTF8_STRING",
}
DATA_CLASSES = {"BadRecordException", "TextParsingException", "MalformedInputException", "CharConversionException"}


def causes(error: BaseException | None):
    """(class name, condition) of a Java error and of all that caused it; the condition is None where there is none."""
    java = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    seen = 0
    while java is not None and seen < 50:
        condition = None
        if java.getClass().getName().startswith("org.apache.spark"):
            try:
                condition = java.getCondition()
            except Exception:  # not one of Spark's classes that have conditions
                condition = None
        yield java.getClass().getSimpleName(), condition
        java, seen = java.getCause(), seen + 1


def of_data(error: BaseException) -> bool:
    """Whether an error comes from the bytes of a file, so that running again can't help."""
    if isinstance(error, GateError):
        return True
    return any(name in DATA_CLASSES or (condition or "").split(".")[0] in DATA_CONDITIONS for name, condition in causes(error))


def ingest_landing(
    spark: SparkSession, landing: str, output: str, quarantine: str, checkpoint: str, *, schema: str,
    encoding: str | None = None, files_per_batch: int = 1000, trigger: dict | None = None, **csv,
) -> StreamingQuery:
    """New CSV files become Parquet, each once; a file that breaks the contract is listed in ``quarantine`` instead.

    A batch has one folder and a manifest: its files, each with its problem or none. First heads and bytes are judged by
    file, then the files that are left are parsed and written in one pass that keeps malformed records apart. Only if there
    were any, the files without one are written again. A batch that runs again replaces its folder and its manifest; a
    reader can hold the rows against the manifest.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch).load(landing).select("path")
    )
    options = csv_options(spark, encoding=encoding, **csv)
    wanted = spark.createDataFrame([], schema).schema
    taken = {field.name.lower() for field in wanted}
    corrupt = next(name for number in range(len(taken) + 1) if (name := f"malformed{number}") not in taken)
    strict = {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "enforceSchema": "true"}

    def unfit(paths: list[str]) -> dict[str, str]:
        """Files whose head or bytes break the contract."""
        bad = {}
        if options["header"] == "true":
            heads = header_problems(spark, paths, [field.name for field in wanted], options)
            bad = {row["path"]: row["problem"] for row in heads.collect()}
        return bad | undecodable_files(spark, paths, options["encoding"])

    def write(paths: list[str], target: str) -> list[str]:
        """Writes the records that are whole and answers the files that have others."""
        rows = spark.read.format("csv").options(**strict).schema(StructType([*wanted.fields, StructField(corrupt, StringType())])).load(paths)
        broken = F.when(F.col(corrupt).isNotNull(), F.col("_metadata.file_path"))
        seen = Observation()
        observed = rows.select("*", broken.alias("__broken")).observe(seen, F.collect_set("__broken").alias("files"))
        observed.filter("__broken IS NULL").select([f"`{field.name}`" for field in wanted]).write.mode("overwrite").parquet(target)
        return list(seen.get["files"] or [])

    def ingest(paths: list[str], target: str) -> dict[str, str]:
        """Writes the sound files of a batch; answers the others with their problems."""
        bad = unfit(paths)
        fine = [path for path in paths if path not in bad]
        if not fine:
            return bad
        by_file = {plain_path(path): path for path in fine}
        found = {by_file[plain_path(path)]: "malformed records" for path in write(fine, target)}
        rest = [path for path in fine if path not in found]
        if found and rest:
            write(rest, target)
        elif found:
            delete(spark, target)
        return bad | found

    def alone(paths: list[str], target: str) -> dict[str, str]:
        """As ``ingest``; when the parser itself breaks on a file, the files are tried in halves until it stands alone."""
        try:
            return ingest(paths, target)
        except JOB_ERRORS as error:
            if not of_data(error):
                raise
            if len(paths) == 1:
                return {paths[0]: "malformed records"}
        half = len(paths) // 2
        trial = f"{target}-trial"
        bad = alone(paths[:half], trial) | alone(paths[half:], trial)
        delete(spark, trial)
        rest = [path for path in paths if path not in bad]
        return bad | (ingest(rest, target) if rest else {})

    def work(batch_df: DataFrame, batch: int) -> None:
        # At most files_per_batch names.
        paths = [row["path"] for row in batch_df.collect()]
        bad = alone(paths, f"{output}/batch={batch}")
        listed = [(path, bad.get(path)) for path in paths]
        spark.createDataFrame(listed, "path string, problem string").write.mode("overwrite").json(f"{quarantine}-manifest/batch={batch}")
        if bad:
            spark.createDataFrame(list(bad.items()), "path string, problem string").write.mode("overwrite").json(f"{quarantine}/batch={batch}")

    return _start(files, work, checkpoint, trigger)


def keep_updates(stream: DataFrame, output: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Appends what a batch has changed in an aggregation, also in windows that are still open (see newest)."""
    writer = stream.writeStream.outputMode("update").foreachBatch(lambda df, batch: _append(df, output, batch))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest(spark: SparkSession, output: str, key: list[str]) -> DataFrame:
    """The last version of each key among the batches, without their number."""
    found = appended(spark, output)
    last = found.groupBy(*key).agg(F.max("batch").alias("batch"))
    return keyed_join(found, last, [*key, "batch"]).drop("batch")


def appended(spark: SparkSession, output: str) -> DataFrame:
    """Everything a stream has appended so far, with the number of its batch."""
    return spark.read.parquet(output)
