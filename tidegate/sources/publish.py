"""Writing data so that a failure never costs the old output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegate.results import JOB_ERRORS, RESULT_SCHEMA, GateError, GateResult, failed, int64, succeeded, utc_now
from tidegate.sources.checks import require_decodable
from tidegate.sources.options import allow_charset, clean_schema, csv_options
from tidegate.sources.paths import delete, exists, file_system, hadoop_path, require_inside, require_literal, require_separate
from tidegate.sources.readers import read_dataset, require_data_files

MODES = {"overwrite", "append", "ignore", "error", "errorifexists"}


def write_mode(mode: str) -> str:
    name = mode.strip().lower()
    if name not in MODES:
        raise GateError("Invalid write mode")
    return name


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The table, and an observation that holds its row count once one action has run over it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_dataset(
    df: DataFrame, fmt: str, path: str, mode: str = "overwrite", options: dict[str, str] | None = None
) -> None:
    df.write.format(fmt).mode(write_mode(mode)).options(**(options or {})).save(path)


def publish(
    df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", options: dict[str, str] | None = None
) -> dict:
    """Writes in one pass and answers {"rows", "skipped"}.

    Overwrite writes next to the target and swaps by rename when every row was written; a failure before leaves the old
    output untouched. A failed append commits nothing. On stores whose rename copies, the swap is not atomic.
    """
    spark, mode = df.sparkSession, write_mode(mode)
    there = exists(spark, path)
    if there and mode == "ignore":
        return {"rows": 0, "skipped": True}
    if there and mode in ("error", "errorifexists"):
        raise GateError(f"Output already exists: {path}")
    observed, seen = counted(df)
    if mode != "overwrite":
        observed.write.format(fmt).mode(mode).options(**(options or {})).save(path)
        return {"rows": seen.get["rows"], "skipped": False}
    staged, old = (_beside(spark, path, kind) for kind in ("staged", "old"))
    system = file_system(spark, path)

    def move(source: str, target: str) -> None:
        if not system.rename(hadoop_path(spark, source), hadoop_path(spark, target)):
            raise GateError("output could not be moved into place")

    try:
        observed.write.format(fmt).mode("error").options(**(options or {})).save(staged)
        if there:
            move(path, old)
        elif exists(spark, path):
            # A rename would put the staged folder into the one that has appeared.
            raise GateError(f"Output appeared while it was written: {path}")
        try:
            move(staged, path)
        except Exception:
            if there:
                move(old, path)
            raise
    except BaseException:
        delete(spark, staged)
        raise
    if there:
        delete(spark, old)
    return {"rows": seen.get["rows"], "skipped": False}


def _beside(spark: SparkSession, path: str, kind: str) -> str:
    """A hidden sibling of ``path``, on the same file system."""
    target = file_system(spark, path).makeQualified(hadoop_path(spark, path))
    return f"{target.getParent()}/.{target.getName()}.{kind}-{uuid.uuid4().hex}"


def csv_to_parquet(
    spark: SparkSession, input: str, output: str, *, mode: str = "overwrite", data_root: str | None = None,
    header=True, delimiter: str = ",", escape: str = '"', multi_line=True, infer_schema=True, schema=None,
    encoding: str | None = None,
) -> GateResult:
    """Converts CSV to Parquet; every check comes before the first write."""
    started, mode = utc_now(), write_mode(mode)
    options = csv_options(
        spark, header=header, delimiter=delimiter, escape=escape, multi_line=multi_line, infer_schema=infer_schema,
        encoding=encoding,
    )
    require_literal(spark, input)
    if data_root:
        require_inside(spark, data_root, "input", input)
        require_inside(spark, data_root, "output", output)
    require_separate(spark, input, output)

    def metrics(rows: int, skipped: bool) -> dict[str, str]:
        return {"rows": str(rows), "input": input, "output": output, "skipped": str(skipped).lower()}

    there = exists(spark, output)
    if there and mode == "ignore":
        return succeeded("csv-to-parquet", f"Skipped: {output} already exists (mode=ignore)", metrics(0, True), started)
    try:
        if there and mode in ("error", "errorifexists"):
            raise GateError(f"Output already exists: {output}")
        allow_charset(spark, options["encoding"])
        source = require_data_files(read_dataset(spark, "csv", input, options, clean_schema(schema)))
        require_decodable(spark, input, options["encoding"])
        rows = publish(source, output, mode)["rows"]
    except JOB_ERRORS as error:
        return failed("csv-to-parquet", str(error), {}, started)
    return succeeded("csv-to-parquet", f"Wrote {rows} rows to {output}", metrics(rows, False), started)


COMPLETE_RECORD_FORMATS = {"csv", "json"}


def row_count(
    spark: SparkSession, input: str, fmt: str = "parquet", expected_rows=None, *, schema=None,
    encoding: str | None = None, **csv,
) -> GateResult:
    """Counts rows; text records are parsed in full, because a pruned count would skip malformed ones."""
    started, fmt = utc_now(), fmt.strip()
    if not fmt:
        raise GateError("inputFormat must not be blank")
    expected = None if expected_rows is None else int64(expected_rows, "expectedRows")
    kind, options = fmt.lower(), {}
    if kind == "csv":
        options = csv_options(spark, encoding=encoding, **csv)
    try:
        data = require_data_files(read_dataset(spark, fmt, input, options, schema))
        if kind == "csv":
            require_decodable(spark, input, options["encoding"])
        rows = complete_count(data) if kind in COMPLETE_RECORD_FORMATS else data.count()
    except JOB_ERRORS as error:
        return failed("row-count", str(error), {}, started)
    metrics = {"rows": str(rows), "input": input, "inputFormat": fmt}
    if expected is not None and expected != rows:
        return failed("row-count", f"Expected {expected} rows but found {rows}", metrics, started)
    return succeeded("row-count", f"{rows} rows in {input}", metrics, started)


def complete_count(df: DataFrame) -> int:
    """Rows of a table after every column of every record was read."""
    observed, seen = counted(df)
    observed.write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


def convert_and_verify(spark: SparkSession, input: str, output: str, **options) -> GateResult:
    """Converts, then counts the output and compares it with what the conversion reported."""
    converted = csv_to_parquet(spark, input, output, **options)
    if not converted.ok or converted.metrics["skipped"] == "true":
        return converted
    return row_count(spark, output, "parquet", converted.metrics["rows"])


def csv_text(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """One column ``value`` with each row as an RFC 4180 record: quoted only where needed, null as empty."""
    from tidegate.sources.strict_csv import check_delimiter

    check_delimiter(delimiter)
    if not df.columns:
        raise GateError("A CSV row must contain at least one field.")
    special = "[\"\\r\\n" + ("\\" if not delimiter.isalnum() else "") + delimiter + "]|\\A\\x{FEFF}"
    fields = []
    for name in df.columns:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        fields.append(F.when(text.rlike(special), quoted).otherwise(text))
    line = F.concat_ws(delimiter, *fields)
    if len(fields) == 1:
        line = F.when(line == "", '""').otherwise(line)
    return df.select(line.alias("value"))


def write_csv_rfc4180(df: DataFrame, path: str, delimiter: str = ",", *, mode: str = "overwrite") -> dict:
    """Writes LF-ended records without a header that a strict reader takes back field by field."""
    return publish(csv_text(df, delimiter), path, mode, "text")


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Writes the first column as lines, each ended by LF."""
    value = df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("value"))
    value.write.mode("append" if append else "overwrite").text(path, lineSep="\n")


def log_result(spark: SparkSession, result: GateResult, path: str) -> None:
    """Appends a gate's result as one row to a run log."""
    result.to_df(spark).coalesce(1).write.mode("append").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(path)
