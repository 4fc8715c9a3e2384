"""Quality, profile and floor gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.text import is_blank
from tidegate.results import GateResult, failed, int64, succeeded, utc_now
from tidegate.scale import keyed_join
from tidegate.sources.checks import file_facts, require_utf8
from tidegate.sources.strict_csv import (
    is_first_record, ragged_message, records, require_rectangular, require_well_formed,
)

def zero() -> Column:
    return F.lit(0).cast("long")



def cell_texts(df: DataFrame) -> list[Column]:
    """Every cell as text; a missing value is the empty text."""
    return [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in df.columns]


def digest_of(fields: Column) -> Column:
    """SHA-256 of an array of texts, each with its length in front, so that only equal rows are equal."""
    framed = F.transform(fields, lambda field: F.concat(F.octet_length(field).cast("string"), F.lit(":"), field))
    return F.unhex(F.sha2(F.array_join(framed, ""), 256))


def row_digest(df: DataFrame, *, nulls: bool = False) -> Column:
    """32 bytes that identify a row by the exact text of its fields, however wide the row is.

    A null counts as the empty text, as in a file; with ``nulls`` it is a value of its own.
    """
    framed = []
    for name, text in zip(df.columns, cell_texts(df)):
        size = F.octet_length(text).cast("string")
        framed += [F.when(F.col(f"`{name}`").isNull(), "-").otherwise(size) if nulls else size, F.lit(":"), text]
    return F.unhex(F.sha2(F.concat(*framed), 256))


def _per_row(df: DataFrame) -> DataFrame:
    """(digest, blanks, blank_row) of each row."""
    blanks = [is_blank(text).cast("long") for text in cell_texts(df)]
    total = sum(blanks[1:], blanks[0])
    return df.select(row_digest(df).alias("digest"), total.alias("blanks"), (total == len(blanks)).cast("long").alias("blank_row"))


def _summary(rows: DataFrame) -> DataFrame:
    """Row, blank and duplicate counts from (digest, blanks, blank_row).

    Copies are combined before the shuffle, and a row travels as its digest, so neither a group of copies nor a long
    text becomes a large group.
    """
    groups = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("blanks").alias("blanks"), F.max("blank_row").alias("blank_row")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), zero()).alias("rows"),
        F.coalesce(F.sum(F.col("n") * F.col("blanks")), zero()).alias("blankCells"),
        F.coalesce(F.sum(F.col("n") * F.col("blank_row")), zero()).alias("blankRows"),
        F.coalesce(F.sum(F.col("n") - 1), zero()).alias("duplicateRows"),
    )


def blank_counts(df: DataFrame) -> DataFrame:
    """One row: blankCells and blankRows."""
    blanks = [is_blank(text).cast("long") for text in cell_texts(df)]
    total = sum(blanks[1:], blanks[0])
    return df.agg(
        F.coalesce(F.sum(total), zero()).alias("blankCells"),
        F.coalesce(F.sum((total == len(blanks)).cast("long")), zero()).alias("blankRows"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    return _summary(_per_row(df)).select("duplicateRows")


def quality_counts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, blankCells, blankRows, duplicateRows."""
    counts = _summary(_per_row(df))
    return counts.select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), "blankCells", "blankRows", "duplicateRows")


def verdict(counts: DataFrame, *, min_rows=1, max_blank_cells=0, max_duplicate_rows=0) -> DataFrame:
    """Adds status and message; all violated thresholds are named, in one order, without any cell value."""
    floor, blanks, copies = (
        int64(min_rows, "minRows"), int64(max_blank_cells, "maxBlankCells"), int64(max_duplicate_rows, "maxDuplicateRows")
    )

    def text(*parts) -> Column:
        return F.concat(*[F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts])

    rows, cells, twice = F.col("rows"), F.col("blankCells"), F.col("duplicateRows")
    problems = F.concat_ws(
        "; ",
        F.when(rows < floor, text("rows=", rows, f" is below minRows={floor}")),
        F.when(cells > blanks, text("blankCells=", cells, f" exceeds maxBlankCells={blanks}")),
        F.when(twice > copies, text("duplicateRows=", twice, f" exceeds maxDuplicateRows={copies}")),
    )
    passed = text("CSV quality passed: ", rows, " rows, ", cells, " blank cells, ", twice, " duplicate rows")
    ok = problems == ""
    return counts.withColumn("status", F.when(ok, "SUCCEEDED").otherwise("FAILED")).withColumn(
        "message", F.when(ok, passed).otherwise(F.concat(F.lit("CSV quality failed: "), problems))
    )


def quality(df: DataFrame, *, min_rows=1, max_blank_cells=0, max_duplicate_rows=0) -> GateResult:
    """The verdict on a table as a gate result; metrics are kept on failure."""
    started = utc_now()
    judged = verdict(
        quality_counts(df), min_rows=min_rows, max_blank_cells=max_blank_cells, max_duplicate_rows=max_duplicate_rows
    )
    return _gate("csv-quality", judged.first().asDict(), started)


def _gate(name: str, row: dict, started) -> GateResult:
    status, message = row.pop("status"), row.pop("message")
    make = succeeded if status == "SUCCEEDED" else failed
    return make(name, message, {key: str(value) for key, value in row.items()}, started)


def _shape(everything: DataFrame) -> DataFrame:
    return everything.agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.min(F.size("fields")), F.lit(0)).alias("columns"),
        F.coalesce(F.max(F.size("fields")), F.lit(0)).alias("widest"),
        F.count_if(F.col("fields").isNull()).alias("malformed"),
    )


def profile(spark: SparkSession, path: str, *, header: bool = True, delimiter: str = ",", expected_rows=None) -> GateResult:
    """Rows, columns, bytes and SHA-256 of one strict CSV file."""
    started = utc_now()
    expected = None if expected_rows is None else int64(expected_rows, "expectedRows")
    require_utf8(spark, path)
    facts = file_facts(spark, path)
    shape = _shape(records(spark, path, delimiter=delimiter)).first()
    if shape["malformed"]:
        require_well_formed(spark, path, delimiter)
    if shape["columns"] != shape["widest"]:
        require_rectangular(spark, path, delimiter, header)
    rows = max(0, shape["records"] - (1 if header else 0))
    metrics = {"rows": str(rows), "columns": str(shape["columns"]), "bytes": str(facts["bytes"]), "sha256": facts["sha256"]}
    if expected is not None and expected != rows:
        return failed("csv-profile", f"Expected {expected} rows but found {rows}", metrics, started)
    return succeeded("csv-profile", f"{rows} rows, {shape['columns']} columns in {path}", metrics, started)


def strict_quality_counts(everything: DataFrame, header: bool = True) -> DataFrame:
    """quality_counts over strict records, plus the widest and the malformed ones, in one pass."""
    blanks = F.size(F.filter("fields", is_blank)).cast("long")
    first = is_first_record() if header else F.lit(False)
    rows = everything.select(
        F.when(~first, F.coalesce(digest_of(F.col("fields")), F.lit(b""))).alias("digest"), blanks.alias("blanks"),
        (blanks == F.size("fields")).cast("long").alias("blank_row"), F.size("fields").alias("width"),
        F.col("fields").isNull().cast("long").alias("malformed"),
    )
    groups = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("blanks").alias("blanks"), F.max("blank_row").alias("blank_row"),
        F.min("width").alias("narrow"), F.max("width").alias("wide"), F.sum("malformed").alias("malformed"),
    )
    data = F.when(F.col("digest").isNotNull(), F.col("n")).otherwise(0)
    return groups.agg(
        F.coalesce(F.sum(data), zero()).alias("rows"),
        F.coalesce(F.min("narrow"), F.lit(0)).alias("columns"),
        F.coalesce(F.sum(data * F.col("blanks")), zero()).alias("blankCells"),
        F.coalesce(F.sum(data * F.col("blank_row")), zero()).alias("blankRows"),
        F.coalesce(F.sum(F.greatest(data - 1, F.lit(0))), zero()).alias("duplicateRows"),
        F.coalesce(F.max("wide"), F.lit(0)).alias("widest"),
        F.coalesce(F.sum("malformed"), zero()).alias("malformed"),
    )


def quality_csv(
    spark: SparkSession, path: str, *, header: bool = True, delimiter: str = ",", min_rows=1, max_blank_cells=0,
    max_duplicate_rows=0,
) -> GateResult:
    """The quality gate on one strict CSV file, with its bytes and SHA-256."""
    started = utc_now()
    limits = {"min_rows": min_rows, "max_blank_cells": max_blank_cells, "max_duplicate_rows": max_duplicate_rows}
    for key, value in zip(("minRows", "maxBlankCells", "maxDuplicateRows"), limits.values()):
        int64(value, key)
    require_utf8(spark, path)
    facts = file_facts(spark, path)
    row = verdict(strict_quality_counts(records(spark, path, delimiter=delimiter), header), **limits).first().asDict()
    if row.pop("malformed"):
        require_well_formed(spark, path, delimiter)
    if row["columns"] != row.pop("widest"):
        require_rectangular(spark, path, delimiter, header)
    return _gate("csv-quality", {**row, **facts}, started)


def floor_gate(measured: DataFrame, floors: DataFrame, key: str, value: str = "executed") -> DataFrame:
    """(key, floor, value, ok, message): each floor against the sum measured for its group; a missing group fails, and so
    does one with a ``problem``, if ``measured`` has that column."""
    problem = F.min("problem") if "problem" in measured.columns else F.lit(None).cast("string")
    sums = measured.groupBy(key).agg(F.sum(value).cast("long").alias(value), problem.alias("__problem"))
    joined = keyed_join(floors.select(key, "floor"), sums, [key], "left")
    ok = F.coalesce(F.col(value) >= F.col("floor"), F.lit(False)) & F.col("__problem").isNull()
    missing = F.concat(F.col(key), F.lit(": no reports"))
    below = F.concat(
        F.col(key), F.lit(" executed "), F.col(value).cast("string"), F.lit(" tests, expected at least "),
        F.col("floor").cast("string"),
    )
    wrong = F.concat(F.col(key), F.lit(": "), F.col("__problem"))
    message = F.when(F.col("__problem").isNotNull(), wrong).when(F.col(value).isNull(), missing).when(~ok, below)
    return joined.withColumn("ok", ok).withColumn("message", message).drop("__problem")


_SUITE = "_tests string, _skipped string, testcase array<struct<skipped string, _name string>>"


def suite_totals(reports: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, executed, skipped, problem) per group of test reports: a `testsuite` or a `testsuites` of them each.

    Both the attribute and the marked cases may report the same skipped tests, so the larger counts. A report that cannot
    be parsed, another root, and counts that are no integers or negative are a problem of their group.
    """
    root = F.regexp_extract(document, r"(?s)\A\s*(?:<\?.*?\?>|<!--.*?-->|\s)*<([A-Za-z]+)", 1)
    parsed = F.when(
        root == "testsuites",
        F.expr(f"from_xml({document}, 'testsuite array<struct<{_xml_fields()}>>').testsuite"),
    ).when(root == "testsuite", F.array(F.expr(f"from_xml({document}, '{_SUITE}')").cast(f"struct<{_xml_fields()}>")))
    broken = F.coalesce(F.expr(f"from_xml({document}, '_corrupt_record string, _name string')._corrupt_record IS NOT NULL"), F.lit(True))
    suites = reports.select(key, root.alias("root"), broken.alias("broken"), F.explode_outer(parsed).alias("suite"))

    def number(name: str) -> Column:
        text = F.coalesce(F.col(f"suite.{name}"), F.lit("0"))
        return F.when(text.rlike(r"\A\s*[+-]?[0-9]+\s*\z"), F.trim(text).try_cast("long"))

    cases = F.size(F.filter(F.coalesce("suite.testcase", F.array().cast("array<struct<skipped:string,_name:string>>")),
                            lambda case: case["skipped"].isNotNull())).cast("long")
    tests, skipped = number("_tests"), F.greatest(number("_skipped"), cases)
    problem = (
        F.when(F.col("broken") | F.col("root").isNull(), "cannot parse")
        .when(~F.col("root").isin("testsuite", "testsuites"), F.concat(F.lit("unexpected root element <"), "root", F.lit(">")))
        .when(tests.isNull(), "non-integer tests").when(number("_skipped").isNull(), "non-integer skipped")
        .when((tests < 0) | (number("_skipped") < 0), "negative count")
    )
    return suites.groupBy(key).agg(
        F.coalesce(F.sum(tests - skipped), zero()).alias("executed"),
        F.coalesce(F.sum(skipped), zero()).alias("skipped"),
        F.min(problem).alias("problem"),
    )


def _xml_fields() -> str:
    return "_tests: string, _skipped: string, testcase: array<struct<skipped: string, _name: string>>"


__all__ = [
    "blank_counts", "cell_texts", "duplicate_rows", "floor_gate", "profile", "quality", "quality_counts", "quality_csv",
    "ragged_message", "row_digest", "suite_totals", "verdict",
]
