"""The column functions under names that SQL can call; each is a native expression, no Python runs per row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidegate.functions.states import TONES
from tidegate.functions.text import BLANK_PATTERN, BYTE_UNITS, STRIP_PATTERN
from tidegate.sources.strict_csv import checked_records


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Creates is_blank, run_tone, human_duration, human_bytes and preview as temporary functions."""
    strip = f"regexp_replace(%s, {_literal(STRIP_PATTERN)}, '')"
    tones = " ".join(
        f"WHEN lower({strip % 's'}) IN ({', '.join(map(_literal, states))}) THEN '{tone}'" for tone, states in TONES.items()
    )
    sizes = " ".join(
        f"WHEN n < {1024 ** (power + 1)}D THEN format_string(IF(n / {1024 ** power}D < 10, '%.1f {unit}', '%.0f {unit}'), n / {1024 ** power}D)"
        for power, unit in enumerate(BYTE_UNITS, start=1)
    )
    line = strip % r"regexp_replace(coalesce(s, ''), '\\s+', ' ')"
    definitions = {
        "is_blank": f"(s STRING) RETURNS BOOLEAN RETURN coalesce(s, '') RLIKE {_literal(BLANK_PATTERN)}",
        "run_tone": f"(s STRING) RETURNS STRING RETURN CASE {tones} ELSE 'NONE' END",
        "human_duration": """(ms BIGINT) RETURNS STRING RETURN CASE
            WHEN ms IS NULL THEN NULL
            WHEN ms < 10000 THEN format_string('%.1f s', greatest(ms, 0) / 1000.0D)
            WHEN ms < 60000 THEN format_string('%d s', ms div 1000)
            WHEN ms < 3600000 THEN format_string('%d min %02d s', ms div 60000, ms div 1000 % 60)
            WHEN ms < 86400000 THEN format_string('%d h %02d min', ms div 3600000, ms div 60000 % 60)
            ELSE format_string(IF(ms div 1000 / 86400.0D < 1000000, '%.1f d', '%.2e d'), ms div 1000 / 86400.0D) END""",
        "human_bytes": f"(n BIGINT) RETURNS STRING RETURN CASE WHEN n < 1024 THEN format_string('%d B', n) {sizes} END",
        "preview": f"""(s STRING, n INT) RETURNS STRING RETURN
            IF(char_length({line}) <= n, {line}, concat(substring({line}, 1, n - 1), '…'))""",
    }
    for name, definition in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
    return list(definitions)


def register_strict_csv(spark: SparkSession, sources: dict[str, str], *, delimiter: str = ",") -> None:
    """Creates the table function strict_csv(source): (file, record_no, fields) of the strict CSV files of a named path.

    The files of each path are summed up once, here; a query then cuts their records. A quoting error is raised by the
    query that reads them, and so is a name that isn't among ``sources``.
    """
    parts = []
    for number, (name, path) in enumerate(sources.items()):
        view = f"strict_csv_source_{number}"
        checked_records(spark, path, delimiter=delimiter).createOrReplaceTempView(view)
        parts.append(f"SELECT file, record_no, fields FROM {view} WHERE source = {_literal(name)}")
    known = ", ".join(map(_literal, sources)) or "NULL"
    unknown = "CAST(raise_error(concat('no strict CSV source ', source)) AS STRING)"
    parts.append(f"SELECT {unknown}, CAST(NULL AS BIGINT), CAST(NULL AS ARRAY<STRING>) WHERE source IS NULL OR source NOT IN ({known})")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION strict_csv(source STRING)
        RETURNS TABLE(file STRING, record_no BIGINT, fields ARRAY<STRING>) RETURN {" UNION ALL ".join(parts)}""")
