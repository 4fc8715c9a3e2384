"""Text, number and time columns for people: previews, durations, sizes, ages, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.results import GateError

# Unicode white space as Java's Character.isWhitespace sees it; \A and \z because $ would also stop before a line end.
BLANK_PATTERN = r"\A\p{javaWhitespace}*\z"
STRIP_PATTERN = r"\A\p{javaWhitespace}+|\p{javaWhitespace}+\z"
WHOLE_NUMBER = r"\A[+-]?[0-9]+\z"


def is_blank(column: Column) -> Column:
    """Null, empty, or nothing but Unicode white space."""
    text = F.coalesce(column, F.lit(""))
    # A visible ASCII character in front settles it without the pattern.
    return F.when(F.ascii(text).between(33, 127), False).otherwise(text.rlike(BLANK_PATTERN))


def strip(column: Column) -> Column:
    return F.regexp_replace(column, STRIP_PATTERN, "")


def preview(column: Column, limit: int) -> Column:
    """One line of at most ``limit`` code points, an ellipsis in place of what was cut."""
    if limit < 1:
        raise GateError("limit must be positive")
    text = strip(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " "))
    cut = F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    return F.when(F.char_length(text) <= limit, text).otherwise(cut)


def short_name(column: Column) -> Column:
    """A file name without its folders, for either separator."""
    return F.element_at(F.split(column, r"[/\\]"), -1)


def log_line(timestamp: Column, level: Column, event: Column) -> Column:
    """``time  LEVEL  event``; missing or empty parts are left out."""

    def part(column: Column) -> Column:
        present = F.coalesce(column, F.lit("")) != ""
        return F.when(present, F.concat(column, F.lit("  "))).otherwise("")

    return F.concat(part(timestamp), part(F.upper(level)), F.coalesce(event, F.lit("")))


def elapsed_millis(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp")))


def human_duration(millis: Column) -> Column:
    """0.4 s, 48 s, 3 min 05 s, 2 h 07 min, 1.5 d."""
    ms = F.greatest(F.lit(0).cast("long"), millis.cast("long"))
    seconds = F.floor(ms / 1000)
    days = seconds / 86400.0
    minutes_left = F.floor((seconds % 3600) / 60)
    return (
        F.when(millis.isNull(), None)
        .when(seconds < 10, F.format_string("%.1f s", ms / F.lit(1000.0)))
        .when(seconds < 60, F.format_string("%d s", seconds))
        .when(seconds < 3600, F.format_string("%d min %02d s", F.floor(seconds / 60), seconds % 60))
        .when(seconds < 86400, F.format_string("%d h %02d min", F.floor(seconds / 3600), minutes_left))
        .when(days < 1_000_000, F.format_string("%.1f d", days))
        .otherwise(F.format_string("%.2e d", days))
    )


# Units of a byte count, each 1024 times the one before.
BYTE_UNITS = ["KB", "MB", "GB", "TB", "PB", "EB"]


def human_bytes(count: Column) -> Column:
    """512 B, 1.5 KB, 12 MB: binary multiples, one decimal below ten."""
    number = count.cast("long")
    text = F.when(number.isNull(), None).when(number < 1024, F.format_string("%d B", number))
    for power, unit in enumerate(BYTE_UNITS, start=1):
        value = number.cast("double") / float(1024**power)
        here = F.when(value < 10, F.format_string(f"%.1f {unit}", value)).otherwise(F.format_string(f"%.0f {unit}", value))
        text = text.otherwise(here) if unit == BYTE_UNITS[-1] else text.when(value < 1024, here)
    return text


def thousands(number: Column) -> Column:
    return F.format_string("%,d", number.cast("long"))


def metric_text(key: Column, value: Column) -> Column:
    """A metric value with the unit its key calls for; a value that is no whole number stays as it is."""
    number = F.when(value.rlike(WHOLE_NUMBER), value.try_cast("long"))
    text = (
        F.when(key == "durationMillis", human_duration(number))
        .when(key.isin("bytes", "maxBytes"), human_bytes(number))
        .when(key.isin("rows", "columns", "expectedRows"), F.when(number.isNotNull(), thousands(number)))
    )
    return F.coalesce(text, value)


# The texts of the age buckets.
AGO_NOW, AGO_SECONDS, AGO_MINUTES, AGO_HOURS, AGO_DAYS = "刚刚", " 秒前", " 分钟前", " 小时前", " 天前"


def ago(then: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit."""
    seconds = F.floor(elapsed_millis(then, now) / 1000)

    def whole(unit: int, text: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(text))

    return (
        F.when(seconds.isNull(), None)
        .when(seconds < 5, AGO_NOW)
        .when(seconds < 60, whole(1, AGO_SECONDS))
        .when(seconds < 3600, whole(60, AGO_MINUTES))
        .when(seconds < 86400, whole(3600, AGO_HOURS))
        .otherwise(whole(86400, AGO_DAYS))
    )


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)
