"""Parameter and metric maps, and release numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.text import WHOLE_NUMBER, is_blank, strip

TEXT_MAP = "map<string,string>"


def parse_map(column: Column) -> Column:
    """A JSON object as a text map; anything else is an empty map."""
    return F.coalesce(F.from_json(column, TEXT_MAP), F.create_map().cast(TEXT_MAP))


def print_map(column: Column) -> Column:
    return F.to_json(column)


def clean_params(column: Column) -> Column:
    """Entries with a blank key or value go, keys are stripped, the last of equal keys wins."""
    entries = F.transform(
        F.filter(F.map_entries(column), lambda e: ~is_blank(e["key"]) & ~is_blank(e["value"])),
        lambda e: F.struct(strip(e["key"]).alias("key"), e["value"].alias("value")),
    )
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(
        entries,
        lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.lit(0), F.size(keys) - i - 1)), e["key"]),
    )
    return F.map_from_entries(last)


def duration_metric(metrics: Column) -> Column:
    """The durationMillis entry of a metrics map; 0 when missing or malformed."""
    text = F.try_element_at(metrics, F.lit("durationMillis"))
    return F.coalesce(F.when(text.rlike(WHOLE_NUMBER), text.try_cast("long")), F.lit(0).cast("long"))


def release(version: Column) -> Column:
    """A release number as an array of numbers: v4.1.3 is [4, 1, 3]; what follows - or + does not count."""
    head = F.split(F.split(version, "-")[0], r"\+")[0]
    return F.transform(F.regexp_extract_all(head, F.lit(r"(\d+)"), 1), lambda part: part.cast("decimal(38,0)"))
