"""Columns computed from a text column, added to rows that otherwise pass as they are."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import slices

# Bytes of text whose strings and words exist at once.
SLICE = 2_000_000


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have in any case."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def computed(docs: DataFrame, text_column: str, fields: list[T.StructField], start: Callable[[], Callable[[list[str]], list[pa.Array]]]) -> DataFrame:
    """``docs`` with ``fields`` added. ``start`` is called once in each task and answers a function from texts to arrays.

    A null text comes as an empty one. A task holds the words of SLICE bytes of text at once, or of one row.
    """
    schema = T.StructType([*docs.schema.fields, *fields])
    names = [field.name for field in schema.fields]

    def run(batches):
        make = start()
        for batch in batches:
            place = batch.schema.get_field_index(text_column)
            texts = pa.RecordBatch.from_arrays([pc.fill_null(batch.column(place), "")], names=["text"])
            at = 0
            for part in slices(texts, "text", SLICE):
                arrays = make(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.slice(at, part.num_rows).columns, *arrays], names=names)
                at += part.num_rows

    return docs.mapInArrow(run, schema)
