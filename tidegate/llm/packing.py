"""Packing of documents into sequences of bounded length by best-two-fit."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import batch_rows, materialize
from .tokens import encoder, slices

CAPACITY, END = 2048, 0
# Pieces packed by one task. Each group leaves about half a sequence unfilled, one part in some thousands.
GROUP = 8192
# Texts sent to Python at once.
TEXTS = 2000
PIECES = "id LONG, piece INT, start LONG, length LONG, ids_crc32 LONG"
PLACED = PIECES + ", sequence_id LONG, `offset` LONG"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: full ones, after a first one that may be shorter."""
    first = n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def pieces(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece of each text's ids with the end id: id, piece, start, length, ids_crc32. A null text is empty."""

    def run(batches):
        tok = encoder(path)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for key, ids in zip(part.column("id").to_pylist(), tok.encode(part.column("text"))):
                    data = ids.tobytes() + last
                    for number, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        rows.append((key, number, start, length, zlib.crc32(data[4 * start:4 * (start + length)])))
                names = ["id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        # The worker is kept for other tasks, and Arrow would keep its largest memory.
        pa.default_memory_pool().release_unused()

    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return plain.mapInArrow(run, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of lengths. Each takes the largest that fits, again and again; then two lengths that together fill the room
    of its smallest more tightly take that one's place. Works on counts per length, so equal lengths cost nothing more."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    left, bins = int(counts.sum()), []
    while left:
        filled, gap = [], capacity
        while True:
            fitting = np.flatnonzero(counts[1:gap + 1])
            if not len(fitting):
                break
            size = int(fitting[-1]) + 1
            take = min(int(counts[size]), gap // size)
            filled += [size] * take
            counts[size] -= take
            gap -= size * take
        if gap:
            smallest = filled[-1]
            room = gap + smallest
            sizes = np.flatnonzero(counts[1:room]) + 1
            if len(sizes):
                partner = np.searchsorted(sizes, room - sizes, "right") - 1
                valid = partner > np.arange(len(sizes))
                valid |= (partner == np.arange(len(sizes))) & (counts[sizes] > 1)
                sums = np.where(valid, sizes + sizes[partner], 0)
                best = int(np.argmax(sums))
                if sums[best] > smallest:
                    pair = [int(sizes[best]), int(sizes[partner[best]])]
                    filled[-1:] = sorted(pair, reverse=True)
                    counts[smallest] += 1
                    np.subtract.at(counts, pair, 1)
        left -= len(filled)
        bins.append(filled)
    return bins


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset for each length, in the order given."""
    bins = best_two_fit(lengths, capacity)
    flat = np.array([size for filled in bins for size in filled], dtype=np.int64)
    number = np.repeat(np.arange(len(bins)), [len(filled) for filled in bins])
    ends = np.cumsum(flat)
    first = np.searchsorted(number, number)
    offset = ends - flat - (ends - flat)[first]
    # Equal lengths are interchangeable: the k-th place of a size goes to the k-th piece of that size.
    places, items = np.argsort(flat, kind="stable"), np.argsort(lengths, kind="stable")
    sequence, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sequence[items], at[items] = number[places], offset[places]
    return sequence, at


def pack(cuts: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, start, length, ids_crc32).

    Full pieces are sequences of their own. The others are dealt evenly over groups of about ``group`` rows by a row
    number, so that repeated ids don't meet; a task packs one group. The pieces must be a stored table, because the row
    numbers follow its layout.
    """
    numbered = cuts.withColumn("row", F.monotonically_increasing_id())
    full = numbered.filter(F.col("length") >= capacity)
    full = full.select(*cuts.columns, (F.col("row") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("row", "ascending")])
        sequence, at = place(table.column("length").to_numpy(), capacity)
        base = table.column("group")[0].as_py() << 32
        return table.drop(["row", "group"]).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(at))

    packed = dealt.groupBy("group").applyInArrow(run, PLACED)
    return packed.unionByName(full)


def packed_documents(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
                     end: int = END, group: int = GROUP) -> DataFrame:
    """A row per piece of every text: its id, piece, start, length, ids_crc32, sequence_id, offset.

    Nulls and empty texts become one piece that holds the end id. Repeated rows are packed each for themselves. An empty
    table gives no rows. Other columns are ignored. The tokenizers file must be at ``path`` on every executor.
    """
    with batch_rows(docs.sparkSession, TEXTS):
        found = materialize(pieces(docs, path, id_column=id_column, text_column=text_column, capacity=capacity, end=end), "pieces")
    return pack(found, capacity=capacity, group=group).withColumnRenamed("id", id_column)
