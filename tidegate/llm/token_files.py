"""Token-id files: a static range asymmetric numeral system over independent blocks with interleaved lanes.

A dataset is a folder. ``frequencies`` is a Parquet table (id, frequency) that all blocks share; frequencies sum to 2**20.
``blocks`` holds files whose names sort as their documents do. A file is a row of blocks, each followed by a line feed:

    magic "TGRB", then little-endian u32: bytes of the block, ids, segments, lanes, steps between checkpoints,
    words, checkpoints, CRC-32 of the ids, CRC-32 of the head so far and of all that follows it
    segments x (i64 id, u8 null id, u8 goes on in the next block, 6 zero bytes, u64 ids)
    checkpoints x (u64 words before, lanes x u64 state)
    words x u32

Id number i of a block belongs to lane i mod lanes. Lanes keep a 64-bit state of at least 2**31 and move 32-bit words;
within a step, words lie in the order of the lanes. Decoding may start at any checkpoint. The first is at step 0.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scale import materialize
from .tokens import encoder, rows_of, slices

END = 0
BITS = 20
LANES, BLOCK, CHECK = 1024, 1 << 19, 256
# Ids in a file. A reader holds one file, a writer one block and the document it is in.
FILE = 1 << 22
HEAD = struct.Struct("<4s9I")
SEGMENT = np.dtype([("id", "<i8"), ("null", "u1"), ("more", "u1"), ("zero", "u1", 6), ("n", "<u8")])
LOW, SHIFT, MASK = np.uint64(1 << 31), np.uint64(BITS), np.uint64((1 << BITS) - 1)
WORD = np.uint64(32)


def shares(counts: np.ndarray) -> np.ndarray:
    """Frequencies for counts: at least 1 for every id that occurs, 2**BITS together, most of the rest by share."""
    counts = counts.astype(np.int64)
    used = counts > 0
    if used.sum() > 1 << BITS:
        raise ValueError("more different ids than the table has room for")
    if not used.any():
        return np.zeros(len(counts), np.uint64)
    room = (1 << BITS) - int(used.sum())
    out = used + (counts.astype(np.float64) * (room / counts.sum())).astype(np.int64)
    out[int(np.argmax(counts))] += (1 << BITS) - int(out.sum())
    return out.astype(np.uint64)


class Table:
    """Frequencies, starts and the id of each slot."""

    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies
        self.start = np.cumsum(self.f, dtype=np.uint64) - self.f
        self.slots = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))


def encode_ids(ids: np.ndarray, table: Table, lanes: int = LANES, check: int = CHECK) -> tuple[bytes, bytes, int, int]:
    """(checkpoints, words, number of checkpoints, number of words) of one block."""
    state = np.full(lanes, LOW, np.uint64)
    f, start = table.f[ids], table.start[ids]
    limit, rest = f << np.uint64(63 - BITS), np.uint64(1 << BITS) - f
    parts, points = [], []
    for step in range(-(-len(ids) // lanes) - 1, -1, -1):
        here = slice(step * lanes, min((step + 1) * lanes, len(ids)))
        x = state[:here.stop - here.start]
        full = np.flatnonzero(x >= limit[here])
        moved = x[full]
        parts.append(moved.astype("<u4"))
        x[full] = moved >> WORD
        # (high << BITS) + x % f + start
        high = x // f[here]
        high *= rest[here]
        x += high
        x += start[here]
        if step % check == 0:
            points.append((step, state.copy()))
    parts.reverse()
    points.reverse()
    sizes = np.cumsum([0, *map(len, parts)])
    marks = b"".join(struct.pack("<Q", sizes[step]) + kept.astype("<u8").tobytes() for step, kept in points)
    return marks, b"".join(part.tobytes() for part in parts), len(points), int(sizes[-1])


def decode_ids(n: int, table: Table, marks: bytes, words: bytes, lanes: int, check: int, point: int = 0) -> np.ndarray:
    """The ids from checkpoint ``point`` on."""
    if not n:
        return np.zeros(0, np.uint32)
    size = 8 + 8 * lanes
    mark = marks[point * size:(point + 1) * size]
    at = struct.unpack_from("<Q", mark)[0]
    state = np.frombuffer(mark, "<u8", offset=8).astype(np.uint64)
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    out = np.empty(n - point * check * lanes, np.uint32)
    for first in range(0, len(out), lanes):
        x = state[:min(lanes, len(out) - first)]
        slot = x & MASK
        ids = table.slots[slot.view(np.int64)]
        out[first:first + len(x)] = ids
        ids = ids.astype(np.intp)
        x >>= SHIFT
        x *= table.f[ids]
        x += slot
        x -= table.start[ids]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << WORD) | stream[at:at + len(low)]
        at += len(low)
    if at != len(stream) or not (state == LOW).all():
        raise ValueError("a block doesn't end where its ids do")
    return out


def pack_block(segments: list[tuple], ids: np.ndarray, table: Table, lanes: int = LANES, check: int = CHECK) -> bytes:
    marks, words, points, count = encode_ids(ids, table, lanes, check)
    heads = np.zeros(len(segments), SEGMENT)
    for row, (key, more, n) in zip(heads, segments):
        row["id"], row["null"], row["more"], row["n"] = key or 0, key is None, more, n
    body = heads.tobytes() + marks + words
    size = HEAD.size + len(body)
    head = HEAD.pack(b"TGRB", size, len(ids), len(segments), lanes, check, count, points, zlib.crc32(ids.astype("<u4").tobytes()), 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


def read_block(data: memoryview, at: int, table: Table) -> tuple[np.ndarray, np.ndarray, int]:
    """(segments, ids, place of the next block); raises ValueError on any damage."""
    if len(data) - at < HEAD.size:
        raise ValueError("a block is cut short")
    magic, size, n, segments, lanes, check, words, points, of_ids, of_all = HEAD.unpack_from(data, at)
    body = bytes(data[at + HEAD.size:at + size])
    whole = magic == b"TGRB" and len(data) > at + size and data[at + size] == 10
    if not whole or zlib.crc32(body, zlib.crc32(data[at:at + HEAD.size - 4])) != of_all:
        raise ValueError("a block is damaged")
    first = segments * SEGMENT.itemsize
    second = first + points * (8 + 8 * lanes)
    ids = decode_ids(n, table, body[first:second], body[second:second + 4 * words], lanes, check)
    if zlib.crc32(ids.astype("<u4").tobytes()) != of_ids:
        raise ValueError("a block's ids are damaged")
    return np.frombuffer(body[:first], SEGMENT), ids, at + size + 1


def blocks(documents: Iterator[tuple], table: Table, block: int = BLOCK) -> Iterator[bytes]:
    """Blocks of consecutive documents (id, ids); a long document goes on from block to block."""
    held, segments, size = [], [], 0
    for key, ids in documents:
        at = 0
        while True:
            take = min(len(ids) - at, block - size)
            held.append(ids[at:at + take])
            at += take
            size += take
            segments.append((key, at < len(ids), take))
            if size == block:
                yield pack_block(segments, np.concatenate(held), table)
                held, segments, size = [], [], 0
            if at >= len(ids):
                break
    if segments:
        yield pack_block(segments, np.concatenate(held), table)


def squeezed(ids: np.ndarray, press) -> bytes:
    """Ids for the way between two steps: 16 bits each where that is enough, then compressed."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return (b"4" if wide else b"2") + press.compress(ids.astype("<u4" if wide else "<u2").tobytes())


def restored(data: bytes, press) -> np.ndarray:
    return np.frombuffer(press.decompress(data[1:]), "<u4" if data[:1] == b"4" else "<u2").astype("<u4")


def encoded(docs: DataFrame, path: str, id_column: str, text_column: str, end: int, vocabulary: int) -> DataFrame:
    """id, n, ids (squeezed, with the end id) and a number of its own of every text; token, n of what a task has counted."""

    def run(batches):
        counts = np.zeros(vocabulary, np.int64)
        tok, press, row = encoder(path), zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 40
        last = np.array([end], dtype="<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.concatenate([found, last]) for found in tok.encode(part.column("text"))]
                counts += np.bincount(np.concatenate(ids), minlength=vocabulary)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"),
                    "n": pa.array(list(map(len, ids)), pa.int64()),
                    "ids": pa.array([squeezed(found, press) for found in ids], pa.binary()),
                    "row": pa.array(np.arange(row, row + len(ids))),
                    "token": pa.nulls(len(ids), pa.int32()),
                })
                row += len(ids)
        used = np.flatnonzero(counts)
        none = [pa.nulls(len(used), kind) for kind in (pa.int64(), pa.binary(), pa.int64())]
        columns = [none[0], pa.array(counts[used]), none[1], none[2], pa.array(used, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "ids", "row", "token"])

    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "id LONG, n LONG, ids BINARY, row LONG, token INT")


def frequencies(found: DataFrame, vocabulary: int) -> np.ndarray:
    """Shared frequencies from the counts of all ids; ``vocabulary`` bounds what reaches the driver."""
    counted = found.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[counted["token"]] = counted["n"]
    return shares(counts)


def write_token_files(docs: DataFrame, path: str, target: str, *, id_column: str = "doc_id", text_column: str = "text", end: int = END,
                      per_file: int = FILE) -> None:
    """Writes the token ids of every text to the new folder ``target``, in ascending order of the id (nulls first).

    A null text is empty and gives the end id alone. Rows with equal ids are ordered by their tokens' hash. An empty
    table gives files without blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = max(encoder(path).tok.get_vocab_size(with_added_tokens=True), end + 1)
    stored = materialize(encoded(docs, path, id_column, text_column, end, vocabulary), "ids")
    f, found = frequencies(stored, vocabulary), stored.filter("token IS NULL")
    used = np.flatnonzero(f)
    spark.createDataFrame([(int(i), int(f[i])) for i in used], "id INT, frequency INT").coalesce(1).write.parquet(f"{target}/frequencies")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches):
        table, press = Table(f), zstandard.ZstdDecompressor()
        documents = ((key, restored(data, press)) for batch in batches for key, data in rows_of(batch, "id", "ids"))
        for data in blocks(documents, table):
            yield pa.RecordBatch.from_pydict({"block": pa.array([data], pa.binary())})

    # The stored number lets equal rows go to different files.
    order = ["id", "tie", "row"]
    dealt = found.withColumn("tie", F.xxhash64("ids")).repartitionByRange(max(1, -(-total // per_file)), *order).sortWithinPartitions(*order)
    dealt.select("id", "ids").mapInArrow(run, "block BINARY").select(F.col("block").cast("string")).write.text(f"{target}/blocks")


def stored_table(spark: SparkSession, source: str) -> Table:
    rows = spark.read.parquet(f"{source}/frequencies").orderBy("id").toPandas()
    f = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.uint64)
    f[rows["id"]] = rows["frequency"]
    return Table(f)


def read_token_files(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; all checksums are checked. Null ids come first."""
    f = stored_table(spark, source).f

    def run(batches):
        table = Table(f)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data, at, before = memoryview(content.as_buffer()), 0, 0
                rows, n, crc = [], 0, 0
                while at < len(data):
                    segments, ids, at = read_block(data, at, table)
                    raw, first = memoryview(ids.astype("<u4").tobytes()), 0
                    for key, null, more, _, size in segments.tolist():
                        crc = zlib.crc32(raw[4 * first:4 * (first + size)], crc)
                        n += size
                        first += size
                        if not more:
                            rows.append((name, None if null else key, before, n, crc))
                            before, n, crc = before + n, 0, 0
                kinds = {"path": pa.string(), "doc_id": pa.int64(), "within": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
                columns = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{source}/blocks").select("path", "content")
    rows = files.mapInArrow(run, "path STRING, doc_id LONG, within LONG, n_tokens LONG, ids_crc32 LONG")
    rows = materialize(rows, "decoded")
    sizes = rows.groupBy("path").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("path", F.coalesce(before, F.lit(0)).alias("before"))  # one row per file
    return rows.join(offsets, "path").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
