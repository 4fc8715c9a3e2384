"""Hard negatives: for an anchor and each of its nearest rows of the same label, the nearest rows of other labels whose
score lies in a window below that positive.

Scores are integer inner products, from Strassen's recursive multiplication of tiles of anchors and candidates: tiles are
padded with zeros to even sides, and all sums are those of 64-bit integers. They wrap around alike in every order, so a
product that fits is exact whatever its parts were.

All anchors meet all rows in blocks: anchors are dealt into strips and rows into groups, and one task takes a strip
through a group, tile by tile. It holds the strip and a heap per anchor (or per anchor and positive), so what leaves a
task doesn't depend on how many rows it has seen; the heaps of all groups are merged by rank. The first pass finds the
positives and visits only groups that hold a label of the strip; the second one finds the windows' rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import materialize

# Factor of components; rows above the squared length don't fit (see hard_negatives).
SCALE, LARGEST = 256, float(1 << 56)
# Sides up to which a product is computed directly; anchors and rows of a tile.
LEAF, TILE_ANCHORS, TILE_ROWS = 16, 512, 2048
# Anchors of a strip; rows of a group are a share of all, within bounds; partitions of one shuffle.
STRIP, SHARE, LEAST_ROWS, MOST_ROWS, PARTITIONS = 16384, 32, 1024, 1 << 20, 20_000
HEAP = "anchor LONG, positive LONG, positive_score LONG, other LONG, score LONG"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of int64 matrices by seven products of their quarters."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    if rows % 2 or inner % 2 or columns % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
        b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
        return strassen(a, b, leaf)[:rows, :columns]
    h, i, j = rows // 2, inner // 2, columns // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    low_left = strassen(a21 + a22, b11, leaf)
    right = strassen(a11, b12 - b22, leaf)
    left = strassen(a22, b21 - b11, leaf)
    high_right = strassen(a11 + a12, b22, leaf)
    out = np.empty((rows, columns), np.int64)
    out[:h, :j] = both + left - high_right + strassen(a12 - a22, b21 + b22, leaf)
    out[:h, j:] = right + high_right
    out[h:, :j] = low_left + left
    out[h:, j:] = both - low_left + right + strassen(a21 - a11, b11 + b12, leaf)
    return out


def packed(vector: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes of 2, 4 or 8 each."""
    top = int(np.abs(vector).max()) if len(vector) else 0
    return vector.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64).tobytes()


def matrix(vectors: list[bytes], size: int) -> np.ndarray:
    """Packed vectors of one size as rows of int64."""
    if not size:
        return np.zeros((len(vectors), 0), np.int64)
    kinds = {2 * size: np.int16, 4 * size: np.int32, 8 * size: np.int64}
    if len({len(vector) for vector in vectors}) == 1:
        return np.frombuffer(b"".join(vectors), kinds[len(vectors[0])]).reshape(-1, size).astype(np.int64)
    return np.array([np.frombuffer(vector, kinds[len(vector)]) for vector in vectors]).astype(np.int64)


def whole_vectors(table: DataFrame, id_column: str, vector_column: str, label_column: str | Column, scale: int) -> DataFrame:
    """id, label, size and packed vector of the rows that take part, one row per id."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = []
                for key, label, values in zip(*(part.column(name).to_pylist() for name in ("id", "label", "vector"))):
                    if None in values:
                        continue
                    with np.errstate(over="ignore"):
                        x = np.floor(scale * np.array(values, float))
                        if np.isfinite(x).all() and float(x @ x) < LARGEST:
                            out.append((key, label, len(x), packed(x.astype(np.int64))))
                columns = list(zip(*out)) or [[]] * 4
                types = pa.int64(), pa.int64(), pa.int32(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "label", "size", "vector"])

    label = F.col(f"`{label_column}`") if isinstance(label_column, str) else label_column
    plain = table.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), label.cast("long").alias("label"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("vector"),
    ).filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    rows = plain.mapInArrow(run, "id LONG, label LONG, size INT, vector BINARY")
    first = Window.partitionBy("id").orderBy("label", "size", "vector")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def dealt(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """``rows`` with the number of the part they are in; parts are about equal, and a label lies in as few as it can."""
    spread = rows.repartitionByRange(parts, "size", "label", F.xxhash64("id"), "id")
    return spread.withColumn(name, F.spark_partition_id())


def best(heap: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` of a heap and of new rows, by score and smaller id."""
    scores, ids = np.concatenate([heap[0], scores]), np.concatenate([heap[1], ids])
    if len(scores) > count:
        good = scores >= np.partition(scores, len(scores) - count)[len(scores) - count]
        scores, ids = scores[good], ids[good]
    order = np.lexsort((ids, -scores))[:count]
    return scores[order], ids[order]


EMPTY = np.array([], np.int64), np.array([], np.int64)


class Strip:
    """The anchors of one task, by size, and their heaps."""

    def __init__(self, positives: int, negatives: int, window: tuple[int, int]):
        self.positives, self.negatives, self.window = positives, negatives, window
        self.held: dict[int, list[tuple]] = {}
        self.tiles: dict[int, list] = {}

    def add(self, key: int, label: int, size: int, vector: bytes, wanted: list[tuple[int, int]] | None) -> None:
        self.held.setdefault(size, []).append((key, label, vector, wanted))

    def close(self) -> None:
        """All anchors are there."""
        for size, anchors in self.held.items():
            for first in range(0, len(anchors), TILE_ANCHORS):
                part = anchors[first:first + TILE_ANCHORS]
                heaps = [[EMPTY] * len(wanted) if wanted is not None else [EMPTY] for _, _, _, wanted in part]
                self.tiles.setdefault(size, []).append((part, matrix([vector for _, _, vector, _ in part], size), heaps))
        self.held = {}

    def see(self, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, vectors: list[bytes]) -> None:
        """Brings a tile of rows before all anchors of their size."""
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            if size not in self.tiles:
                continue
            across = matrix([vectors[place] for place in at], size).T
            these, kinds = ids[at], labels[at]
            for anchors, stack, heaps in self.tiles[size]:
                for number, (scores, (key, label, _, wanted)) in enumerate(zip(strassen(stack, across), anchors)):
                    if wanted is None:
                        fits = (kinds == label) & (these != key)
                        if fits.any():
                            heaps[number][0] = best(heaps[number][0], scores[fits], these[fits], self.positives)
                    else:
                        self.windows(scores, these, kinds != label, wanted, heaps[number])

    def windows(self, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, wanted: list[tuple[int, int]], heaps: list) -> None:
        least, most = self.window
        bounds = [(-(-least * score // 100), most * score // 100) for _, score in wanted]
        fits = fits & (scores >= min(low for low, _ in bounds)) & (scores <= max(high for _, high in bounds))
        scores, ids = scores[fits], ids[fits]
        for number, (low, high) in enumerate(bounds):
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                heaps[number] = best(heaps[number], scores[inside], ids[inside], self.negatives)

    def rows(self):
        """The heaps as rows of HEAP."""
        for tiles in self.tiles.values():
            for anchors, _, heaps in tiles:
                for (key, _, _, wanted), many in zip(anchors, heaps):
                    for (positive, at), (scores, ids) in zip(wanted if wanted is not None else [(None, None)], many):
                        for score, other in zip(scores.tolist(), ids.tolist()):
                            yield key, positive, at, other, score


def meet(anchors: DataFrame, rows: DataFrame, tasks: int, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    """The heaps (HEAP) of each task number: ``anchors`` and ``rows`` both have ``task``; anchors have ``wanted``, too."""
    columns = ["task", "kind", "id", "label", "size", "vector", "wanted"]
    both = anchors.withColumn("kind", F.lit(0)).select(columns)
    none = F.lit(None).cast(dict(anchors.dtypes)["wanted"])
    both = both.unionByName(rows.withColumn("kind", F.lit(1)).withColumn("wanted", none).select(columns))
    parts = max(1, min(tasks, PARTITIONS))
    lying = both.repartitionById(parts, F.pmod(F.col("task"), F.lit(parts)).cast("int")).sortWithinPartitions("task", "kind", "id")

    def run(batches):
        strip, now, closed = None, None, False

        def out():
            found = strip.rows() if strip is not None else iter(())
            while some := [row for _, row in zip(range(10_000), found)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], names=[n.split()[0] for n in HEAP.split(", ")])

        for batch in batches:
            marks = batch.column("task").to_numpy() * 2 + batch.column("kind").to_numpy()
            starts = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]]).tolist() if len(marks) else []
            for start, stop in zip(starts, [*starts[1:], len(marks)]):
                task, kind = divmod(int(marks[start]), 2)
                if task != now:
                    yield from out()
                    strip, now, closed = Strip(positives, negatives, window), task, False
                part = batch.slice(start, stop - start)
                if kind == 0:
                    wanted = [w if w is None else [(x["id"], x["score"]) for x in w] for w in part.column("wanted").to_pylist()]
                    for row in zip(*(part.column(name).to_pylist() for name in ("id", "label", "size", "vector")), wanted):
                        strip.add(*row)
                    continue
                if not closed:
                    strip.close()
                    closed = True
                for first in range(0, part.num_rows, TILE_ROWS):
                    tile = part.slice(first, TILE_ROWS)
                    strip.see(*(tile.column(name).to_numpy() for name in ("id", "label", "size")), tile.column("vector").to_pylist())
        yield from out()

    return lying.mapInArrow(run, HEAP)


def hard_negatives(table: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | Column = "label",
                   anchors_every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
                   scale: int = SCALE, strip: int = STRIP, group: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose id is divisible by
    ``anchors_every``.

    Components become floor(scale * x) and scores their integer inner products. An anchor's positives are its first
    ``positives`` other rows of the same label; for each of them come the first ``negatives`` rows of other labels whose
    score is from ``window[0]`` to ``window[1]`` hundredths of the positive's, both included. Higher scores come first,
    then smaller ids.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; neither do rows whose scaled
    vector has a squared length of 2^56 or more, for which products might not fit 64 bits. Rows of different sizes have no
    score. Of rows that share an id, the one with the smallest label, size and vector takes part. An anchor without
    positives, or a positive without negatives, gives no rows; nor does an empty table. Other columns are ignored.
    """
    columns = ["size", "label", "id", "vector"]
    rows = materialize(whole_vectors(table, id_column, vector_column, label_column, scale), "whole-vectors")
    counted = rows.agg(F.count("id"), F.count_if(F.col("id") % anchors_every == 0)).first()
    groups = max(1, -(-counted[0] // (group or min(max(counted[0] // SHARE, LEAST_ROWS), MOST_ROWS))))
    strips = max(1, -(-counted[1] // strip))
    rows = materialize(dealt(rows.select(columns), groups, "part"), "groups")
    anchors = materialize(dealt(rows.filter(F.col("id") % anchors_every == 0).select(columns), strips, "strip"), "strips")
    # Few rows: a part holds few labels, and a label lies in few parts.
    kinds = ["size", "label"]
    pairs = anchors.select("strip", *kinds).distinct().join(rows.select("part", *kinds).distinct(), kinds).select("strip", "part").distinct()
    pairs = materialize(pairs.withColumn("task", F.col("strip").cast("long") * groups + F.col("part")), "pairs")

    nothing = F.lit(None).cast("array<struct<id: bigint, score: bigint>>")
    near = meet(anchors.join(pairs, "strip").withColumn("wanted", nothing), rows.join(pairs, "part"), strips * groups, positives, negatives, window)
    by_score = [F.col("score").desc(), F.col("other")]
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy(*by_score))).filter(F.col("n") <= positives)
    wanted = first.groupBy("anchor").agg(F.collect_list(F.struct(F.col("other").alias("id"), "score")).alias("wanted"))
    ready = materialize(anchors.join(wanted.withColumnRenamed("anchor", "id"), "id").select("strip", *columns, "wanted"), "positives")

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    task = F.col("strip").cast("long") * groups + F.col("part")
    left = ready.withColumn("part", every).withColumn("task", task)
    right = rows.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))).withColumn("task", task)
    found = meet(left, right, strips * groups, positives, negatives, window)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*by_score)))
    return ranked.filter(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
