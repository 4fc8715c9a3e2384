"""Near-duplicate vectors by collision counting over one-dimensional projections.

Two unit vectors at a cosine c differ by a normal number of variance 2 - 2c on every random projection. A pair is a
candidate if it lies in a common cell, and each falls into the window around the other on enough projections; the number
that is enough follows from the wanted recall. Candidates are verified by their cosine in double precision.

Window collisions alone leave a constant share of all pairs on each projection, so counting starts within cells: signs
of some projections, in several tables. The number of signs grows with the logarithm of the table, so that a cell keeps
its size, and the number of tables follows from the recall.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import materialize
from .components import components
from .groups import by_group

COSINE = 0.9
# Wanted recall at the threshold itself of the tables and of the count; closer pairs have more.
TABLE_RECALL, COUNT_RECALL = 0.98, 0.997
# Projections counted, and half the window in standard deviations of a pair at the threshold.
PROJECTIONS, REACH = 32, 1.5
# Half the window on the projection by which a cell is sorted.
SORTED_REACH = 4.0
# Vectors in a cell if all were random, and in a block of a cell that holds more.
CELL, BLOCK = 32, 2048
STRIP = 256
GROUP = ["size", "table", "key", "low", "high"]
ROWS = "id LONG, size INT, digest BINARY, vector BINARY"


def projections(size: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, count))


def shape(rows: int, cosine: float) -> tuple[int, int]:
    """(signs of a cell, tables) for so many vectors."""
    signs = min(30, max(1, int(math.log2(max(rows, 2) / CELL))) if rows > 2 * CELL else 1)
    together = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - together)))


def enough(count: int = PROJECTIONS, reach: float = REACH, recall: float = COUNT_RECALL) -> int:
    """The most collisions that a pair at the threshold reaches with the wanted probability."""
    p = math.erf(reach / math.sqrt(2))
    below, k = 0.0, 0
    while below + (term := math.comb(count, k) * p**k * (1 - p) ** (count - k)) <= 1 - recall:
        below += term
        k += 1
    return k


def read_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, size, digest and unit vector (float64 bytes) of each row; a size of 0 where there is no direction."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, digests, vectors = [], [], []
                for values in part.column("vector").to_pylist():
                    x = np.array([], float) if values is None or None in values else np.array(values, float)
                    top = np.abs(x).max() if len(x) else 0.0
                    if not np.isfinite(top) or top == 0:
                        sizes.append(0), digests.append(None), vectors.append(None)
                        continue
                    x = x / top + 0.0
                    x /= math.sqrt(float(x @ x))
                    sizes.append(len(x)), vectors.append(x.tobytes())
                    digests.append(hashlib.sha256(vectors[-1]).digest())
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"), "size": pa.array(sizes, pa.int32()),
                    "digest": pa.array(digests, pa.binary()), "vector": pa.array(vectors, pa.binary()),
                })

    plain = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return plain.mapInArrow(run, ROWS)


def cell_keys(nodes: DataFrame, signs: int, tables: int) -> DataFrame:
    """Adds the cells of a vector: an integer of ``signs`` bits for each table."""

    def run(batches):
        made: dict[int, np.ndarray] = {}
        powers = (1 << np.arange(signs)).astype(np.int64)
        for batch in batches:
            keys = []
            for size, data in zip(batch.column("size").to_pylist(), batch.column("vector").to_pylist()):
                if size not in made:
                    made[size] = projections(size, signs * tables, 1)
                positive = (np.frombuffer(data) @ made[size] > 0).reshape(tables, signs)
                keys.append((positive @ powers).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int32()))], names=[*batch.schema.names, "keys"])

    return nodes.mapInArrow(run, "id LONG, size INT, weight LONG, vector BINARY, keys ARRAY<INT>")


def candidates(left: np.ndarray, right: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that collide on at least ``least`` columns. ``right`` is sorted by its first column."""
    a, b = [], []
    for first in range(0, len(left), STRIP):
        strip = left[first:first + STRIP]
        reach = width / REACH * SORTED_REACH
        low, high = np.searchsorted(right[:, 0], [strip[:, 0].min() - reach, strip[:, 0].max() + reach])
        near = right[low:high]
        count = np.zeros((len(strip), len(near)), np.int8)
        for column in range(left.shape[1]):
            count += np.abs(strip[:, column, None] - near[None, :, column]) <= width
        x, y = np.nonzero(count >= least)
        a.append(x + first)
        b.append(y + low)
    return np.concatenate(a), np.concatenate(b)


def local_roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id that each place reaches by the links (a, b)."""
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        if (root == before).all():
            return root


def cell_links(ids, weights, vectors, keys, blocks, low: int, high: int, table: int, cosine: float, least: int):
    """(ids, links, roots) of what one block pair of a cell adds: pairs that no earlier table has together."""
    projected = vectors @ projections(vectors.shape[1], PROJECTIONS, 2)
    width = REACH * math.sqrt(2 - 2 * cosine)
    order = np.argsort(projected[:, 0], kind="stable")
    one, other = order[blocks[order] == low], order[blocks[order] == high]
    if not len(one) or not len(other):
        return ids[:0], weights[:0], ids[:0]
    a, b = candidates(projected[one].astype(np.float32), projected[other].astype(np.float32), width * 1.0001, least)
    a, b = one[a], other[b]
    if low == high:
        a, b = a[a < b], b[a < b]
    fresh = np.ones(len(a), bool)
    for earlier in range(table):
        fresh &= keys[a, earlier] != keys[b, earlier]
    a, b = a[fresh], b[fresh]
    good = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= cosine
    a, b = a[good], b[good]
    links = np.bincount(a, weights[b], len(ids)) + np.bincount(b, weights[a], len(ids))
    used = np.flatnonzero(links)
    return ids[used], links[used].astype(np.int64), local_roots(ids, a, b)[used]


def count_cells(dealt: DataFrame, tables: int, cosine: float) -> DataFrame:
    """id, links and root of every vector per block pair of a cell; rows of a block pair lie together."""
    least = enough()

    def answer(table: pa.Table):
        size, number, low, high = (table.column(name)[0].as_py() for name in ("size", "table", "low", "high"))
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist())).reshape(-1, size)
        keys = np.array(table.column("keys").to_pylist(), np.int32).reshape(-1, tables)
        found = cell_links(*(table.column(n).to_numpy() for n in ("id", "weight")), vectors, keys, table.column("block").to_numpy(),
                           low, high, number, cosine, least)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["id", "links", "root"])

    return dealt.mapInArrow(by_group(answer, GROUP), "id LONG, links LONG, root LONG")


def near_vectors(table: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE,
                 block: int = BLOCK) -> DataFrame:
    """Per row: its id, n_links (other rows at a cosine of ``cosine`` or more), component_id, kept (the id is its component's).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
    different lengths with each other. Rows with a null id stay, unlinked, with a null component_id and kept true.
    Rows that share an id add up their links. An empty table gives no rows; other columns are ignored.

    Equal directions are one node with a weight. A cell of more than ``block`` nodes is dealt over pairs of blocks, so a
    task holds at most two blocks of it, and links are summed where they are found: pairs never become rows.
    """
    rows = materialize(read_vectors(table, id_column, vector_column), "vectors")
    usable = rows.filter("size > 0 AND id IS NOT NULL")
    classes = materialize(usable.groupBy("digest").agg(F.min("id").alias("class"), F.count("id").alias("weight")), "classes")
    own = usable.join(classes, "digest").filter("id = class").dropDuplicates(["digest"])
    signs, tables = shape(classes.count(), cosine)
    nodes = materialize(cell_keys(own.select("id", "size", "weight", "vector"), signs, tables), "nodes")

    cells = nodes.select("*", F.posexplode("keys").alias("table", "key"))
    sizes = cells.groupBy("size", "table", "key").agg(F.count("id").alias("held")).filter("held > 1")
    dealt = cells.join(sizes, ["size", "table", "key"]).withColumn("blocks", F.ceil(F.col("held") / block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "partner")).withColumn("high", F.greatest("block", "partner"))
    sorted_rows = dealt.select(*GROUP, "id", "weight", "vector", "keys", "block").repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = materialize(count_cells(sorted_rows, tables, cosine), "found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classed = rows.select("id", "digest").join(classes, "digest", "left")
    classed = classed.join(links.withColumnRenamed("id", "class"), "class", "left").join(joined.withColumnRenamed("id", "class"), "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "class", "id"))
    others = F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return classed.select(
        F.col("id").alias(id_column), F.when(F.col("id").isNull(), 0).otherwise(others).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
