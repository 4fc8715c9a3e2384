"""Connected components of links: forests within tasks, then large and small stars between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import materialize

# Links for a task, and those that it holds at once at most (more only if they are of one node).
TASK, HELD = 100_000, 400_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links that isn't the smallest one it reaches, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while (label[one] != label[other]).any():
        low, high = np.minimum(label[one], label[other]), np.maximum(label[one], label[other])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def _forests(edges: DataFrame) -> DataFrame:
    """Links each node of a task to the smallest one that it reaches by the links held at once. Rows of one ``a`` that lie
    together are held together."""

    def answer(ends: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(*ends)], names=["a", "b"])

    def run(batches):
        ends = np.zeros((2, 0), np.int64)
        for batch in batches:
            ends = np.concatenate([ends, np.stack([batch.column(name).to_numpy() for name in ("a", "b")])], axis=1)
            before = np.flatnonzero(ends[0] != ends[0, -1]) if ends.shape[1] >= HELD else ()
            if len(before):
                yield answer(ends[:, :before[-1] + 1])
                ends = ends[:, before[-1] + 1:]
        if ends.shape[1]:
            yield answer(ends)

    return edges.mapInArrow(run, "a LONG, b LONG")


def _stars(edges: DataFrame) -> DataFrame:
    """Links each node to the smallest neighbour of its smaller neighbours, then those that a node is linked to with each
    other. Edges lead from the larger to the smaller end; a node has no more of them than there were tasks before."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
    large = edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    return _forests(large.repartition("a").sortWithinPartitions("a"))


def _labels(edges: DataFrame) -> DataFrame:
    """(id, component, open): open if a node has edges to several nodes, or one and is itself the end of another."""
    down = edges.select(F.col("a").alias("id"), "b", F.lit(False).alias("end"))
    ends = edges.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("b"), F.lit(True).alias("end"))
    nodes = down.unionByName(ends).groupBy("id").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("end").alias("end"))
    several = F.col("low").isNotNull() & (F.col("end") | (F.col("low") < F.col("high")))
    return nodes.select("id", F.coalesce("low", "id").alias("component"), several.alias("open"))


def _joined(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Fewer links that connect the same nodes, and whether one task has held them all, so that they are stars.

    As many tasks as the links fill join what their own links connect, again as long as that halves the links.
    """
    n = edges.count()
    while True:
        tasks = max(1, -(-n // TASK))
        edges = materialize(_forests(edges.coalesce(tasks)), "forests")
        before, n = n, edges.count()
        if tasks == 1 or 2 * n > before:
            return edges, tasks == 1 and before <= HELD


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every node of the links (a, b) the smallest node that it reaches.

    First tasks join what their own links connect, without a shuffle. Where that leaves more than a task's links, large and
    small stars alternate: each round makes the sum of all ends smaller until every node has one edge, to a node without
    an edge of its own, and rounds grow with the logarithm of a component's size. A hub's links are combined before they
    are shuffled (minima) or split by adaptive execution (joins); each round is written to the shared folder. No links,
    no rows.
    """
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges, done = _joined(materialize(down, "links"))
    while not done and _labels(edges).agg(F.max("open")).first()[0]:
        edges = materialize(_stars(edges), "stars")
    return _labels(edges).select("id", "component")
