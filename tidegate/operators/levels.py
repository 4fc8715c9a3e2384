"""Columns and rows of a task graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.scale import materialize, materialize_measured, number_within


def written(ways: DataFrame) -> tuple[DataFrame, dict]:
    """Stored ways, the number of their rows, and of those that aren't final."""
    return materialize_measured(ways, "graph-ways", F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("final")).alias("open"))


def jump(ways: DataFrame, rows: int, open_rows: int) -> DataFrame:
    """Ways (id, head, weight, base, final) to heads that have no way of their own, by doubling.

    A row says: the level of ``id`` is the larger of ``base`` and the level of ``head`` plus ``weight``; without a head it
    is ``base``. In each round a row that isn't final takes over its head's row, so ways of n nodes need log n rounds.
    Rows that aren't final after that lie on a cycle or below one.
    """
    for _ in range(rows.bit_length()):
        if not open_rows:
            break
        heads = ways.select(
            F.col("id").alias("head"), F.col("head").alias("next"), F.col("weight").alias("more"), F.col("base").alias("least"),
            F.col("final").alias("ended"),
        )
        moved = ways.filter(~F.col("final")).join(heads, "head").select(
            "id", F.col("next").alias("head"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"),
            F.greatest("base", F.col("least") + F.col("weight")).alias("base"), F.col("ended").alias("final"),
        )
        ways, seen = written(ways.filter("final").unionByName(moved))
        open_rows = seen["open"]
    return ways


def jumped(ways: DataFrame) -> DataFrame | None:
    """``jump`` of ways that are not marked final yet; None when there are none."""
    own = ways.select(F.col("id").alias("head"), F.lit(True).alias("moves"))
    headed = ways.filter("head IS NOT NULL").join(own, "head", "left").withColumn("final", F.col("moves").isNull()).drop("moves")
    rooted = ways.filter("head IS NULL").withColumn("final", F.lit(True))
    marked, seen = written(rooted.unionByName(headed))
    return jump(marked, seen["rows"], seen["open"]) if seen["rows"] else None


def merged(links: DataFrame) -> DataFrame:
    return materialize(links.groupBy("source", "target").agg(F.max("weight").alias("weight")), "graph-links")


def contracted(links: DataFrame, ways: DataFrame) -> DataFrame:
    """The links to nodes without a way, from nodes without a way: others are replaced by links from their heads.

    A link without a source carries the least level of its target. What a cycle reaches links to itself.
    """
    kept = links.join(ways.select(F.col("id").alias("target")), "target", "left_anti")
    passed = kept.filter("source IS NOT NULL").join(ways.withColumnRenamed("weight", "more"), F.col("source") == F.col("id"), "left")

    def link(source, weight):
        return F.struct(source.alias("source"), F.col("target"), weight.cast("long").alias("weight"))

    least = link(F.lit(None).cast("string"), F.col("base") + F.col("weight"))
    after = (
        F.when(F.col("id").isNull(), F.array(link(F.col("source"), F.col("weight"))))
        .when(~F.col("final"), F.array(link(F.col("target"), F.lit(1))))
        .when(F.col("head").isNull(), F.array(least))
        .otherwise(F.array(least, link(F.col("head"), F.col("more") + F.col("weight"))))
    )
    moved = passed.select(F.inline(after))
    return merged(kept.filter("source IS NULL").select("source", "target", "weight").unionByName(moved))


def graph_levels(nodes: DataFrame, *, node: str = "id", downstream: str = "downstream", position: str = "position") -> DataFrame:
    """(id, level, row): the longest way from a source, and the place within that level by ``position``.

    Each round removes all tasks that wait for at most one other: these form trees, along which ways are doubled, and their
    links go over to the heads of the trees with the lengths added. Chains and trees of any depth take rounds by the
    logarithm of their size; where tasks wait for several others, a round removes at least one level. Every step is
    written to the shared folder. Targets that are no task are ignored; tasks on a cycle or below one stay at level 0.
    """
    tasks = nodes.groupBy(node).agg(F.min_by(F.struct(downstream, position), position).alias("first")).select(
        F.col(node).alias("id"), F.col(f"first.{downstream}").alias("next"), F.col(f"first.{position}").alias("position")
    )
    tasks = materialize(tasks, "graph-tasks")
    edges = tasks.select(F.col("id").alias("source"), F.explode("next").alias("target"), F.lit(1).cast("long").alias("weight"))
    known = tasks.select(F.col("id").alias("target"))
    least = known.select(F.lit(None).cast("string").alias("source"), "target", F.lit(0).cast("long").alias("weight"))
    links = merged(edges.join(known, "target", "left_semi").select("source", "target", "weight").unionByName(least))
    rounds = []
    while True:
        few = links.groupBy(F.col("target").alias("id")).agg(
            F.max("source").alias("head"), F.max(F.when(F.col("source").isNotNull(), F.col("weight"))).alias("weight"),
            F.max(F.when(F.col("source").isNull(), F.col("weight"))).alias("base"), F.count("source").alias("sources"),
        ).filter("sources <= 1").drop("sources")
        ways = jumped(few)
        if ways is None:
            break
        rounds.append(ways.filter("final").drop("final"))
        links = contracted(links, ways)
    levels = known.select(F.col("target").alias("id")).limit(0).withColumn("level", F.lit(0).cast("long"))
    if rounds:
        # A head left over has no level: it is on a cycle or below one.
        levels = jumped(reduce(DataFrame.unionByName, rounds)).filter("final AND head IS NULL").select(
            "id", F.col("base").alias("level"))
    placed = tasks.join(levels, "id", "left").select("id", "position", F.coalesce("level", F.lit(0)).cast("int").alias("level"))
    return number_within(placed, ["level"], "position", "row").select("id", "level", "row")
