"""Which releases fall into which advisory ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.maps import release
from tidegate.scale import keyed_join, materialize, spread_join

# Pieces of a span are looked for up to a length of 2 to the power of this.
LEVELS = 48
RANGES = "array<array<struct<introduced:string,fixed:string,last_affected:string>>>"


def in_ranges(current: Column, ranges: Column) -> Column:
    """Whether a release lies in one of the ranges: within each, events apply in release order, later ones override."""

    def step(event: Column, index: Column) -> Column:
        kind = F.when(event["introduced"].isNotNull(), 0).when(event["fixed"].isNotNull(), 1).otherwise(2)
        version = F.coalesce(event["introduced"], event["fixed"], event["last_affected"])
        return F.struct(release(version).alias("at"), index.alias("index"), kind.alias("kind"))

    def applied(state: Column, event: Column) -> Column:
        return (
            F.when((event["kind"] == 0) & (current >= event["at"]), True)
            .when((event["kind"] == 1) & (current >= event["at"]), False)
            .when((event["kind"] == 2) & (current > event["at"]), False)
            .otherwise(state)
        )

    def affected(span: Column) -> Column:
        return F.aggregate(F.array_sort(F.transform(span, step)), F.lit(False), applied)

    return F.coalesce(F.exists(ranges, affected), F.lit(False))


def affected_spans(rules: DataFrame) -> DataFrame:
    """(package, advisory, low, low_open, high, high_open): where the events of each range say affected.

    ``low`` and ``high`` are releases; an open end excludes its release, and a range without an end has no ``high``. Of
    the events at one release the last decides on what follows; on the release itself the last that isn't an end after it.
    """
    package = ["ecosystem", "__name"]
    spans = rules.select("__rule", "advisory", *package, F.posexplode("__ranges").alias("__span", "__events"))
    events = spans.select("__rule", "advisory", *package, "__span", F.posexplode("__events").alias("__index", "__event"))
    version = F.coalesce("__event.introduced", "__event.fixed", "__event.last_affected")
    opens, stays = F.col("__event.introduced").isNotNull(), F.col("__event.fixed").isNull() & F.col("__event.introduced").isNull()
    range_of = ["__rule", "advisory", *package, "__span"]
    at = events.select(*range_of, "__index", release(version).alias("at"), opens.alias("opens"), stays.alias("stays"))
    by_release = at.filter("at IS NOT NULL").groupBy(*range_of, "at").agg(
        F.max_by("opens", "__index").alias("after"),
        F.max_by(F.when(~F.col("stays"), F.col("opens")), F.when(~F.col("stays"), F.col("__index"))).alias("set"),
    )
    order = Window.partitionBy(*range_of).orderBy("at")
    states = by_release.withColumn("on", F.coalesce("set", F.lag("after").over(order), F.lit(False))).withColumn(
        "next", F.lead("at").over(order))
    here = F.struct(F.col("at").alias("low"), F.lit(False).alias("low_open"), F.col("at").alias("high"), F.lit(False).alias("high_open"))
    then = F.struct(F.col("at").alias("low"), F.lit(True).alias("low_open"), F.col("next").alias("high"), F.lit(True).alias("high_open"))
    parts = F.filter(F.array(F.when(F.col("on"), here), F.when(F.col("after"), then)), lambda part: part.isNotNull())
    return states.select("advisory", *package, F.inline(parts))


def release_axis(points: DataFrame) -> DataFrame:
    """Distinct points (ecosystem, __name, at) with their ``place`` in order, 0, 2, 4 and so on.

    Points are sorted by range over all tasks; each task's numbers start after those of the tasks before.
    """
    columns = ["ecosystem", "__name", "at"]
    dealt = points.distinct().repartitionByRange(*columns).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "axis")
    # One row per task.
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__size")).select("__part", F.coalesce(before, F.lit(0)).alias("__offset"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*columns)) - 1
    numbered = dealt.withColumn("__number", number).join(offsets, "__part")
    return materialize(numbered.select(*columns, (2 * (F.col("__number") + F.col("__offset"))).alias("place")), "axis")


def dyadic(low: Column, high: Column) -> Column:
    """The fewest aligned pieces (level, number) of lengths 2^level that make up the places low to high."""

    def at_level(level: Column) -> Column:
        first = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        end = F.call_function("shiftright", high + 1, level)
        piece = lambda number: F.struct(level.alias("level"), number.alias("number"))
        return F.array(F.when((first < end) & (first % 2 == 1), piece(first)), F.when((first < end) & (end % 2 == 1), piece(end - 1)))

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at_level))
    return F.filter(pieces, lambda piece: piece.isNotNull())


def span_hits(releases: DataFrame, spans: DataFrame) -> DataFrame:
    """(ecosystem, __name, at, advisory): the releases that lie in a span of their package, some of them more than once.

    All releases and ends get places on one ordered axis. A span is cut into aligned pieces, at most two of each length; a
    release looks up the one piece of each length that holds it, up to the longest of its package. So pairs are hits.
    """
    package = ["ecosystem", "__name"]
    ends = spans.select(*package, F.explode(F.array("low", "high")).alias("at")).filter("at IS NOT NULL")
    axis = release_axis(releases.select(*package, "at").unionByName(ends))
    reach = axis.groupBy(*package).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    placed = keyed_join(spans, reach, package)
    for end in ("low", "high"):
        places = axis.select(*package, F.col("at").alias(end), F.col("place").alias(f"{end}_place"))
        placed = keyed_join(placed, places, [*package, end], "left")
    low = F.col("low_place") + F.col("low_open").cast("long")
    high = F.coalesce(F.col("high_place") - F.col("high_open").cast("long"), F.col("last"))
    cut = placed.withColumn("a", low).withColumn("b", high).filter("a <= b").select(
        *package, "advisory", F.inline(dyadic(F.col("a"), F.col("b"))))
    longest = reach.select(*package, F.floor(F.log2(F.col("last") - F.col("first") + 1)).cast("int").alias("longest"))
    looked = keyed_join(axis, longest, package).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("longest")))).withColumn(
        "number", F.call_function("shiftright", F.col("place"), F.col("level")))
    return spread_join(looked, cut.drop(*package), ["level", "number"]).select(*package, "at", "advisory")


def match_ranges(items: DataFrame, advisories: DataFrame) -> DataFrame:
    """(item columns..., advisory), once for every item (ecosystem, name, version) and advisory that affects it.

    ``advisories`` has (id, ecosystem, name, versions array<string>, ranges). An advisory may have several rows for a package.
    Ranges meet the distinct releases of their package by ``span_hits``, so that neither many releases nor many or endless
    ranges of one package make more pairs than there are hits; listed versions are joined by their text.
    """
    package = ["ecosystem", "__name"]
    rules = advisories.select(
        F.col("id").alias("advisory"), "ecosystem", F.lower("name").alias("__name"),
        F.transform(F.coalesce("versions", F.array().cast("array<string>")), lambda v: F.regexp_replace(v, r"\Av+", ""))
        .alias("__listed"),
        F.coalesce("ranges", F.array()).cast(RANGES).alias("__ranges"),
    ).withColumn("__rule", F.xxhash64("advisory", *package, F.to_json("__ranges")))
    probe = items.withColumn("__name", F.lower("name"))
    versions = materialize(probe.select(*package, "version").distinct().withColumn("at", release(F.col("version"))), "versions")
    releases = versions.select(*package, "at").filter("at IS NOT NULL")
    hits = span_hits(releases, affected_spans(rules))
    ranged = spread_join(versions, hits, [*package, "at"]).select(*package, "version", "advisory")
    named = rules.select(*package, F.explode("__listed").alias("version"), "advisory").filter("version IS NOT NULL")
    listed = keyed_join(versions.drop("at"), named, [*package, "version"])
    pairs = ranged.unionByName(listed).distinct()
    return spread_join(probe, pairs, [*package, "version"]).select(*items.columns, "advisory")
