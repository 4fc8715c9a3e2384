"""Near-duplicate documents by b-bit MinHash.

Of each document's minima, whole bands make bucket keys and the low bits are packed into a short signature. Documents that
share a bucket are candidates; their similarity is estimated by counting equal bits, corrected for chance, and what may
reach the threshold is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import SALTS, materialize
from .components import components
from .groups import by_group
from .tokens import rows_of, stretches

WIDTH, PERCENT = 5, 80
# 32 bands of 5 minima: a pair at a similarity of 0.8 shares none with a chance of 3 in a million.
BANDS, ROWS, BITS = 32, 5, 2
MINIMA = BANDS * ROWS
PER_LONG = 64 // BITS
LONGS = MINIMA // PER_LONG
# Chance that the estimate loses a pair that just reaches the threshold.
LOST = 1e-5
# Partners that a document tries in a round, rounds, and documents of a bucket that are compared by one task.
TRIES, ROUNDS, BLOCK = 3, 2, 2048
# Rows of buckets for a task.
TASK = 16_384
# Buckets and components above FEW documents are compared in blocks of documents with their texts.
FEW, TEXTS = 64, 1024
KEPT_WORDS = 250_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(20_240).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = [f"s{i}" for i in range(LONGS)]
SKETCH = "id LONG, digest BINARY, n LONG, " + ", ".join(f"{s} LONG" for s in SIGNATURE) + ", bands ARRAY<LONG>"


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space (x20, x09 to x0D), A-Z in lower case."""
    return (text or "").encode().lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words, or of all words if there are fewer."""
    size = min(width, len(hashes))
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for at in range(size):
        total = total * _PRIME + hashes[at:at + len(total)]
    return np.unique(mix(total + np.uint64(size)))


def shingle_set(words: list[bytes], width: int) -> set[tuple]:
    size = min(width, len(words))
    return set(zip(*(words[at:] for at in range(size)))) if words else set()


def similar(one: set, other: set, percent: int) -> bool:
    common = len(one & other)
    return bool(common) and 100 * common >= percent * (len(one) + len(other) - common)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A column of minima for each non-empty set of hashes."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * factor, starts) for factor in FACTORS])


def band_keys(least: np.ndarray) -> np.ndarray:
    grouped = least.reshape(BANDS, ROWS, -1)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.ones((1, least.shape[1]), np.uint64)
    for row in range(ROWS):
        total = mix(total * _PRIME + grouped[:, row])
    return total.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of each minimum (of its lower half, as the upper one is mostly zeros), 32 to a long."""
    bits = ((least >> np.uint64(16)) & np.uint64((1 << BITS) - 1)).reshape(LONGS, PER_LONG, -1)
    places = (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    return np.bitwise_or.reduce(bits << places, axis=1).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """id, digest of the words, number of shingles, packed signature and band keys; null digest without words."""

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            for part in stretches(rows_of(batch, "id", "text"), 1):
                words = [words_of(text) for _, text in part]
                full = [i for i, found in enumerate(words) if found]
                sets = [shingle_hashes(np.fromiter(map(memo.__getitem__, words[i]), np.uint64, len(words[i])), width) for i in full]
                columns = {"id": pa.array([key for key, _ in part], pa.int64())}
                sizes, digests = [0] * len(part), [None] * len(part)
                for i, found in zip(full, sets):
                    sizes[i], digests[i] = len(found), hashlib.sha256(b" ".join(words[i])).digest()
                columns |= {"digest": pa.array(digests, pa.binary()), "n": pa.array(sizes, pa.int64())}
                least = minima(sets) if sets else np.zeros((MINIMA, 0), np.uint64)
                signature = np.zeros((LONGS, len(part)), np.int64)
                signature[:, full] = packed(least)
                columns |= dict(zip(SIGNATURE, map(pa.array, signature)))
                keys: list = [None] * len(part)
                for i, row in zip(full, band_keys(least).T):
                    keys[i] = row
                columns["bands"] = pa.array(keys, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, SKETCH)


def worded(docs: DataFrame) -> DataFrame:
    """id, digest and words of the texts that have any, with a space between words: equal digests have equal texts."""

    def run(batches):
        for batch in batches:
            for part in stretches(rows_of(batch, "id", "text"), 1):
                full = [(key, b" ".join(words)) for key, text in part if (words := words_of(text))]
                columns = [[key for key, _ in full], [hashlib.sha256(text).digest() for _, text in full], [text.decode() for _, text in full]]
                kinds = [pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "digest", "text"])

    return docs.mapInArrow(run, "id LONG, digest BINARY, text STRING")


def least_matches(percent: int, minima_count: int = MINIMA, bits: int = BITS, lost: float = LOST) -> int:
    """The number of equal b-bit minima below which a pair at the threshold falls with a chance of at most ``lost``."""
    p, chance = percent / 100, 0.5 ** bits
    equal = p + (1 - p) * chance
    term, total, k = (1 - equal) ** minima_count, 0.0, 0
    while total + term <= lost:
        total += term
        term *= (minima_count - k) / (k + 1) * equal / (1 - equal)
        k += 1
    return k


def estimate(matches: Column, minima_count: int = MINIMA, bits: int = BITS) -> Column:
    """Similarity from the number of equal b-bit minima, without those that are equal by chance."""
    chance = 0.5 ** bits
    return (matches / minima_count - chance) / (1 - chance)


def equal_minima(left: str, right: str) -> Column:
    """How many packed minima of two aliased sketches are equal, by counting bits."""
    low = F.lit(0x5555555555555555)
    differing = []
    for name in SIGNATURE:
        other = F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}"))
        differing.append(F.bit_count(other.bitwiseOR(F.shiftrightunsigned(other, 1)).bitwiseAND(low)))
    return F.lit(MINIMA) - reduce(lambda a, b: a + b, differing)


def hopeful(left: str, right: str, percent: int) -> Column:
    """Whether two aliased sketches may reach the threshold, by their sizes and the estimate from their bits."""
    sizes = [F.col(f"{left}.n"), F.col(f"{right}.n")]
    bits = estimate(equal_minima(left, right)) >= estimate(F.lit(least_matches(percent)))
    return (F.least(*sizes) * 100 >= F.greatest(*sizes) * percent) & bits


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach the threshold. Rows of ``a`` come together, its set is kept."""

    def run(batches):
        last, kept = None, set()
        for batch in batches:
            good = []
            for a, b, one, other in rows_of(batch, "a", "b", "one", "other"):
                if one != last:
                    last, kept = one, shingle_set(words_of(one), width)
                if similar(kept, shingle_set(words_of(other), width), percent):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in good], pa.int64()) for i in (0, 1)], names=["a", "b"])

    second = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")
    both = second.join(texts.select(F.col("id").alias("a"), F.col("text").alias("one")), "a")
    return both.select("a", "b", "one", "other").mapInArrow(run, "a LONG, b LONG")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH,
                    percent: int = PERCENT, choice: bool = False) -> DataFrame:
    """Per row: its id, n_shingles, component_id (smallest id reachable by links), kept (the id is its component's).

    With ``choice`` also digest (of the words, null without any) and chosen: of the texts with the component's id it is the
    one with the smallest digest, so exactly one text of a component is chosen.

    Two documents are linked if 100 * common >= percent * all shingles of ``width`` words; those with fewer words have
    their whole sequence as one shingle. Texts that are null or without words have no shingles and no links. Rows with a
    null id stay, with a null component_id and kept true, unlinked. Repeated rows stay. Rows that share an id but not the
    text are judged by their texts. An empty table gives no rows; other columns are ignored.

    Equal word sequences become one class first, with a number that stands for it from then on. Then, in rounds, each class tries the partners in its buckets that look
    most similar and are in another component yet; large buckets are dealt over tasks, anew in each round. What then
    still shares a bucket and not a component is compared in full: pair by pair in small buckets, else in blocks of
    documents, so pairs of a large group never become rows. No candidate between components is left out.
    """
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sketched = materialize(sketches(plain, width), "sketches")
    linked = sketched.filter("id IS NOT NULL AND digest IS NOT NULL")
    # Copies are combined before the shuffle: they differ in their ids only.
    least = linked.groupBy("digest").agg(F.min(F.struct("id", "n", *SIGNATURE, "bands")).alias("least"))
    own = least.select("digest", "least.*").withColumnRenamed("id", "class").withColumn("id", F.monotonically_increasing_id())
    own = materialize(own, "own")
    classes = own.select("digest", "class", F.col("id").alias("node"))
    member = own.select("id", F.explode("bands").alias("key"))
    size = member.groupBy("key").agg(F.count("id").alias("size")).filter("size > 1")
    buckets = materialize(member.join(size, "key").select("key", "id", "size"), "buckets")
    nodes = own.select("id", "class", "digest", "n", *SIGNATURE).join(buckets.select("id").distinct(), "id")
    nodes = materialize(nodes, "nodes")
    # Merged at every size, so that the plan that is tried on little data is the one that runs on much.
    first = nodes.select(F.col("class").alias("id"), "digest", F.col("id").alias("node")).hint("merge")
    texts = worded(plain.filter("id IS NOT NULL")).join(first, ["id", "digest"]).dropDuplicates(["id", "digest"])
    texts, nodes = materialize(texts.select(F.col("node").alias("id"), "text"), "texts"), nodes.drop("class", "digest")

    # Every class is a component at first, so each bucket holds several.
    tried, found, apart = None, None, with_component(buckets, None)
    for turn in range(ROUNDS):
        proposed = materialize(proposals(apart, nodes, tried, percent, turn), "proposals")
        if proposed.isEmpty():
            break
        tried = proposed if tried is None else tried.unionByName(proposed)
        pairs = proposed.select(F.least("id", "partner").alias("a"), F.greatest("id", "partner").alias("b")).distinct()
        found = components(joining(confirmed(pairs, texts, width, percent), found))
        apart = materialize(mixed(apart, found), "apart")
    if not apart.isEmpty():
        # Without any proposal, every class is a component and nothing was tried.
        empty = lambda schema: docs.sparkSession.createDataFrame([], schema)
        before = empty("id LONG, component LONG") if found is None else found
        done = empty("id LONG, partner LONG") if tried is None else tried
        more = rest_links(apart, before, nodes, texts, done, width, percent)
        found = components(joining(more, found))

    labels = headed(classes, found)
    joined = sketched.select("id", "digest", "n").join(labels, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("head.class", "id"))
    chosen = (F.col("id") == F.col("head.class")) & (F.col("digest") == F.col("head.digest"))
    more = [F.col("digest"), F.coalesce(F.when(F.col("id").isNotNull(), chosen), F.lit(True)).alias("chosen")] if choice else []
    return joined.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), *more,
    )


def digest_of_words(text: Column) -> Column:
    """The digest of a text's words as near_duplicates gives it, by SQL functions."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.array_remove(F.split(F.translate(text, upper, upper.lower()), "[ \\t-\\r]+"), "")
    return F.when(F.size(words) > 0, F.unhex(F.sha2(F.concat_ws(" ", words), 256)))


def headed(classes: DataFrame, found: DataFrame | None) -> DataFrame:
    """(digest, head): the smallest class and digest of each class's component."""
    head = F.struct("class", "digest").alias("head")
    if found is None:
        return classes.select("digest", head)
    known = classes.join(found.withColumnRenamed("id", "node"), "node", "left")
    alone = known.filter("component IS NULL").select("digest", head)
    grouped = known.filter("component IS NOT NULL").select("node", "digest", "class", "component")
    heads = materialize(grouped.groupBy("component").agg(F.min(head).alias("head"), F.count("node").alias("members")), "heads")
    crowded = heads.filter(F.col("members") > FEW).select("component", "head")
    # Only classes of small components are left for the join by component alone.
    labels = materialize(dealt_join(grouped, crowded, "node", "left").select("digest", "component", "head"), "labels")
    rest = labels.filter("head IS NULL").drop("head").join(heads.filter(F.col("members") <= FEW), "component")
    return alone.unionByName(labels.filter("head IS NOT NULL").drop("component")).unionByName(rest.select("digest", "head"))


def dealt_join(rows: DataFrame, large: DataFrame, piece: str, how: str = "inner") -> DataFrame:
    """Joins rows to large components, few against the rows: each is split into SALTS pieces by a hash of ``piece``."""
    dealt = rows.withColumn("__piece", F.pmod(F.xxhash64(piece), F.lit(SALTS)))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return dealt.join(large.withColumn("__piece", pieces), ["component", "__piece"], how).drop("__piece")


def with_component(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def joining(links: DataFrame, found: DataFrame | None) -> DataFrame:
    """Links and the components found before them, each as links to its smallest node."""
    return links if found is None else links.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))


def mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component, with the component."""
    known = with_component(buckets.drop("component"), found)
    keys = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return known.join(keys.select("key"), "key")


def proposals(buckets: DataFrame, nodes: DataFrame, tried: DataFrame | None, percent: int, turn: int) -> DataFrame:
    """(id, partner): for each document the most similar ones of other components in its buckets that it hasn't tried."""
    least = least_matches(percent)
    rows = buckets.join(nodes, "id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / BLOCK)))
    if tried is None:
        rows = rows.withColumn("tried", F.array().cast("array<long>"))
    else:
        rows = rows.join(tried.groupBy("id").agg(F.collect_set("partner").alias("tried")), "id", "left")
    columns = ["key", "block", "id", "component", "n", *SIGNATURE, "tried"]

    def best(table: pa.Table) -> pa.RecordBatch:
        ids, component, n = (table.column(c).to_numpy() for c in ("id", "component", "n"))
        signature = [table.column(c).to_numpy().view(np.uint64) for c in SIGNATURE]
        tries = table.column("tried").to_pylist()
        out: list[tuple] = []
        for start in range(0, len(ids), 256):
            part = slice(start, start + 256)
            equal = np.full((len(ids[part]), len(ids)), MINIMA, np.int16)
            for s in signature:
                other = s[part, None] ^ s[None, :]
                equal -= np.bitwise_count((other | (other >> np.uint64(1))) & np.uint64(0x5555555555555555))
            small, large = np.minimum(n[part, None], n[None, :]), np.maximum(n[part, None], n[None, :])
            equal[(component[part, None] == component[None, :]) | (small * 100 < large * percent) | (equal < least)] = -1
            for row, done in enumerate(tries[part]):
                if done:
                    equal[row, np.isin(ids, done)] = -1
            partner = equal.argmax(axis=1)
            matches = equal[np.arange(len(partner)), partner]
            good = np.flatnonzero(matches >= 0)
            out += zip(ids[part][good].tolist(), ids[partner[good]].tolist(), matches[good].tolist())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["id", "partner", "matches"])

    tasks = max(1, buckets.count() // TASK)
    together = rows.select(*columns).repartition(tasks, "key", "block").sortWithinPartitions("key", "block")
    each = together.mapInArrow(by_group(best, ["key", "block"]), "id LONG, partner LONG, matches LONG")
    # A document has a proposal per bucket at most, so the set is small.
    top = each.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct("matches", "partner")), asc=False), 1, TRIES).alias("top"))
    return top.select("id", F.explode("top.partner").alias("partner"))


def pair_links(apart: DataFrame, nodes: DataFrame, texts: DataFrame, tried: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components in buckets of at most FEW documents, pair by pair."""
    rows = materialize(apart.join(nodes, "id"), "few")
    pairs = rows.alias("l").join(rows.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.component") < F.col("r.component")))
    pairs = pairs.filter(hopeful("l", "r", percent))
    pairs = pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    done = tried.select(F.least("id", "partner").alias("a"), F.greatest("id", "partner").alias("b"))
    return confirmed(pairs.join(done, ["a", "b"], "left_anti"), texts, width, percent)


def rest_links(apart: DataFrame, found: DataFrame, nodes: DataFrame, texts: DataFrame, tried: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between documents that share a bucket and not a component (key, id, size, component).

    The guests of a large component are the documents outside it that share a bucket with one of its own, the hosts. Guests
    meet hosts and each other, hosts don't meet. Large buckets without a large component have guests only.
    """
    large = found.groupBy("component").agg(F.count("id").alias("hosts")).filter(F.col("hosts") > FEW)
    held = apart.select("key", "component").distinct()
    present = dealt_join(held, large.select("component"), "key").select("key", F.col("component").alias("group"))
    visits = apart.join(present, "key").filter("component <> group").select(F.lit(0).alias("kind"), "group", "id", "component").distinct()
    others = apart.join(present.select("key").distinct(), "key", "left_anti")
    crowds = others.filter(F.col("size") > FEW).select(F.lit(1).alias("kind"), F.col("key").alias("group"), "id", "component")
    guests = materialize(visits.unionByName(crowds), "guests")
    sizes = guests.groupBy("kind", "group").agg(F.count("id").alias("guests"))
    sizes = sizes.join(large.select(F.lit(0).alias("kind"), F.col("component").alias("group"), "hosts"), ["kind", "group"], "left")
    blocks = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / TEXTS).cast("int")
    sizes = sizes.select("kind", "group", blocks(F.col("guests")).alias("g"), blocks(F.col("hosts")).alias("h"))
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    guest = guests.join(sizes, ["kind", "group"]).withColumn("block", number("g"))
    def meeting(rows: DataFrame, meet: int, x: Column, y: Column, side: Column) -> DataFrame:
        return rows.select("kind", "group", F.lit(meet).alias("meet"), x.alias("x"), y.alias("y"), side.alias("side"), "id", "component")

    block, other = F.col("block"), F.col("other")
    own = meeting(guest.withColumn("other", each("g")), 0, F.least(block, other), F.greatest(block, other), block)
    met = meeting(guest.filter("h > 0").withColumn("other", each("h")), 1, other, block, F.lit(-1))
    hosts = dealt_join(found, sizes.filter("kind = 0").withColumnRenamed("group", "component"), "id")
    hosts = hosts.withColumn("group", F.col("component")).withColumn("block", number("h")).withColumn("other", each("g"))
    host = meeting(hosts, 1, block, other, F.lit(-2))
    group = ["kind", "group", "meet", "x", "y"]
    rows = own.unionByName(met).unionByName(host).join(nodes, "id").join(texts, "id")
    dealt = rows.select(*group, "side", "id", "component", "n", *SIGNATURE, "text").repartition(*group).sortWithinPartitions(*group)
    found_links = dealt.mapInArrow(by_group(lambda table: block_links(table, width, percent), group), "a LONG, b LONG")
    few = pair_links(others.filter(F.col("size") <= FEW), nodes, texts, tried, width, percent)
    return found_links.unionByName(few)


def block_links(table: pa.Table, width: int, percent: int) -> pa.RecordBatch:
    """Links that join components of one pair of blocks. Set sizes are compared by hashes; a link counts if the words agree."""
    ids, component, n = (table.column(c).to_numpy() for c in ("id", "component", "n"))
    signature = [table.column(c).to_numpy().view(np.uint64) for c in SIGNATURE]
    side, texts = table.column("side").to_numpy(), table.column("text")
    meet, x, y = (table.column(c)[0].as_py() for c in ("meet", "x", "y"))
    left, right = (-1, -2) if meet else (x, y)
    memo, sets, least = WordHashes(), {}, least_matches(percent)
    root = {c: c for c in component.tolist()}
    out: list[tuple] = []

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    def hashes(i: int) -> np.ndarray:
        if i not in sets:
            words = words_of(texts[i].as_py())
            sets[i] = shingle_hashes(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), width)
        return sets[i]

    others = np.flatnonzero(side == right)
    for i in np.flatnonzero(side == left).tolist():
        some = others if left != right else others[others > i]
        mine = top(component[i])
        apart = np.array([top(c) != mine for c in component[some].tolist()], bool)
        equal = np.full(len(some), MINIMA, np.int16)
        for s in signature:
            other = s[i] ^ s[some]
            equal -= np.bitwise_count((other | (other >> np.uint64(1))) & np.uint64(0x5555555555555555))
        small, large = np.minimum(n[i], n[some]), np.maximum(n[i], n[some])
        some = some[apart & (equal >= least) & (small * 100 >= large * percent)]
        if not len(some):
            continue
        own = hashes(i)
        every = [hashes(j) for j in some.tolist()]
        flat, starts = np.concatenate(every), np.cumsum([0, *map(len, every[:-1])])
        common = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, starts)
        sizes = np.array([len(e) for e in every]) + len(own) - common
        for j in some[100 * common >= percent * sizes].tolist():
            if top(component[i]) == top(component[j]):
                continue
            if similar(shingle_set(words_of(texts[i].as_py()), width), shingle_set(words_of(texts[j].as_py()), width), percent):
                root[top(component[i])] = top(component[j])
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
