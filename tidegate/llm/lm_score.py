"""Documents scored by cross-entropy difference: loss under a model of wanted text less loss under one of all text.

Both models are word bigrams with the same vocabulary and smoothing. Every word and every pair of words that occurs has
counts of its own. A text is scored by what the other texts say: its own counts, and those of its copies, are left out of
both models, so that the score doesn't tell whether the text itself was wanted.

Blocks of whole texts are stored as numbers of words. A block sends its counts in ranges of keys, each packed in one row;
a range sums them over all blocks and answers, packed alike, with what the others add. So a frequent pair is one packed
number for each block, no more than a range's counts meet in a task, and texts never cross an exchange.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import materialize, spread_join
from .rows import SLICE
from .tokens import rows_of, slices, stretches

# Bytes of text in a block, of one row at least; a row counts as ROW bytes more.
BLOCK, ROW = 8_000_000, 64
# Words of all texts for each range of keys.
RANGE = 1 << 20
# Weight of unigrams against a history's counts, and what is added to each word's count.
UNIGRAMS, ADDED = 50.0, 0.1
# Kinds of counted keys: words with pairs of their own (and histories), words that share theirs, pairs.
OWN, SHARED, PAIR = range(3)
# Keys are 64-bit hashes; these stand for the start of a text, words outside a given vocabulary, words that share pairs.
START, UNKNOWN, REST = np.arange(3, dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
# Characters of the longest word of a vocabulary whose size is given.
LONGEST = 64
# Sums over the words of a range.
TOLD = ("distinct", "shared_n", "shared_t")


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over whole texts; counted in tasks first, in dictionaries of a bounded size. Long words become null."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in stretches(rows_of(batch, "text"), 0):
                for (text,) in part:
                    counts.update(words_of(text))
                if len(counts) > 500_000:
                    yield from flushed(counts)
                    counts = Counter()
        yield from flushed(counts)

    def flushed(counts):
        long = [w for w in counts if len(w) > LONGEST]
        spare = sum(counts.pop(w) for w in long)
        words, n = [*counts, *[None] * bool(long)], [*counts.values(), *[spare] * bool(long)]
        for at in range(0, len(words), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words[part], pa.string()), "n": pa.array(n[part], pa.int64())})

    return docs.mapInArrow(run, "word STRING, n LONG").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """A vocabulary of a given size: whether each of its words has pairs of its own."""

    words: dict[str, bool]

    @property
    def sharing(self) -> int:
        """Words that share their pairs, with the unknown one."""
        return 1 + sum(not own for own in self.words.values())


def learn_vocabulary(docs: DataFrame, size: int | None, classes: int | None) -> Vocabulary | None:
    """The ``size`` most frequent words, ``classes`` of them with pairs of their own; nothing if neither is given."""
    if size is None and classes is None:
        return None
    found = word_counts(docs).filter("word IS NOT NULL").orderBy(F.col("n").desc(), "word")
    rows = (found if size is None else found.limit(size)).collect()
    return Vocabulary({r.word: classes is None or i < classes for i, r in enumerate(rows)})


def squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first, compressed; high bytes that are zero take no room."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Keys in ascending order, as the steps between them."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


class Numbers(dict):
    """Numbers from 0 for words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Writer:
    """A block of texts as numbers of words."""

    COLUMNS = ("keys", "words", "shared_keys", "shared", "sizes")

    def __init__(self, vocabulary: Vocabulary | None):
        self.vocabulary, self.numbers = vocabulary, Numbers()
        self.parts, self.sizes = [np.zeros(0, np.int32)], []

    def add(self, words: list[str]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.sizes.append(len(words))

    def packed(self) -> list[bytes]:
        """``keys`` are those that histories and pairs are made of, START among them; ``words`` are places in them.
        Words that share one key there have keys of their own in ``shared_keys``, and ``shared`` are places in those."""
        flat = np.concatenate(self.parts)
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, map(str.encode, self.numbers)), np.uint64, len(self.numbers))
        row = word
        if self.vocabulary is not None:
            known = [self.vocabulary.words.get(w) for w in self.numbers]
            row = np.where(np.array([k is True for k in known], bool), word, REST)
            word = np.where(np.array([k is None for k in known], bool), UNKNOWN, word)
        keys, places = np.unique(np.concatenate([[START], row]), return_inverse=True)
        words = places[1:].astype(np.int32)[flat]
        shared_keys, shared = np.unique(word[flat[(row == REST)[flat]]], return_inverse=True)
        sizes = np.array(self.sizes, np.int64)
        return [squeeze_keys(keys), squeeze(words), squeeze_keys(shared_keys), squeeze(shared.astype(np.int32)), squeeze(sizes)]


def stored_blocks(docs: DataFrame, vocabulary: Vocabulary | None) -> DataFrame:
    """Rows of two kinds. Of each text: block, place in it, id, n_words, digest of its words. Of each block: its words.

    A block is a run of rows of one task.
    """
    columns = [T.StructField(name, T.BinaryType()) for name in Writer.COLUMNS]
    fields = [T.StructField("n_words", T.LongType()), T.StructField("digest", T.BinaryType()), *columns]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), docs.schema["id"], *fields])

    def run(batches):
        number, size, place, writer, kind = TaskContext.get().partitionId() << 32, 0, 0, Writer(vocabulary), None

        def flushed():
            texts = [pa.array([number], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
            return pa.RecordBatch.from_arrays([*texts, *(pa.array([data], pa.binary()) for data in writer.packed())], names=schema.names)

        for batch in batches:
            kind = batch.schema.field("id").type
            for part in slices(batch, "text", SLICE):
                if size >= BLOCK:
                    yield flushed()
                    number, size, place, writer = number + 1, 0, 0, Writer(vocabulary)
                rows, digests = part.num_rows, []
                for (text,) in rows_of(part, "text"):
                    words = words_of(text)
                    writer.add(words)
                    digests.append(xxhash.xxh3_128_digest(" ".join(words).encode()))
                own = [np.full(rows, number, np.int64), np.arange(place, place + rows, dtype=np.int32)]
                told = [pa.array(np.array(writer.sizes[place:], np.int64)), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays([*map(pa.array, own), part.column("id"), *told, *(pa.nulls(rows, pa.binary()) for _ in columns)], names=schema.names)
                place += rows
                size += ROW * rows + pc.sum(pc.binary_length(part.column("text"))).as_py()
        if place:
            yield flushed()

    return docs.mapInArrow(run, schema)


class Block:
    """A stored block: its texts' words, histories and pairs as places among their distinct keys."""

    def __init__(self, keys: bytes, words: bytes, shared_keys: bytes, shared: bytes, sizes: bytes):
        self.keys = {OWN: unsqueeze_keys(keys), SHARED: unsqueeze_keys(shared_keys)}
        self.words, self.shared, self.sizes = unsqueeze(words, np.int32), unsqueeze(shared, np.int32), unsqueeze(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        row = self.keys[OWN]
        # START is the least key, so its place is 0.
        self.before = np.concatenate([np.zeros(1, np.int32), self.words])[:len(self.words)]
        self.before[self.first[self.sizes > 0]] = 0
        self.sharing = row[self.words] == REST
        one = row[self.before]
        pair = (one ^ (one >> np.uint64(29))) * _PRIME + row[self.words]
        self.keys[PAIR], pairs = np.unique((pair ^ (pair >> np.uint64(32))) * _PRIME, return_inverse=True)
        self.pairs = pairs.astype(np.int32)

    def spread(self, of_texts: np.ndarray) -> np.ndarray:
        """For each word, what is given for its text."""
        return np.repeat(of_texts, self.sizes)

    def counts(self, wanted: np.ndarray) -> dict[int, list[np.ndarray]]:
        """By kind, for each key its number in all and in wanted texts; words with pairs also count as histories."""
        mine = self.spread(wanted)

        def of(kind, places, mine):
            size = len(self.keys[kind])
            return [np.bincount(places, minlength=size), np.bincount(places[mine], minlength=size)]

        words, pairs = of(OWN, self.words, mine) + of(OWN, self.before, mine), of(PAIR, self.pairs, mine)
        return {OWN: words, SHARED: of(SHARED, self.shared, mine[self.sharing]), PAIR: pairs}

    def own(self, places: np.ndarray, texts: np.ndarray, kinds: int) -> np.ndarray:
        """For each word, how often what is at its place occurs in its text."""
        if not len(places):
            return np.zeros(0, np.int32)
        _, inverse, counts = np.unique(texts * kinds + places, return_inverse=True, return_counts=True)
        return counts.astype(np.int32)[inverse]


def cut(keys: np.ndarray, bits: int) -> Iterable[tuple[int, slice]]:
    """The ranges that the keys, in ascending order, lie in; a range is what the highest ``bits`` say."""
    if not len(keys):
        return
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(ranges, prepend=-1))
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield int(ranges[start]), slice(start, stop)


def flags(places: list[int] | None, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[places or []] = True
    return out


def cells(blocks: DataFrame, bits: int) -> DataFrame:
    """For each block, kind and range: its keys and their counts, packed."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = {name: batch.column(name)[at].as_py() for name in ("block", "wanted", *Writer.COLUMNS)}
                block = Block(*(one[name] for name in Writer.COLUMNS))
                for kind, counts in block.counts(flags(one["wanted"], len(block.sizes))).items():
                    for number, part in cut(block.keys[kind], bits):
                        yield pa.RecordBatch.from_pydict({
                            "block": pa.array([one["block"]], pa.int64()),
                            "kind": pa.array([kind], pa.int32()),
                            "range": pa.array([number], pa.int64()),
                            "keys": pa.array([squeeze_keys(block.keys[kind][part])], pa.binary()),
                            "counts": pa.array([squeeze(np.concatenate([c[part] for c in counts]))], pa.binary()),
                        })

    return blocks.select("block", "wanted", *Writer.COLUMNS).mapInArrow(run, "block LONG, kind INT, range LONG, keys BINARY, counts BINARY")


def answers(found: DataFrame) -> DataFrame:
    """For each row of ``found``, what other blocks add to its counts. Told once in a range: its ``distinct`` words, and how
    many words share their pairs, in all (``shared_n``) and in wanted texts (``shared_t``)."""

    def add(rows: pa.Table) -> pa.Table:
        keys = [unsqueeze_keys(data.as_py()) for data in rows.column("keys")]
        sizes = [len(some) for some in keys]
        distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
        own = [unsqueeze(data.as_py(), np.int64).reshape(-1, size) for data, size in zip(rows.column("counts"), sizes)]
        flat = np.concatenate(own, axis=1)
        sums = np.zeros((len(flat), len(distinct)), np.int64)
        for total, one in zip(sums, flat):
            np.add.at(total, places, one)
        rest = sums[:, places] - flat
        stops = np.cumsum(sizes).tolist()
        packed = [squeeze(np.ascontiguousarray(rest[:, stop - size:stop]).ravel()) for size, stop in zip(sizes, stops)]
        told = np.zeros((3, rows.num_rows), np.int64)
        if rows.column("kind")[0].as_py() == OWN:
            shared = distinct == REST
            told[:, 0] = [((sums[0] > 0) & ~shared).sum(), sums[0][shared].sum(), sums[1][shared].sum()]
        columns = [rows.column("block"), rows.column("kind"), rows.column("range"), pa.array(packed, pa.binary()), *map(pa.array, told)]
        return pa.Table.from_arrays(columns, names=["block", "kind", "range", "rest", *TOLD])

    return found.groupBy("kind", "range").applyInArrow(add, f"block LONG, kind INT, range LONG, rest BINARY, {' LONG, '.join(TOLD)} LONG")


@dataclass
class Model:
    """Sums over all texts, wanted or not: words, words that share their pairs, distinct words, those that share."""

    words: int
    shared: int
    distinct: int
    sharing: int

    def losses(self, block: Block, found: dict[str, np.ndarray], own: dict[str, np.ndarray], times: np.ndarray) -> np.ndarray:
        """The mean loss of each text, without ``times`` its own counts."""
        left = block.spread(times)
        sharing = np.bincount(np.repeat(np.arange(len(block.sizes)), block.sizes)[block.sharing], minlength=len(block.sizes))
        total = self.words - times * block.sizes + ADDED * (self.distinct + self.sharing)
        shared = (self.shared - times * sharing + ADDED * self.sharing) / total
        n = {kind: found[kind] - left * own[kind] for kind in ("word", "history", "pair")}
        one = (n["word"] + ADDED) / block.spread(total)
        kind = np.where(block.sharing, block.spread(shared), one)
        each = -np.log((n["pair"] + UNIGRAMS * kind) / (n["history"] + UNIGRAMS)) - np.log(one / kind)
        out, full = np.zeros(len(block.sizes)), block.sizes > 0
        if len(each):
            out[full] = np.add.reduceat(each, block.first[full]) / block.sizes[full]
        return out


def cross_entropy_difference(docs: DataFrame, wanted: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                             vocabulary: int | None = None, classes: int | None = None) -> DataFrame:
    """Per row: its id, n_words, target_loss and background_loss (nats a word), score (their difference; lower: more like
    the wanted documents, whose ids are the first column of ``wanted``).

    Words are split at white space, in lower case. A text is scored by the counts of the other texts: what it and all
    texts of the same words have counted is taken from both models. Texts that are null or without words have losses and a
    score of 0. Null ids aren't wanted; repeated rows and ids count and stay. An empty table gives no rows; without (other)
    wanted documents the target model is the even one. Other columns are ignored.

    All words and pairs have counts of their own. A caller may ask for a smaller model: only the ``vocabulary`` most
    frequent words, or pairs for the ``classes`` most frequent ones only. Such words have to fit into memory and into
    LONGEST characters; all others count as one.

    Words are written as numbers in blocks; a block's numbers are shuffled once, to meet what other blocks have counted.
    Keys are 64-bit hashes: among a billion distinct pairs, some two share a count with a chance of 3 %.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    plain = docs.select(F.col(id_column).alias("id"), text)
    known = learn_vocabulary(plain.select("text"), vocabulary, classes)
    stored = materialize(stored_blocks(plain, known), "blocks")
    texts = stored.filter("place IS NOT NULL").select("block", "place", "id", "n_words", "digest", F.col("id").cast("long").alias("__id"))
    blocks = stored.filter("place IS NULL").select("block", *Writer.COLUMNS)

    ids = wanted.select(F.col(wanted.columns[0]).cast("long").alias("__id")).filter("__id IS NOT NULL").distinct()
    at = ["block", "place"]
    marked = spread_join(texts, ids.withColumn("mark", F.lit(1)), ["__id"], "left", spread_by=at).drop("__id")
    marked = materialize(marked.withColumn("mark", F.coalesce("mark", F.lit(0))), "marks")
    copies = marked.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("t"))
    places = materialize(marked.filter("mark = 1").groupBy("block").agg(F.collect_list("place").alias("wanted")), "wanted")

    sums = marked.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("n_words"), F.col("n_words") * F.col("mark"))]).first()
    bits = max(0, (int(sums[0]) // RANGE).bit_length())
    found = materialize(answers(cells(blocks.join(places, "block", "left"), bits)), "answers")
    distinct, *shared = (int(n) for n in found.agg(*[F.coalesce(F.sum(name), F.lit(0)) for name in TOLD]).first())
    sharing = 1 if known is None else known.sharing

    def score(rows: pa.Table, of_texts: pa.Table) -> pa.Table:
        of_texts = of_texts.sort_by("place")
        told = {name: of_texts.column(name).to_numpy() for name in ("mark", "n", "t")}
        whole = rows.filter(pc.is_valid(rows.column("keys")))
        block = Block(*(whole.column(name)[0].as_py() for name in Writer.COLUMNS))
        counts = block.counts(told["mark"] == 1)
        parts = {kind: dict(cut(keys, bits)) for kind, keys in block.keys.items()}
        for kind, number, data in zip(*(rows.column(name).to_pylist() for name in ("kind", "range", "rest"))):
            if data is not None:
                part = parts[kind][number]
                for mine, more in zip(counts[kind], unsqueeze(data, np.int64).reshape(-1, part.stop - part.start)):
                    mine[part] += more
        text = block.spread(np.arange(len(block.sizes)))
        word = block.own(block.words, text, len(block.keys[OWN]))
        word[block.sharing] = block.own(block.shared, text[block.sharing], len(block.keys[SHARED]))
        own = {"word": word, "history": block.own(block.before, text, len(block.keys[OWN])), "pair": block.own(block.pairs, text, len(block.keys[PAIR]))}
        losses = []
        for side, (times, words) in enumerate((("n", sums[0]), ("t", sums[1]))):
            one = counts[OWN][side][block.words]
            one[block.sharing] = counts[SHARED][side][block.shared]
            all_of = {"word": one, "history": counts[OWN][2 + side][block.before], "pair": counts[PAIR][side][block.pairs]}
            model = Model(int(words), shared[side], distinct, sharing)
            losses.append(model.losses(block, all_of, own, told[times]))
        columns = [of_texts.column("id"), pa.array(block.sizes), *map(pa.array, reversed(losses))]
        return pa.Table.from_arrays(columns, names=["id", "n_words", "target_loss", "background_loss"])

    fields = [T.StructField("n_words", T.LongType()), T.StructField("target_loss", T.DoubleType()), T.StructField("background_loss", T.DoubleType())]
    together = blocks.unionByName(found.drop(*TOLD), allowMissingColumns=True).groupBy("block")
    counted = spread_join(marked.drop("n_words"), copies, ["digest"], "left", spread_by=at).drop("digest").groupBy("block")
    scored = together.cogroup(counted).applyInArrow(score, T.StructType([stored.schema["id"], *fields]))
    return scored.select(F.col("id").alias(id_column), "n_words", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
