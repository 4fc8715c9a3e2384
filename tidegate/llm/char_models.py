"""Kneser-Ney models of characters within words for two classes, as tables of n-grams.

Blocks of whole texts are stored as numbers of words, with their distinct words. A block sends its distinct n-grams of the
highest order with their counts, in ranges of keys, each packed in one row; what blocks send is merged by range. All lower
orders follow from these n-grams, and an n-gram that is only asked for has counts of 0. A range answers each block with
the ratios of its n-grams, packed alike. So no machine holds a model, and texts never cross an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import batch_rows, materialize, materialize_by, materialize_measured
from .lm_score import cut, squeeze, unsqueeze
from .rows import SLICE
from .tokens import rows_of, slices

ORDER, SHARED = 5, 2
START, STOP = 2, 3
# Words of a stretch.
STRETCH = 6
# Bytes of text in a block, of one row at least, and characters of its distinct words.
BLOCK, DISTINCT = 16_000_000, 3_000_000
# Words, and characters of distinct words, in one row of a block: rows of some hundred kilobytes.
WORDS, NAMES = 200_000, 400_000
# Characters of the blocks' distinct words for each range of keys, n-grams merged and words judged at once.
RANGE, MERGED, JUDGED = 1 << 22, 500_000, 500_000
# Counts are kept by half and class of the texts. The models: of both halves, and those that judge one half by the other.
KINDS, MODELS = 4, 3
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between start and stop marks, and which of them are predicted."""
    head, tail = chr(START) * (ORDER - 1), chr(STOP)
    x = np.frombuffer("".join([head + w + tail for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum([0, *[len(w) + ORDER for w in words[:-1]]]) if words else np.zeros(0, np.int64)
    predicted = np.ones(len(x), bool)
    for at in range(ORDER - 1):
        predicted[starts + at] = False
    return x, predicted


def keys_by_order(x: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the key of the n-gram that ends at each place (places before the first full one hold zeros)."""
    part = None
    wide = x.astype(np.uint64) + np.uint64(1)
    for n in range(1, ORDER + 1):
        part = wide if part is None else np.concatenate([np.zeros(1, np.uint64), part[:-1]]) * _PRIME + wide
        mixed = (part + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        yield mixed ^ (mixed >> np.uint64(29))


def gram_keys(x: np.ndarray) -> list[np.ndarray]:
    return list(keys_by_order(x))


def top_keys(x: np.ndarray) -> np.ndarray:
    """The keys of the highest order only."""
    for keys in keys_by_order(x):
        pass
    return keys


def characters(points: np.ndarray) -> list[str]:
    """Rows of ORDER code points as strings."""
    joined = np.ascontiguousarray(points, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[at:at + ORDER] for at in range(0, len(joined), ORDER)]


def text_features(ratios: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text, of ``sizes`` words: the ratio by character of the whole text and of its most toxic stretch."""
    out, ends = np.zeros((len(sizes), 2)), np.cumsum(sizes)
    starts, full = ends - sizes, sizes > 0
    ratio, length = np.r_[0, np.cumsum(ratios)], np.r_[0, np.cumsum(lengths)]
    out[full] = ((ratio[ends] - ratio[starts])[full] / (length[ends] - length[starts])[full])[:, None]
    long = np.flatnonzero(sizes > STRETCH)
    if len(long):
        each = np.r_[(ratio[STRETCH:] - ratio[:-STRETCH]) / (length[STRETCH:] - length[:-STRETCH]), -np.inf]
        bounds = np.stack([starts[long], ends[long] - STRETCH + 1], 1).ravel()
        out[long, 1] = np.maximum.reduceat(each, bounds)[::2]
    return out


class Numbers(dict):
    """Numbers from 0 for words as they come, and the characters of all."""

    characters = 0

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.characters += len(word) + 1
        return number


class Writer:
    """A block of texts as numbers of words, cut into pieces."""

    COLUMNS = {"piece": T.IntegerType(), "words": T.BinaryType(), "sizes": T.BinaryType(), "vocabulary": T.BinaryType(), "places": T.LongType()}

    def __init__(self):
        self.numbers, self.parts, self.sizes, self.bytes = Numbers(), [np.zeros(0, np.int32)], [], 0

    def add(self, text: str) -> None:
        words = text.lower().split()
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.sizes.append(len(words))

    def packed(self) -> list[pa.Array]:
        """Frequent words get low numbers, so that most numbers are small. Words hold no white space, so it parts them."""
        flat, names = np.concatenate(self.parts), list(self.numbers)
        order = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")
        ranks = np.empty(len(names), np.int32)
        ranks[order] = np.arange(len(names), dtype=np.int32)
        press = zstandard.ZstdCompressor(level=3).compress
        words = [squeeze(ranks[flat[at:at + WORDS]]) for at in range(0, len(flat), WORDS)]
        names = [names[place] for place in order]
        starts = np.flatnonzero(np.diff(np.cumsum([len(name) + 1 for name in names]) // NAMES, prepend=-1)).tolist()
        vocabulary = [press(" ".join(names[start:stop]).encode()) for start, stop in zip(starts, [*starts[1:], len(names)])]
        rows = max(1, len(words), len(vocabulary))
        sizes, places = [squeeze(np.array(self.sizes, np.int64))], [self.numbers.characters]
        columns = [list(range(rows)), words, sizes, vocabulary, places]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return [pa.array(column + [None] * (rows - len(column)), kind) for column, kind in zip(columns, kinds)]


def stored_texts(docs: DataFrame) -> DataFrame:
    """Rows of two kinds, from id, text and further columns. Of each text: block, place in it, its other columns. Of each
    block: the pieces of its words. A block is a run of rows of one task, and lies in one bucket."""
    others = [field for field in docs.schema.fields if field.name != "text"]
    columns = [T.StructField(name, kind) for name, kind in Writer.COLUMNS.items()]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), *others, *columns])
    names, kinds = [field.name for field in others], [pa.int32(), *[pa.binary()] * 3, pa.int64()]

    def run(batches):
        number, place, writer, own = TaskContext.get().partitionId() << 32, 0, Writer(), []

        def flushed():
            packed = writer.packed()
            rows = len(packed[0])
            texts = [pa.array([number] * rows, pa.int64()), pa.nulls(rows, pa.int32()), *(pa.nulls(rows, kind) for kind in own)]
            return pa.RecordBatch.from_arrays([*texts, *packed], names=schema.names)

        for batch in batches:
            own = [batch.schema.field(name).type for name in names]
            for part in slices(batch, "text", SLICE):
                if writer.bytes >= BLOCK or writer.numbers.characters >= DISTINCT:
                    yield flushed()
                    number, place, writer = number + 1, 0, Writer()
                rows = part.num_rows
                for (text,) in rows_of(part, "text"):
                    writer.add(text)
                writer.bytes += pc.sum(pc.binary_length(part.column("text"))).as_py()
                at = [pa.array(np.full(rows, number, np.int64)), pa.array(np.arange(place, place + rows, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*at, *map(part.column, names), *(pa.nulls(rows, kind) for kind in kinds)], names=schema.names)
                place += rows
        if place:
            yield flushed()

    return materialize_by(docs.mapInArrow(run, schema), "texts", "block")


class Block:
    """A stored block: its words, and the distinct n-grams of its distinct words in the order of their keys."""

    def __init__(self, rows: pa.Table):
        rows = rows.filter(pc.is_valid(rows.column("piece"))).sort_by("piece")
        words, sizes, vocabulary = (rows.column(name).drop_null() for name in ("words", "sizes", "vocabulary"))
        self.words = np.concatenate([np.zeros(0, np.int32), *(unsqueeze(data.as_py(), np.int32) for data in words)])
        self.sizes = unsqueeze(sizes[0].as_py(), np.int64)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64))]
        for data in vocabulary:
            names = zstandard.ZstdDecompressor().decompress(data.as_py()).decode().split(" ")
            x, predicted = padded(names)
            ends = np.flatnonzero(predicted)
            keys, first, places = np.unique(top_keys(x)[ends], return_index=True, return_inverse=True)
            points = x[ends[first][:, None] + np.arange(1 - ORDER, 1)]
            held.append((np.fromiter(map(len, names), np.int64, len(names)) + 1, keys, points, places))
        lengths, keys, points, places = zip(*held)
        self.lengths = np.concatenate(lengths)
        self.keys, first, of_pieces = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        self.points, of_pieces = np.concatenate(points)[first], of_pieces.astype(np.int32)
        starts = np.cumsum([0, *map(len, keys)])
        self.places = np.concatenate([of_pieces[start + some] for start, some in zip(starts, places)])

    def counts(self, marked: np.ndarray) -> np.ndarray:
        """For each kind, how often each n-gram occurs in texts of it; ``marked`` holds KINDS * place + kind."""
        out = np.zeros((KINDS, len(self.keys)), np.int64)
        for kind, sums in enumerate(out):
            mine = np.zeros(len(self.sizes), bool)
            mine[marked[marked % KINDS == kind] // KINDS] = True
            if mine.any():
                of_words = np.bincount(self.words[np.repeat(mine, self.sizes)], minlength=len(self.lengths))
                sums[:] = np.bincount(self.places, np.repeat(of_words, self.lengths), len(self.keys))
        return out

    def features(self, found: np.ndarray, other: np.ndarray | None = None, second: np.ndarray | None = None) -> np.ndarray:
        """Of each text, by the ratio of each n-gram; texts marked in ``second`` go by ``other`` ones."""
        first = np.cumsum(self.lengths) - self.lengths
        of_words = [np.add.reduceat(some.astype(float)[self.places], first) if len(first) else np.zeros(0) for some in (found, other) if some is not None]
        out, ends = np.zeros((len(self.sizes), 2)), np.cumsum(self.sizes)
        # A run of texts of about JUDGED words, of one text at least.
        bounds = np.flatnonzero(np.diff(ends // JUDGED, prepend=-1)).tolist()
        for start, stop in zip(bounds, [*bounds[1:], len(ends)]):
            sizes = self.sizes[start:stop]
            words = self.words[ends[start] - self.sizes[start]:ends[stop - 1]]
            ratios = of_words[0][words]
            if other is not None:
                ratios = np.where(np.repeat(second[start:stop], sizes), of_words[1][words], ratios)
            out[start:stop] = text_features(ratios, self.lengths[words], sizes)
        return out


def asked(stored: DataFrame, places: DataFrame, bits: int) -> DataFrame:
    """For each block and range: its n-grams as code points, and their counts in the texts at ``places``, packed."""

    def ask(pieces: pa.Table, marked: pa.Table) -> pa.Table:
        block, rows = Block(pieces), []
        counts = block.counts(np.concatenate([np.zeros(0, np.int64), *(some.values.to_numpy() for some in marked.column("marked"))]))
        for number, part in cut(block.keys, bits):
            points = block.points[part]
            # Neighbours begin alike, so they take less room.
            order = np.lexsort(points.T[::-1])
            rows.append((number, squeeze(points[order].T.ravel()), squeeze(counts[:, part][:, order].ravel())))
        columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))]
        return pa.table([pa.array([pieces.column("block")[0].as_py()] * len(rows), pa.int64()), *columns], names=["block", "range", "grams", "counts"])

    blocks = stored.filter("place IS NULL").select("block", *Writer.COLUMNS).groupBy("block")
    return blocks.cogroup(places.groupBy("block")).applyInArrow(ask, "block LONG, range LONG, grams BINARY, counts BINARY")


def unpacked(grams: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code points, keys) of packed n-grams."""
    points = np.ascontiguousarray(unsqueeze(grams, np.uint32).reshape(ORDER, -1).T)
    return points, top_keys(points.ravel())[ORDER - 1::ORDER]


def merged(asks: DataFrame) -> DataFrame:
    """gram, key, and the sums of counts by kind (n0 to n3) of all n-grams, those with counts of 0 too.

    Ranges meet in tasks, which merge what comes until it is too much to hold; a sum over tasks does the rest.
    """
    names = [f"n{kind}" for kind in range(KINDS)]

    def together(held: list[tuple]) -> list[tuple]:
        points, keys, counts = (np.concatenate([some[k] for some in held], axis) for k, axis in enumerate((0, 0, 1)))
        keys, first, places = np.unique(keys, return_index=True, return_inverse=True)
        return [(points[first], keys, np.stack([np.bincount(places, row, len(keys)).astype(np.int64) for row in counts]))]

    def rows(held: list[tuple]):
        for points, keys, counts in held:
            for at in range(0, len(keys), 50_000):
                some = slice(at, at + 50_000)
                columns = [pa.array(characters(points[some]), pa.string()), pa.array(keys[some].view(np.int64)), *map(pa.array, counts[:, some])]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "key", *names])

    def run(batches):
        held, fresh = [], 0
        for batch in batches:
            for grams, counts in zip(batch.column("grams"), batch.column("counts")):
                points, keys = unpacked(grams.as_py())
                held.append((points, keys, unsqueeze(counts.as_py(), np.int64).reshape(KINDS, -1)))
                fresh += len(keys)
                if fresh >= MERGED:
                    held, fresh = together(held), 0
                    if len(held[0][1]) >= MERGED:
                        yield from rows(held)
                        held = []
        if held:
            yield from rows(together(held))

    dealt = asks.select("range", "grams", "counts").repartition("range").sortWithinPartitions("range")
    found = dealt.mapInArrow(run, f"gram STRING, key LONG, {', '.join(f'{name} LONG' for name in names)}")
    return found.groupBy("gram", "key").agg(*[F.sum(name).alias(name) for name in names])


def log_ratios(grams: DataFrame) -> DataFrame:
    """gram, key, and by model the log of how much likelier its last character is in toxic text (r0 to r2), for each of the
    distinct n-grams of the highest order with counts by kind.

    Orders above SHARED have counts of the class, lower ones of both; below the highest all are continuation counts, of
    distinct n-grams one longer. Each order is one aggregate, one window over n-grams with the same context and one join:
    n-grams are distinct, so no more of them share a context or a suffix than there are characters.
    """
    pairs = [(m, k) for m in range(MODELS) for k in (0, 1)]

    def any_of(m: int):
        return (F.col(f"s{m}0") | F.col(f"s{m}1")).cast("int")

    kinds = {0: ("n0 + n2", "n1 + n3"), 1: ("n2", "n3"), 2: ("n0", "n1")}
    level = grams.select("gram", "key", *[F.expr(kinds[m][k]).alias(f"c{m}{k}") for m, k in pairs])
    level = level.select("*", *[(F.col(f"c{m}{k}") > 0).alias(f"s{m}{k}") for m, k in pairs])
    levels = {}
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            seen = [F.sum(any_of(m) if n <= SHARED else F.col(f"s{m}{k}").cast("int")).alias(f"c{m}{k}") for m, k in pairs]
            level = level.groupBy(F.substring("gram", 2, n).alias("gram")).agg(*seen, *[F.max(f"s{m}{k}").alias(f"s{m}{k}") for m, k in pairs])
        often = [F.coalesce(F.sum((F.col(f"c{m}{k}") == times).cast("int")), F.lit(0)).alias(f"{times}{m}{k}") for m, k in pairs for times in (1, 2)]
        number = [F.coalesce(F.sum(any_of(m)), F.lit(0)).alias(f"some{m}") for m in range(MODELS)]
        if n == ORDER:
            told = level.agg(*often, *number).first().asDict()
        else:
            level, told = materialize_measured(level, f"order-{n}", *often, *number)
        levels[n] = level, told
    # The even model of all known characters and one more.
    chances = {(m, k): F.lit(1 / (told[f"some{m}"] + 1)) for m, k in pairs}
    below = None
    for n in range(1, ORDER + 1):
        level, told = levels[n]
        alike = Window.partitionBy(F.substring("gram", 1, n - 1))
        own = []
        for m, k in pairs:
            c, off = F.col(f"c{m}{k}"), discount(told[f"1{m}{k}"], told[f"2{m}{k}"])
            total = F.sum(c).over(alike)
            own.append(F.when(c > 0, (c - off) / total).otherwise(0.0).alias(f"share{m}{k}"))
            own.append(F.when(total > 0, off * F.sum((c > 0).cast("int")).over(alike) / total).otherwise(1.0).alias(f"weight{m}{k}"))
        kept = ["gram", "key"] if n == ORDER else ["gram"]
        level = level.select(*kept, *own)
        if below is not None:
            level = level.join(below.withColumnRenamed("gram", "suffix"), F.substring("gram", 2, n - 1) == F.col("suffix"))
            chances = {(m, k): F.col(f"p{m}{k}") for m, k in pairs}
        below = level.select(*kept, *[(F.col(f"share{m}{k}") + F.col(f"weight{m}{k}") * chances[m, k]).alias(f"p{m}{k}") for m, k in pairs])
    return below.select("gram", "key", *[F.log(F.col(f"p{m}1") / F.col(f"p{m}0")).cast("float").alias(f"r{m}") for m in range(MODELS)])


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.75


def answers(asks: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """For each row of ``asks``, the ratios of its n-grams by model, in the order of their keys."""
    names = [f"r{m}" for m in range(MODELS)]

    def answer(rows: pa.Table, known: pa.Table) -> pa.Table:
        keys = known.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, ratios, out = keys[order], np.stack([known.column(name).to_numpy()[order] for name in names]), []
        for grams in rows.column("grams"):
            mine = np.sort(unpacked(grams.as_py())[1])
            out.append(squeeze(ratios[:, np.searchsorted(keys, mine)].ravel()))
        return pa.table([rows.column("block"), rows.column("range"), pa.array(out, pa.binary())], names=["block", "range", "ratios"])

    ranged = found.select(F.shiftrightunsigned("key", 64 - bits).alias("range") if bits else F.lit(0).cast("long").alias("range"), "key", *names)
    asks = asks.select("block", "range", "grams").groupBy("range")
    return asks.cogroup(ranged.groupBy("range")).applyInArrow(answer, "block LONG, range LONG, ratios BINARY")


def features(stored: DataFrame, marked: DataFrame | None = None, learned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(features of all stored texts, counts of n-grams that are learned or asked for).

    ``marked`` are texts to learn from (block, place, half, mark, of 0 or 1), or else ``learned`` has the counts already.
    Features are the text's other columns, mean and most by the model of both halves, and for marked texts cross_mean and
    cross_most by the model of the other half, and marks: 1 for mark 0, 2 for mark 1, 3 for both.
    """
    spark = stored.sparkSession
    places = spark.createDataFrame([], "block LONG, marked ARRAY<LONG>")
    if marked is not None:
        kind = F.col("place") * F.lit(KINDS).cast("long") + 2 * F.col("half") + F.col("mark")
        places = materialize(marked.groupBy("block").agg(F.collect_list(kind).alias("marked")), "marked-places")
    size = stored.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    bits = (int(size) // RANGE).bit_length()
    asks = materialize(asked(stored, places, bits), "asks")
    counts = merged(asks)
    if learned is not None:
        counts = learned.unionByName(counts).groupBy("gram", "key").agg(*[F.sum(f"n{kind}").alias(f"n{kind}") for kind in range(KINDS)])
    # A row holds what a block has in a range: up to some hundred kilobytes.
    with batch_rows(spark, 64):
        counts = materialize(counts, "counts")
    told = answers(asks, log_ratios(counts), bits).unionByName(places, allowMissingColumns=True)
    others = [field for field in stored.schema.fields if field.name not in ("block", "place", *Writer.COLUMNS)]

    def judge(texts: pa.Table, rows: pa.Table) -> pa.Table:
        of_texts = texts.filter(pc.is_valid(texts.column("place"))).sort_by("place")
        block = Block(texts)
        parts, ratios = dict(cut(block.keys, bits)), np.zeros((MODELS, len(block.keys)), np.float32)
        marks = np.zeros(len(block.sizes), np.int32)
        for number, data, some in zip(*(rows.column(name) for name in ("range", "ratios", "marked"))):
            if data.is_valid:
                part = parts[number.as_py()]
                ratios[:, part] = unsqueeze(data.as_py(), np.float32).reshape(MODELS, -1)
            if some.is_valid:
                place, kind = np.divmod(some.values.to_numpy(), KINDS)
                np.bitwise_or.at(marks, place, (1 + kind % 2).astype(np.int32))
        columns = [block.features(ratios[0])]
        if marks.any():
            columns.append(block.features(ratios[1], ratios[2], of_texts.column("half").to_numpy() == 1))
        else:
            columns.append(np.zeros((len(marks), 2)))
        numbers = [pa.array(column, mask=None if at < 2 else marks == 0) for at, column in enumerate(np.concatenate(columns, 1).T)]
        return pa.table([*(of_texts.column(field.name) for field in others), *numbers, pa.array(marks)], names=names)

    fields = [T.StructField(name, T.DoubleType()) for name in ("mean", "most", "cross_mean", "cross_most")]
    schema = T.StructType([*others, *fields, T.StructField("marks", T.IntegerType())])
    names = schema.names
    # Blocks lie in buckets already, and answers come to them.
    found = stored.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(judge, schema)
    return materialize(found, "features"), counts
