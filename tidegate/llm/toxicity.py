"""Toxicity by class-conditional Kneser-Ney models of characters within words.

One model learns from toxic documents, one from ordinary ones. From the third order on each has counts of its own; below,
both use continuation counts of all, so an expression that neither knows gets the same probability from both. The ratio
of the two likelihoods, divided by the length, is taken over the text and over its most toxic stretch of some words.

Queries learn and judge by the tables of ``char_models``; ``Model`` is the same in memory, for few n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import materialize, materialize_measured, newest_per, spread_join
from .char_models import (  # noqa: F401
    KINDS, ORDER, SHARED, START, STOP, STRETCH, characters, discount, features, gram_keys, log_ratios, padded, stored_texts, text_features, top_keys,
)
from .rows import unused
from .samples import remainder

MARKS = "ordinary", "toxic"
THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1


def before(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), keys[:-1]])


@dataclass
class Lookup:
    """Numbers by key, a row for each class."""

    keys: np.ndarray
    values: np.ndarray
    default: float

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full((len(self.values), len(keys)), self.default, np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[:, at], np.float32(self.default))


def level(keys: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> tuple[Lookup, Lookup]:
    """(discounted share by n-gram, weight of the next lower order by context), from counts with a row for each class."""
    found, place = np.unique(contexts, return_inverse=True)
    shares, weights = np.zeros(counts.shape), np.ones((len(counts), len(found)))
    for k, row in enumerate(counts.astype(float)):
        off = discount(int((counts[k] == 1).sum()), int((counts[k] == 2).sum()))
        total, kinds = np.bincount(place, row, len(found)), np.bincount(place, row > 0, len(found))
        used = row > 0
        shares[k, used] = (row[used] - off).clip(0) / total[place[used]]
        weights[k, total > 0] = off * kinds[total > 0] / total[total > 0]
    order = np.argsort(keys)
    return Lookup(keys[order], shares[:, order].astype(np.float32), 0.0), Lookup(found, weights.astype(np.float32), 1.0)


@dataclass
class Model:
    """Both classes; made of distinct n-grams with their order, keys of the n-gram, its first and its last n-1 characters,
    and their counts in ordinary and toxic text."""

    characters: int = 1
    levels: list = field(default_factory=list)

    @classmethod
    def of(cls, grams: dict[str, np.ndarray]) -> Model:
        some = (grams["ordinary"] > 0) | (grams["toxic"] > 0)
        grams = {name: column[some] for name, column in grams.items()}
        by_order = {n: {name: column[grams["n"] == n] for name, column in grams.items()} for n in range(1, ORDER + 1)}
        model = cls(characters=len(by_order[1]["key"]) + 1)
        for n in range(1, ORDER + 1):
            own, above = by_order[n], by_order.get(n + 1)
            counts = []
            for name in ("ordinary", "toxic"):
                if above is None:
                    counts.append(own[name])
                    continue
                both = (above["ordinary"] > 0) | (above["toxic"] > 0)
                seen = above["suffix"][both if n <= SHARED else above[name] > 0]
                kinds, times = np.unique(seen, return_counts=True)
                counts.append(Lookup(kinds, times[None, :], 0)(own["key"])[0])
            model.levels.append(level(own["key"], own["prefix"], np.stack(counts)))
        return model

    def ratios(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of toxic less ordinary, characters predicted) of each word."""
        if not words:
            return np.zeros(0), np.zeros(0)
        x, predicted = padded(words)
        keys = gram_keys(x)
        place = np.flatnonzero(predicted)
        p = np.full((2, len(place)), 1 / self.characters)
        for n, (share, weight) in enumerate(self.levels):
            context = before(keys[n - 1])[place] if n else np.zeros(len(place), np.uint64)
            p = share(keys[n][place]) + weight(context) * p
        lengths = np.array([len(w) + 1 for w in words])
        first = np.cumsum(lengths) - lengths
        return np.add.reduceat(np.log(p[1]) - np.log(p[0]), first), lengths


class Features:
    """Length-normalised ratios of texts."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [text.lower().split() for text in texts]
        names = list({w for words in split for w in words})
        known = dict(zip(names, zip(*self.model.ratios(names))))
        flat = np.array([known[w] for words in split for w in words]).reshape(-1, 2)
        return text_features(flat[:, 0], flat[:, 1], np.fromiter(map(len, split), np.int64, len(split)))


def counted(texts: DataFrame, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """n-grams of marked texts (text, mark): order, keys, and how often each occurs in texts of each mark."""

    def run(batches):
        words: dict[str, list[int]] = {}
        for batch in batches:
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("mark").to_pylist()):
                for word in text.lower().split():
                    words.setdefault(word, [0] * len(marks))[mark] += 1
            if len(words) > 200_000:
                yield from grams(words)
                words = {}
        yield from grams(words)

    def grams(words):
        names = list(words)
        for at in range(0, len(names), 50_000):
            some = names[at:at + 50_000]
            x, predicted = padded(some)
            place, keys = np.flatnonzero(predicted), gram_keys(x)
            counts = np.repeat(np.array([words[w] for w in some]), [len(w) + 1 for w in some], axis=0)
            for n, key in enumerate(keys, 1):
                prefix = before(keys[n - 2])[place] if n > 1 else np.zeros(len(place), np.uint64)
                suffix = keys[n - 2][place] if n > 1 else np.zeros(len(place), np.uint64)
                kinds, first, inverse = np.unique(key[place], return_index=True, return_inverse=True)
                sums = [np.bincount(inverse, counts[:, k]).astype(np.int64) for k in range(len(marks))]
                columns = [np.full(len(kinds), n, np.int32), *(c.view(np.int64) for c in (kinds, prefix[first], suffix[first])), *sums]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["n", "key", "prefix", "suffix", *marks])

    found = texts.mapInArrow(run, f"n INT, key LONG, prefix LONG, suffix LONG, {', '.join(f'{mark} LONG' for mark in marks)}")
    return found.groupBy("n", "key", "prefix", "suffix").agg(*[F.sum(mark).alias(mark) for mark in marks])


@dataclass
class Tables:
    """Both classes' models as a table of all n-grams that were learned, with their counts."""

    counts: DataFrame

    def ratios(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of toxic less ordinary, characters predicted) of each word; for few words."""
        if not words:
            return np.zeros(0), np.zeros(0)
        x, predicted = padded(words)
        ends = np.flatnonzero(predicted)
        keys = top_keys(x)[ends].view(np.int64).tolist()
        given = dict(zip(characters(x[ends[:, None] + np.arange(1 - ORDER, 1)]), keys))
        asked = self.counts.sparkSession.createDataFrame(list(given.items()), "gram STRING, key LONG")
        known = self.counts.unionByName(asked, allowMissingColumns=True).groupBy("gram", "key")
        sums = known.agg(*[F.coalesce(F.sum(f"n{kind}"), F.lit(0)).alias(f"n{kind}") for kind in range(KINDS)])
        found = log_ratios(materialize(sums, "counts")).join(F.broadcast(asked.select("key")), "key", "left_semi")
        ratios = dict(found.select("key", "r0").collect())
        lengths = np.array([len(w) + 1 for w in words])
        return np.add.reduceat(np.array([ratios[key] for key in keys]), np.cumsum(lengths) - lengths), lengths


def logistic(rows: DataFrame, columns: list[str], y: str, weights: dict[int, float], penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights of a penalised logistic regression, the last one the constant, and what its columns are divided by). By Newton's
    method; each step is one aggregate of all rows. ``weights`` are those of rows by ``y``."""
    told = rows.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(name).alias(name) for name in columns]).first()
    scale = np.array([told[name] for name in columns]) + 1e-9
    x = [*(F.col(name) / float(by) for name, by in zip(columns, scale)), F.lit(1.0)]
    places = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    weight = F.when(F.col(y) == 1, float(weights[1])).otherwise(float(weights[0]))
    w = np.zeros(len(x))
    ridge = np.diag([penalty] * len(columns) + [1e-6]) * told["n"]
    for _ in range(50):
        p = chance(x, w)
        sums = [F.sum(weight * (p - F.col(y)) * some) for some in x]
        sums += [F.sum(weight * p * (1 - p) * x[i] * x[j]) for i, j in places]
        sums = np.array(rows.agg(*sums).first(), float)
        slope, bend = sums[:len(x)] + ridge @ w, ridge.copy()
        for (i, j), value in zip(places, sums[len(x):]):
            bend[i, j] += value
            if i != j:
                bend[j, i] += value
        step = np.linalg.solve(bend, slope)
        w -= step.clip(-5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, scale


def chance(x: list[Column], w: np.ndarray) -> Column:
    """The probability that a logistic regression gives."""
    total = sum((some * float(by) for some, by in zip(x[1:], w[1:])), x[0] * float(w[0]))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def plain_texts(docs: DataFrame, id_column: str | None, text_column: str) -> DataFrame:
    """id, text, and what tells which texts are equal; half of a text to learn from goes by its id and text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    ids = F.col(id_column) if id_column else F.lit(None).cast("long")
    plain = docs.select(ids.alias("id"), text.alias("text"), digest_of(text_column).alias("digest"))
    half = F.pmod(F.xxhash64(F.col("id").cast("long"), F.xxhash64("text"), F.lit(7)), F.lit(2)).cast("int")
    return plain.withColumn("half", half)


def digest_of(text_column: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_column), F.lit(""))))


@dataclass
class Judge:
    """The two models and what turns ratios into a probability; the texts that they were learned from have theirs already."""

    model: Tables | None
    weights: np.ndarray
    scale: np.ndarray
    docs: DataFrame | None = None
    text_column: str | None = None
    found: DataFrame | None = None

    def scores(self, docs: DataFrame, text_column: str) -> DataFrame:
        """id, digest and score of each row."""
        found = self.found
        if docs is not self.docs or text_column != self.text_column:
            found, _ = features(stored_texts(plain_texts(docs, None, text_column)), learned=self.model.counts)
        x = [*(F.col(name) / float(by) for name, by in zip(("mean", "most"), self.scale)), F.lit(1.0)]
        return found.select("id", "digest", chance(x, self.weights).alias("score"))


def learn(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic", sample: int | None = None,
          folds: int = FOLDS, held_out: int = HELD_OUT) -> Judge:
    """Learns from all labelled rows whose crc32 isn't held out, also if one id is on many rows. A caller may ask for a
    ``sample`` of at most so many rows per class.

    The models count all n-grams of these rows. The weights of the two ratios come from ratios that each half of
    them gets from models of the other half, so no text is judged by its own counts; these are counts of the same pass, kept
    apart by half. All of it stays in tables; only sums go to the driver. With labels of one class only, every score is their
    share.
    """
    known = labels.filter(F.col(label).isin(0, 1) & (remainder(id_column, folds) != held_out))
    sizes = dict(known.groupBy(label).count().collect())
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    alone = Judge(None, np.array([share]), np.ones(2))
    if len(sizes) < 2:
        return alone
    stored = stored_texts(plain_texts(docs, id_column, text_column))
    marks = known.select(F.col(id_column).cast("long").alias("__id"), F.col(label).cast("int").alias("mark")).distinct()
    texts = stored.filter("place IS NOT NULL").select("block", "place", F.col("id").cast("long").alias("__id"), "digest", "half").filter("__id IS NOT NULL")
    marked = spread_join(texts, marks, ["__id"], spread_by=["block", "place"])
    if sample is not None:
        # Those with the lowest hashes; rows that are alike in all of it have the same text.
        marked = marked.withColumn("order", F.bitwise_not(F.xxhash64("__id", F.lit(4))))
        marked = newest_per(marked, ["mark"], ["order", "__id", "digest", "block", "place"], sample)
    number = [F.coalesce(F.sum((F.col("mark") == mark).cast("int")), F.lit(0)).alias(str(mark)) for mark in (0, 1)]
    marked, told = materialize_measured(marked.select("block", "place", "half", "mark"), "marked", *number)
    if not (told["0"] and told["1"]):
        return alone
    found, counts = features(stored, marked=marked)
    rows = found.filter("marks > 0").select("cross_mean", "cross_most", F.explode(F.expr("filter(array(0, 1), v -> (marks & (v + 1)) > 0)")).alias("mark"))
    # Classes count as much as they do among the labels.
    n = told["0"] + told["1"]
    weights, scale = logistic(rows, ["cross_mean", "cross_most"], "mark", {0: (1 - share) * n / told["0"], 1: share * n / told["1"]})
    return Judge(Tables(counts), weights, scale, docs, text_column, found)


def with_score(docs: DataFrame, judge: Judge, name: str, text_column: str = "text") -> DataFrame:
    """``docs`` with the toxicity of each text, from 0 to 1, in a column ``name``."""
    if judge.model is None:
        return docs.withColumn(name, F.lit(float(judge.weights[-1])))
    digest = unused(docs, "digest")
    scores = judge.scores(docs, text_column).groupBy(F.col("digest").alias(digest)).agg(F.min("score").alias(name))
    return spread_join(docs.withColumn(digest, digest_of(text_column)), materialize(scores, "scores"), [digest], "left").drop(digest)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD,
             folds: int = FOLDS, held_out: int = HELD_OUT, **options) -> DataFrame:
    """Per row: its id, held_out (its label wasn't learned from), score (higher: more toxic), predicted.

    Null and empty texts have ratios of 0. A null id isn't held out. Repeated rows stay; an empty table gives no rows.
    Labels that are null or neither 0 nor 1 and other columns are ignored. Words are split at white space, in lower case.
    """
    judge = learn(docs, labels, id_column=id_column, text_column=text_column, folds=folds, held_out=held_out, **options)
    if judge.model is None:
        scored = docs.select(F.col(id_column), F.lit(float(judge.weights[-1])).alias("score"))
    else:
        scored = judge.scores(docs, text_column).select(F.col("id").alias(id_column), "score")
    return scored.select(
        id_column, F.coalesce(remainder(id_column, folds) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
