"""Text quality from positive and unlabelled documents: a linear model with non-negative unbiased risk.

Trusted positives are documents labelled as good, unlabelled ones any documents. With a class prior pi, the risk of
calling a positive bad is taken off the risk of calling unlabelled text bad, and kept from falling below zero, which
overfitting would do. The prior is estimated from how much rarer high scores are in unlabelled text than in positives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import computed
from .samples import remainder, some_ids, texts_of

# Documents in the samples of positives and of unlabelled text.
SAMPLE = 8000
THRESHOLD, FOLDS, HELD_OUT = 0.3, 5, 0
STEPS, RATE, PENALTY = 400, 0.05, 1e-4

# Kinds of bytes: lower case and letters beyond ASCII, upper case, digits, space, line ends, marks.
MARKS = ".,!?|#*&%$-'\""
KINDS = 6 + len(MARKS)
TABLE = np.full(256, KINDS - 1, np.uint8)
TABLE[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 0
TABLE[range(ord("A"), ord("Z") + 1)] = 1
TABLE[range(ord("0"), ord("9") + 1)] = 2
TABLE[[ord(" "), 9]] = 3
TABLE[[10, 11, 12, 13]] = 4
for _place, _mark in enumerate(MARKS, 5):
    TABLE[ord(_mark)] = _place
WIDTH = KINDS + KINDS * KINDS + 5


def features(texts: list[str]) -> np.ndarray:
    """Shares of kinds of bytes and of their pairs, repeated neighbours and other words, word length, length; zeros
    for a text without bytes."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts):
        data = text.encode("utf-8", "replace")
        if not data:
            continue
        kinds = TABLE[np.frombuffer(data, np.uint8)]
        row[:KINDS] = np.bincount(kinds, minlength=KINDS) / len(kinds)
        pairs = kinds[:-1].astype(np.uint16) * KINDS + kinds[1:]
        row[KINDS:KINDS + KINDS * KINDS] = np.bincount(pairs, minlength=KINDS * KINDS) / len(kinds)
        words = text.split()
        if words:
            same = sum(map(str.__eq__, words, words[1:]))
            row[-5:-1] = same / len(words), len(set(words)) / len(words), len(data) / len(words) / 20, len(set(words)) / len(words) ** 0.75 / 3
        row[-1] = np.log1p(len(data)) / 10
    out[:, :KINDS + KINDS * KINDS] = np.log1p(200 * out[:, :KINDS + KINDS * KINDS])
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z.clip(-30, 30)))


def descend(slope, size: int, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Adam from zero; ``slope`` answers the gradient at a point."""
    w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        g = slope(w)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w = w - rate / (1 + 3 * step / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def apart(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """A plain model that tells positives from unlabelled text."""
    def slope(w):
        p, u = sigmoid(positive @ w), sigmoid(unlabelled @ w)
        return (positive.T @ (p - 1)) / len(p) + (unlabelled.T @ u) / len(u) + PENALTY * w

    return descend(slope, positive.shape[1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled text: the smallest ratio of the two shares above a score, over scores that a
    fifth of the positives reach, with a margin for chance. Scores come from a model that the texts weren't used for."""
    ratios = []
    for side in (0, 1):
        w = apart(positive[side::2], unlabelled[side::2])
        p, u = np.sort(positive[1 - side::2] @ w), np.sort(unlabelled[1 - side::2] @ w)
        if not len(p) or not len(u):
            return 0.5
        above_p = 1 - np.arange(len(p)) / len(p)
        above_u = 1 - np.searchsorted(u, p) / len(u)
        used = above_p >= 0.2
        spread = np.sqrt(above_u * (1 - above_u) / len(u) + above_p * (1 - above_p) / len(p))
        at = np.argmin((above_u[used] + spread[used]) / above_p[used])
        ratios.append(above_u[used][at] / above_p[used][at])
    return float(np.clip(np.mean(ratios), 0.01, 0.99))


def risk_parts(positive: np.ndarray, unlabelled: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of positives, unbiased risk of negatives) with the logistic loss."""
    loss = lambda z: np.logaddexp(0, -z)
    z, u = positive @ w, unlabelled @ w
    return prior * loss(z).mean(), loss(-u).mean() - prior * loss(-z).mean()


def non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Minimises prior * risk(positive as good) + max(0, risk(unlabelled as bad) - prior * risk(positive as bad)). Where the
    second part is below zero, its slope is followed the other way, up to zero."""
    def slope(w):
        p, u = sigmoid(positive @ w), sigmoid(unlabelled @ w)
        good = prior * (positive.T @ (p - 1)) / len(p)
        bad = (unlabelled.T @ u) / len(u) - prior * (positive.T @ p) / len(p)
        return (good + bad if risk_parts(positive, unlabelled, w, prior)[1] >= 0 else -bad) + PENALTY * w

    return descend(slope, positive.shape[1])


@dataclass
class Judge:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(scaled(x, self.mean, self.scale) @ self.weights)


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([((x - mean) / scale).clip(-6, 6), np.ones(len(x))])


def learn(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", sample: int = SAMPLE,
          folds: int = FOLDS, held_out: int = HELD_OUT) -> Judge:
    """Learns from at most ``sample`` rows of positives and ``sample`` rows of any kind, none of them held out, also if one
    id is on many rows; negative labels aren't used. Their features, some kilobytes a document, go to the driver. Without positives every score is
    0, without other documents 1."""
    free = remainder(id_column, folds) != held_out
    marked = some_ids(labels.filter((F.col(label) == 1) & free), id_column, sample, 9).withColumn("mark", F.lit(1))
    marked = marked.unionByName(some_ids(docs.filter(free), id_column, sample, 10).withColumn("mark", F.lit(0)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = features(part.column("text").to_pylist())
                rows = pa.array([row.tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), rows], names=["id", "mark", "x"])

    found = texts_of(docs, marked, id_column, text_column, sample, 9).select("id", "mark", "text").mapInArrow(run, "id LONG, mark INT, x BINARY").toPandas()
    found = found.sort_values(["mark", "id", "x"])
    x = np.array([np.frombuffer(data, np.float32) for data in found["x"]], float).reshape(-1, WIDTH)
    mark = found["mark"].to_numpy()
    if not (mark == 1).any() or not (mark == 0).any():
        return Judge(np.r_[np.zeros(WIDTH), 30.0 if (mark == 1).any() else -30.0], np.zeros(WIDTH), np.ones(WIDTH), float((mark == 1).any()))
    mean, scale = x[mark == 0].mean(axis=0), x[mark == 0].std(axis=0) + 1e-3
    # The order of ids must not decide who is in which half.
    turn = np.random.default_rng(1).permutation(len(x))
    x, mark = scaled(x, mean, scale)[turn], mark[turn]
    positive, unlabelled = x[mark == 1], x[mark == 0]
    prior = class_prior(positive, unlabelled)
    return Judge(non_negative(positive, unlabelled, prior), mean, scale, prior)


def with_score(docs: DataFrame, judge: Judge, name: str, text_column: str = "text") -> DataFrame:
    """``docs`` with the quality of each text, from 0 to 1, in a column ``name``."""

    def start():
        def make(texts):
            scores = [judge.score(features(texts[at:at + 512])) for at in range(0, len(texts), 512)]
            return [pa.array(np.concatenate([*scores, np.zeros(0)]), pa.float64())]

        return make

    return computed(docs, text_column, [T.StructField(name, T.DoubleType())], start)


def quality(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD,
            folds: int = FOLDS, held_out: int = HELD_OUT, **options) -> DataFrame:
    """Per row: its id, held_out (its label wasn't learned from), score (higher: better), predicted.

    Null and empty texts have features of zero. A null id isn't held out. Repeated rows stay; an empty table gives no
    rows. Other columns are ignored.
    """
    judge = learn(docs, labels, id_column=id_column, text_column=text_column, folds=folds, held_out=held_out, **options)
    scored = with_score(docs.select(F.col(id_column), F.col(text_column).alias("text")), judge, "score")
    return scored.select(
        id_column, F.coalesce(remainder(id_column, folds) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
