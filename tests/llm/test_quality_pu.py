import math
import random
import zlib

import numpy as np
import pytest

from tidegate.llm.quality_pu import WIDTH, class_prior, features, non_negative, quality, risk_parts


@pytest.fixture(scope="module")
def corpus():
    chance, rows = random.Random(3), []
    for key in range(800):
        good = key % 5 != 0
        words = ["".join(chance.choices(["ta", "ri", "mo", "len", "us"], k=chance.randint(1, 4))) for _ in range(chance.randint(20, 200))]
        if not good:
            words = chance.choice([lambda w: [x.upper() + "!!" for x in w], lambda w: [x for x in w[:20] for _ in range(8)],
                                   lambda w: [x + chance.choice(["###", "$$$"]) for x in w]])(words)
        rows.append((key, " ".join(words).capitalize() + "." if good else " ".join(words), int(good)))
    return rows


def test_held_out_documents(spark, corpus):
    docs = spark.createDataFrame([(k, t, "x", 2) for k, t, _ in corpus], "doc_id LONG, text STRING, score STRING, predicted INT")
    labels = spark.createDataFrame([(k, m) for k, _, m in corpus if k % 2], "doc_id LONG, quality INT")
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert len(got) == len(corpus)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in corpus)
    right = [got[k].predicted == m for k, _, m in corpus if got[k].held_out]
    assert sum(right) > 0.95 * len(right)
    turned = spark.createDataFrame([(k, 1 - m if got[k].held_out else m) for k, _, m in corpus if k % 2], "doc_id LONG, quality INT")
    again = {r.doc_id: r.score for r in quality(docs, turned).collect()}
    assert all(math.isclose(again[k], got[k].score, rel_tol=1e-9) for k in got)


def test_prior_and_risk():
    chance = np.random.default_rng(5)
    make = lambda n, at: np.column_stack([chance.normal(at, 1, n), chance.normal(0, 1, n), np.ones(n)])
    positive, unlabelled = make(4000, 2), np.concatenate([make(2800, 2), make(1200, -2)])
    prior = class_prior(positive, unlabelled)
    assert abs(prior - 0.7) < 0.06
    w = non_negative(positive, unlabelled, prior)
    good, bad = make(2000, 2) @ w > 0, make(2000, -2) @ w > 0
    assert good.mean() > 0.93 and bad.mean() < 0.07
    assert risk_parts(positive, unlabelled, w, prior)[1] > -0.05


def test_features_of_odd_texts():
    x = features(["", " \n", "a", "A" * 100_000, "\ud800 x", "same same same"])
    assert x.shape == (6, WIDTH) and np.isfinite(x).all() and not x[0].any()
    assert math.isclose(x[5][-5], 2 / 3, rel_tol=1e-6)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "ta ri"), (1, None), (1, None), (2, ""), (3, "w" * 100_000)], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7), (None, 1)], "doc_id LONG, quality INT")
    got = quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality(docs.limit(0), labels).count() == 0
    assert all(r.score < 1e-9 for r in quality(docs, labels.limit(0)).collect())
