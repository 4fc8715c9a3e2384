import math

import numpy as np
import pytest

from tidegate.llm.vectors import enough, near_vectors, shape

SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>, links STRING, size INT"


def brute(rows, cosine=0.9):
    good = {}
    for key, x in rows:
        v = np.array([] if x is None or None in x else x, float)
        norm = math.sqrt(float(v @ v)) if len(v) and np.isfinite(v).all() else 0
        if norm:
            good[key] = v / norm
    ids = sorted(good)
    links, up = {key: 0 for key, _ in rows}, {key: key for key, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((key, links[key], root(key), root(key) == key) for key, _ in rows)


def made(seed, clusters, size, spread, dims=64):
    chance = np.random.default_rng(seed)
    out = []
    for _ in range(clusters):
        base = chance.standard_normal(dims)
        base /= np.linalg.norm(base)
        for _ in range(size):
            out.append(base + chance.standard_normal(dims) * spread / math.sqrt(dims))
    out += list(chance.standard_normal((400, dims)))
    return [(i, x.tolist()) for i, x in enumerate(out)]


@pytest.mark.parametrize(("block", "spread"), [(2048, 0.15), (7, 0.2)])
def test_clusters_against_all_pairs(spark, block, spread):
    rows = made(1, 15, 25, spread)
    docs = spark.createDataFrame([(k, x, "x", 1) for k, x in rows], SCHEMA).repartition(4)
    assert sorted(tuple(r) for r in near_vectors(docs, block=block).collect()) == brute(rows)


def test_recall_at_the_threshold(spark):
    chance, rows = np.random.default_rng(3), []
    for i in range(600):
        x, y = np.linalg.qr(chance.standard_normal((64, 2)))[0].T
        rows += [(2 * i, x.tolist()), (2 * i + 1, (0.9001 * x + math.sqrt(1 - 0.9001**2) * y).tolist())]
    docs = spark.createDataFrame([(k, x, "x", 1) for k, x in rows], SCHEMA)
    got = sorted(tuple(r) for r in near_vectors(docs).collect())
    want = brute(rows)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.95 * all_links <= found <= all_links


def test_edge_cases(spark):
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [1.0, 0.0]), (2, None), (1, []), (7, [0.0, 0.0]), (8, [1.0, None]), (6, [float("nan"), 1.0]),
            (4, [float("inf"), 1.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e300, 1e299]), (13, [1e-200, 0.0])]
    docs = spark.createDataFrame([(k, x, "x", 1) for k, x in rows] + [(None, [1.0, 0.0], "x", 1)], SCHEMA)
    got = [tuple(r) for r in near_vectors(docs).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute([(k, [0, 0] if k == 0 else x) for k, x in rows if k not in (12, 13)] + [(12, [10.0, 1.0]), (13, [1.0, 0.0])])
    assert [r for r in got if r[0] is None] == [(None, 0, None, True)]
    assert near_vectors(docs.limit(0)).count() == 0


def test_parameters_follow_from_the_recall():
    signs, tables = shape(50_000, 0.9)
    assert signs == 10 and 1 - (1 - (1 - math.acos(0.9) / math.pi) ** signs) ** tables >= 0.98
    assert 16 < enough() < 28
