import math

import numpy as np
import pytest

from tidegate.llm.hard_negatives import hard_negatives, matrix, packed, strassen

SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>, label INT, id STRING, task STRING, strip INT, part INT, size STRING"


def brute(rows, every=100, positives=5, negatives=10, window=(30, 90)):
    """The definition in plain integers."""
    held = {}
    for key, vector, label in rows:
        if key is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in whole) < 2**56:
            held[key] = min(held.get(key, (label, len(whole), whole)), (label, len(whole), whole))
    out = []
    for anchor, (kind, size, x) in held.items():
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), key, label) for key, (label, length, y) in held.items() if length == size)
        for score, positive, _ in [s for s in scored if s[2] == kind and s[1] != anchor][:positives]:
            inside = [s for s in scored if s[2] != kind and window[0] * -score <= 100 * -s[0] <= window[1] * -score]
            out += [(anchor, positive, rank + 1, key, -score, -other) for rank, (other, key, _) in enumerate(inside[:negatives])]
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*row, "x", "y", 1, 2, "z") for row in rows], SCHEMA).repartition(parts)


def made(seed, n, dims, labels, spread=0.3):
    chance = np.random.default_rng(seed)
    centres = chance.standard_normal((7, dims))
    return [(i, (centres[i % 7] + spread * chance.standard_normal(dims)).tolist(), int(chance.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 18, 19), (64, 64, 64), (33, 70, 129), (5, 0, 4), (0, 8, 40), (100, 37, 1)])
def test_strassen_is_exact(shape):
    chance = np.random.default_rng(2)
    a = chance.integers(-2**27, 2**27, shape[:2])
    b = chance.integers(-2**27, 2**27, shape[1:])
    want = (a.astype(object) @ b.astype(object)).astype(np.int64) if shape[1] else np.zeros((shape[0], shape[2]), np.int64)
    assert (strassen(a, b, 4) == want).all() and (strassen(a, b) == want).all()


def test_sums_that_wrap_give_exact_products():
    a, b = np.full((20, 20), 2**62), np.zeros((20, 20), np.int64)
    b[0] = 1
    assert (strassen(a, b, 2) == 2**62).all()


def test_packing_keeps_numbers():
    vectors = [np.array(v, np.int64) for v in ([1, -2], [2**15, 0], [2**31, -5], [-2**15, 3])]
    assert matrix([packed(v) for v in vectors], 2).tolist() == [v.tolist() for v in vectors]


@pytest.mark.parametrize(("strip", "group"), [(16384, None), (3, 40)])
def test_against_all_pairs(spark, strip, group):
    rows = made(1, 900, 12, 4)
    got = hard_negatives(frame(spark, rows), strip=strip, group=group, anchors_every=20)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_ties_and_one_label_on_most_rows(spark):
    chance = np.random.default_rng(4)
    rows = [(i, chance.integers(0, 3, 3).astype(float).tolist(), 1 if i % 3 else int(chance.integers(50))) for i in range(600)]
    got = hard_negatives(frame(spark, rows), strip=4, group=50, anchors_every=25, negatives=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 25, negatives=3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(5, 300, 6, 3) + [
        (400, None, 1), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (600, [nan] * 6, 1), (700, [inf] * 6, 2), (800, [1.0] * 6, None), (None, [1.0] * 6, 1),
        (900, [], 1), (901, [], 1), (902, [], 2), (1000, [1.0, 2.0], 1), (1001, [1.0, 2.0], 1), (1002, [0.5, 1.0], 0), (1100, [1e300] * 6, 1), (1101, [1e5] * 6, 1),
        (1200, [0.0] * 6, 1), (100, [9.0] * 6, 0), (100, [9.0] * 6, 0), (1300, [-1e-9] * 6, 2), (-100, [0.3] * 6, 0), (-7, [0.2] * 6, 1),
    ]
    got = sorted(tuple(r) for r in hard_negatives(frame(spark, rows)).collect())
    assert got == brute(rows) and {100, -100, 900, 1000} <= {r[0] for r in got}
    assert hard_negatives(frame(spark, rows).limit(0)).count() == 0
    assert hard_negatives(frame(spark, rows[:1])).count() == 0
