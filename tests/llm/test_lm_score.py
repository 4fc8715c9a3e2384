import math
import random
from collections import Counter

import pytest

from tidegate.llm.lm_score import ADDED, UNIGRAMS, cross_entropy_difference

SCHEMA = "doc_id LONG, text STRING, score STRING, n_words STRING"


def brute(rows, wanted, vocabulary, classes):
    split = [(key, (text or "").lower().split()) for key, text in rows]
    counts = Counter(w for _, words in split for w in words if len(w) <= 64)
    known = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:vocabulary]
    own = set(known[:classes])

    def model(docs):
        one = Counter(w if w in known else None for _, words in docs for w in words)
        total = sum(one.values()) + ADDED * (len(known) + 1)
        p = {w: (one[w] + ADDED) / total for w in [*known, None]}
        shared = sum(v for w, v in p.items() if w not in own)
        pairs, histories = Counter(), Counter()
        for _, words in docs:
            before = "start"
            for w in words:
                kind = w if w in own else "rest"
                pairs[before, kind] += 1
                histories[before] += 1
                before = kind
        return p, shared, pairs, histories

    out = []
    for key, words in split:
        others = [d for d in split if d[1] != words]
        losses = []
        for docs in ([d for d in others if d[0] in wanted], others):
            p, shared, pairs, histories = model(docs)
            loss, before = 0.0, "start"
            for w in words:
                kind = w if w in own else "rest"
                base = p[w] if w in own else shared
                chance = (pairs[before, kind] + UNIGRAMS * base) / (histories[before] + UNIGRAMS)
                if kind == "rest":
                    chance *= p[w if w in known else None] / shared
                loss -= math.log(chance)
                before = kind
            losses.append(loss / len(words) if words else 0.0)
        out.append((key, len(words), *losses, losses[0] - losses[1]))
    return out


def key_of(row):
    return (row[0] is None, row[0] or 0, row[1], row[2])


@pytest.mark.parametrize(("vocabulary", "classes"), [(30, 8), (30, 100), (10_000, 5)])
def test_losses_against_the_definition(spark, vocabulary, classes):
    chance = random.Random(1)
    made = [f"w{int(chance.paretovariate(0.7)) % 60}" for _ in range(4000)]
    rows = [(i, " ".join(made[i * 40:i * 40 + chance.randint(0, 40)]).upper()) for i in range(100)] + [(200, "x" * 100 + " y"), (201, None), (None, "w1 w2"), (3, "w1"), (3, "w1")]
    wanted = [2, 3, 5, 8, 13, 21, 34, 55, 200, 9999, 3]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA).repartition(4)
    ids = spark.createDataFrame([(k,) for k in wanted] + [(None,)], "doc_id LONG")
    got = sorted((tuple(r) for r in cross_entropy_difference(docs, ids, vocabulary=vocabulary, classes=classes).collect()), key=key_of)
    want = sorted(brute(rows, set(wanted), vocabulary, classes), key=key_of)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g[2:], w[2:]))


def test_wanted_kind_scores_lower_and_empty_tables(spark):
    chance = random.Random(2)
    rows = [(i, " ".join(chance.choices(["a", "b", "c"] if i % 2 else ["a", "d", "e"], k=60))) for i in range(80)]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)
    ids = spark.createDataFrame([(k,) for k in range(1, 40, 2)], "doc_id LONG")
    got = {r.doc_id: r.score for r in cross_entropy_difference(docs, ids).collect()}
    assert max(got[k] for k in range(41, 80, 2)) < min(got[k] for k in range(40, 80, 2))
    assert cross_entropy_difference(docs.limit(0), ids).count() == 0
    assert cross_entropy_difference(docs, ids.limit(0)).count() == 80


def counted(texts):
    """Words, pairs and histories of texts."""
    one = Counter(w for words in texts for w in words)
    pairs = Counter(p for words in texts for p in zip([None, *words], words))
    return one, pairs, Counter(h for words in texts for h in [None, *words][:len(words)])


def test_all_words_and_pairs_have_counts_of_their_own(spark, monkeypatch):
    import tidegate.llm.lm_score as module

    chance = random.Random(3)
    rare = [f"rare{i}" for i in range(2000)]
    rows = [(i, " ".join(chance.sample(rare, 30))) for i in range(300)] + [(900, "x" * 100 + " " + "y" * 100), (901, "y" * 100 + " " + "x" * 100), (902, None)]
    # More frequent words than the classes that models once had, so that the pairs of rare ones were lost.
    rows += [(1000 + i, " ".join(f"often{j}" for j in range(i % 7, 1200))) for i in range(25)]
    wanted = {*range(0, 300, 3), 900}
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA).repartition(4)
    ids = spark.createDataFrame([(k,) for k in wanted], "doc_id LONG")
    split = [(key, (text or "").split()) for key, text in rows]
    size = len({w for _, words in split for w in words}) + 1
    loss = {}
    for name in "tb":
        mine = [words for key, words in split if name == "b" or key in wanted]
        one, pairs, before = counted(mine)
        for key, words in split:
            left = counted([some for some in mine if some == words])
            total = sum(one.values()) - sum(left[0].values()) + ADDED * size
            each = []
            for h, w in zip([None, *words], words):
                alone = (one[w] - left[0][w] + ADDED) / total
                each.append(math.log((pairs[h, w] - left[1][h, w] + UNIGRAMS * alone) / (before[h] - left[2][h] + UNIGRAMS)))
            loss[key, name] = -sum(each) / max(1, len(words))
    for block in (2_000, 32_000_000):
        monkeypatch.setattr(module, "BLOCK", block, raising=False)
        monkeypatch.setattr(module, "SLICE", 1_000, raising=False)
        monkeypatch.setattr(module, "RANGE", block // 8)
        got = cross_entropy_difference(docs, ids).collect()
        assert len(got) == len(rows)
        for r in got:
            assert math.isclose(r.target_loss, loss[r.doc_id, "t"], rel_tol=1e-9), r
            assert math.isclose(r.background_loss, loss[r.doc_id, "b"], rel_tol=1e-9), r


def test_scores_tell_nothing_of_random_marks_and_twins_score_alike(spark):
    chance = random.Random(4)
    texts = [" ".join(f"w{chance.randrange(3000)}" for _ in range(80)) for _ in range(400)]
    rows = list(enumerate(texts)) + [(1000 + i, f"  {texts[i].upper()} ") for i in range(10)]
    wanted = set(chance.sample(range(400), 200)) - set(range(5)) | set(range(5, 10))
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA).repartition(3)
    ids = spark.createDataFrame([(k,) for k in wanted], "doc_id LONG")
    got = {r.doc_id: r.score for r in cross_entropy_difference(docs, ids).collect()}
    marked = sorted(got[k] for k in range(10, 400) if k in wanted)
    others = sorted(got[k] for k in range(10, 400) if k not in wanted)
    # The share of pairs in which a wanted document scores lower would be 1 if its own counts were in.
    lower = sum(a < b for a in marked for b in others) / (len(marked) * len(others))
    assert 0.4 < lower < 0.6
    assert all(math.isclose(got[i], got[1000 + i], rel_tol=1e-9) for i in range(10))


def test_empty_texts_alone_and_one_very_long_text(spark):
    rows = [(i, " " if i % 2 else None) for i in range(50)] + [(100, "a b " * 300_000), (101, "a b a b")]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)
    ids = spark.createDataFrame([(100,), (3,)], "doc_id LONG")
    got = {r.doc_id: r for r in cross_entropy_difference(docs, ids).collect()}
    assert len(got) == 52 and got[100].n_words == 600_000
    assert all(got[k].score == got[k].n_words == 0 for k in range(50))
    assert got[101].target_loss < got[100].target_loss
    assert cross_entropy_difference(docs.filter("doc_id < 50"), ids).filter("score = 0").count() == 50
