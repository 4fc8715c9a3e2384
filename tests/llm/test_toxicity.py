import math
import random
import zlib

import numpy as np
import pytest

from tidegate.llm.samples import texts_of
from tidegate.llm.toxicity import ORDER, SHARED, START, STOP, STRETCH, Features, Model, counted, learn, toxicity

INSULTS = ["grobian", "lumpix", "dolt"]


def plain_model(words, class_words):
    """Kneser-Ney straight from its definition, with dictionaries of strings."""
    def grams(some, n):
        out = {}
        for word in some:
            x = chr(START) * (ORDER - 1) + word + chr(STOP)
            for at in range(ORDER - 1, len(x)):
                out[x[at - n + 1:at + 1]] = out.get(x[at - n + 1:at + 1], 0) + 1
        return out

    def counts(n, own):
        if n == ORDER:
            return grams(own, n)
        seen = grams(words if n <= SHARED else own, n + 1)
        out = {}
        for gram in seen:
            out[gram[1:]] = out.get(gram[1:], 0) + 1
        return out

    tables = []
    for n in range(1, ORDER + 1):
        c = counts(n, class_words)
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        off = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.75
        total, kinds = {}, {}
        for gram, value in c.items():
            total[gram[:-1]] = total.get(gram[:-1], 0) + value
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
        tables.append((c, off, total, kinds))
    characters = len(grams(words, 1)) + 1

    def log_chance(word):
        x, out = chr(START) * (ORDER - 1) + word + chr(STOP), 0.0
        for at in range(ORDER - 1, len(x)):
            p = 1 / characters
            for n, (c, off, total, kinds) in enumerate(tables, 1):
                gram = x[at - n + 1:at + 1]
                if gram[:-1] in total:
                    p = max(c.get(gram, 0) - off, 0) / total[gram[:-1]] + off * kinds[gram[:-1]] / total[gram[:-1]] * p
            out += math.log(p)
        return out

    return log_chance


@pytest.fixture(scope="module")
def corpus():
    chance = random.Random(2)
    rows = []
    for key in range(900):
        toxic = key % 4 == 0
        words = ["".join(chance.choices(["ta", "ri", "mo", "len", "us"], k=chance.randint(1, 4))) for _ in range(chance.randint(10, 200))]
        if toxic:
            for _ in range(2):
                words[chance.randrange(len(words))] = chance.choice(INSULTS).upper() + chance.choice(["", ".", "us"])
        rows.append((key, " ".join(words), int(toxic)))
    return rows


def test_ratios_against_the_definition(spark, corpus):
    texts = spark.createDataFrame([(t, m) for _, t, m in corpus[:80]], "text STRING, mark INT").repartition(3)
    rows = counted(texts).toPandas()
    model = Model.of({n: rows[n].to_numpy().view(np.uint64) if n in ("key", "prefix", "suffix") else rows[n].to_numpy() for n in rows})
    words = [w for _, t, _ in corpus[:80] for w in t.lower().split()]
    per_class = [[w for _, t, m in corpus[:80] if m == k for w in t.lower().split()] for k in (0, 1)]
    toxic, ordinary = plain_model(words, per_class[1]), plain_model(words, per_class[0])
    tried = [*INSULTS, "unknown", "é", "tarimo", "x" * 40]
    ratios, lengths = model.ratios(tried)
    assert lengths.tolist() == [len(w) + 1 for w in tried]
    assert np.allclose(ratios, [toxic(w) - ordinary(w) for w in tried], rtol=1e-4, atol=1e-4)
    text = " ".join(tried)
    mean, most = Features(model)([text])[0]
    n = len(tried)
    best = max(ratios[i:i + STRETCH].sum() / lengths[i:i + STRETCH].sum() for i in range(n - STRETCH + 1))
    assert math.isclose(mean, ratios.sum() / lengths.sum()) and math.isclose(most, best)
    assert Features(model)(["", " \n"]).tolist() == [[0, 0], [0, 0]]


def test_held_out_documents(spark, corpus):
    docs = spark.createDataFrame([(k, t, "x", 2) for k, t, _ in corpus], "doc_id LONG, text STRING, score STRING, predicted INT")
    labels = spark.createDataFrame([(k, m) for k, _, m in corpus], "doc_id LONG, toxic INT")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == len(corpus)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, _ in corpus)
    right = [got[k].predicted == m for k, _, m in corpus if got[k].held_out]
    assert sum(right) > 0.97 * len(right)
    # Labels of held-out rows change nothing.
    turned = spark.createDataFrame([(k, 1 - m if got[k].held_out else m) for k, _, m in corpus], "doc_id LONG, toxic INT")
    again = {r.doc_id: r.score for r in toxicity(docs, turned).collect()}
    assert all(math.isclose(again[k], got[k].score, rel_tol=1e-9) for k in got)


def test_edge_cases(spark, corpus):
    schema = "doc_id LONG, text STRING"
    docs = spark.createDataFrame([(None, "ta ri"), (1, None), (1, None), (2, ""), (3, "w" * 100_000)], schema)
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7), (None, 1)], "doc_id LONG, toxic INT")
    got = toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_all_n_grams_of_the_sample_are_counted(spark, corpus):
    """The learned models are those of the definition over the whole sample, words that occur once included."""
    rows = [(k, t, m) for k, t, m in corpus[:120] if zlib.crc32(str(k).encode()) % 3 != 1]
    rows.append((5000, "raraavis " + rows[0][1], 1))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id LONG, text STRING").repartition(3)
    judge = learn(docs, spark.createDataFrame([(k, m) for k, _, m in rows], "doc_id LONG, toxic INT"), held_out=7)
    words = [[w for _, t, m in rows if m == mark for w in t.lower().split()] for mark in (0, 1)]
    ordinary, toxic = (plain_model(words[0] + words[1], some) for some in words)
    tried = ["raraavis", "avis", *INSULTS, "unknown", "tarimo"]
    assert np.allclose(judge.model.ratios(tried)[0], [toxic(w) - ordinary(w) for w in tried], rtol=1e-4, atol=1e-4)


def test_one_label_of_a_class_is_enough(spark, corpus):
    docs = spark.createDataFrame([(k, t) for k, t, _ in corpus[:300]], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(k, int(k == 4)) for k, _, _ in corpus[:300]], "doc_id LONG, toxic INT")
    scores = {r.score for r in toxicity(docs, labels, held_out=7).collect()}
    assert len(scores) > 200 and all(0 <= s <= 1 for s in scores)


def test_the_sample_is_bounded_in_rows(spark, corpus):
    """One id on most rows."""
    rows = [(0 if k % 3 else k, t) for k, t, _ in corpus]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    marked = spark.createDataFrame([(0, 0), (3, 0), (6, 1)], "id LONG, mark INT")
    got = texts_of(docs, marked, "doc_id", "text", 10, 4).groupBy("mark").count().collect()
    assert {r["mark"]: r["count"] for r in got} == {0: 10, 1: 1}
    again = [sorted(texts_of(docs.repartition(n), marked, "doc_id", "text", 10, 4).collect()) for n in (1, 5)]
    assert again[0] == again[1]
