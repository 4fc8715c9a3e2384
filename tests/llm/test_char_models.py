import math
import random

import numpy as np
import pyarrow as pa
import pytest

import tidegate.llm.char_models as module
from tests.llm.test_toxicity import plain_model
from tidegate.llm.char_models import STRETCH, Block, Writer, stored_texts, text_features
from tidegate.llm.toxicity import Tables, learn, plain_texts, toxicity, with_score


def words_by_class(rows):
    return [[w for _, text, mark in rows if mark == k for w in text.lower().split()] for k in (0, 1)]


def test_all_labelled_rows_are_learned(spark):
    """More rows than a sample of 4,000 per class had; most words occur in one row only."""
    chance = random.Random(5)
    rows = [(key, "".join(chance.choices("abcdefg", k=4)) + f" {'n' if key % 2 else 't'}{key:05d}", (key + 1) % 2) for key in range(9000)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id LONG, text STRING").repartition(4)
    judge = learn(docs, spark.createDataFrame([(k, m) for k, _, m in rows], "doc_id LONG, toxic INT"), held_out=7)
    ordinary, toxic = words_by_class(rows)
    ordinary, toxic = plain_model(ordinary + toxic, ordinary), plain_model(ordinary + toxic, toxic)
    tried = [text.split()[1] for _, text, _ in chance.sample(rows, 40)] + ["n12345", "other"]
    ratios, lengths = judge.model.ratios(tried)
    assert np.allclose(ratios, [toxic(w) - ordinary(w) for w in tried], rtol=1e-4, atol=1e-4) and lengths.tolist() == [len(w) + 1 for w in tried]
    stops = judge.model.counts.filter("gram LIKE '%\x03'").selectExpr("sum(n0 + n2)", "sum(n1 + n3)").first()
    assert tuple(stops) == (9000, 9000)


def test_a_sample_may_be_asked_for(spark):
    docs = spark.createDataFrame([(k % 60, f"w{k}") for k in range(100)], "doc_id LONG, text STRING").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id LONG, toxic INT")
    kept = []
    for some in (docs, docs.repartition(5)):
        counts = learn(some, labels, held_out=7, sample=10).model.counts
        assert tuple(counts.filter("gram LIKE '%\x03'").selectExpr("sum(n0 + n2)", "sum(n1 + n3)").first()) == (10, 10)
        kept.append(sorted(counts.selectExpr("gram", "n0 + n2", "n1 + n3").filter("`(n0 + n2)` + `(n1 + n3)` > 0").collect()))
    assert kept[0] == kept[1]


@pytest.mark.parametrize(("block", "distinct", "span"), [(16_000_000, 3_000_000, 1 << 22), (2_000, 3_000_000, 700), (16_000_000, 50, 100)])
def test_small_blocks_and_ranges(spark, monkeypatch, block, distinct, span):
    """The models that judge, the half of each text and rows of all kinds, however texts are dealt over blocks."""
    for name, value in (("BLOCK", block), ("DISTINCT", distinct), ("RANGE", span), ("MERGED", span), ("SLICE", min(block, 1_000))):
        monkeypatch.setattr(module, name, value)
    chance = random.Random(6)
    rows = [(k, " ".join("".join(chance.choices("aeioué\U0001f600\x00", k=chance.randint(1, 6))) for _ in range(chance.randint(0, 30))), k % 3 == 0) for k in range(120)]
    schema = "doc_id LONG, text STRING, mark INT"
    docs = spark.createDataFrame([(k, t, int(m)) for k, t, m in rows], schema).repartition(3)
    # Some ids have both labels, and some labels have no text.
    labels = spark.createDataFrame([(k, int(m)) for k, _, m in rows] + [(1, 1), (3, 0), (999, 1)], "doc_id LONG, toxic INT")
    judge = learn(docs, labels, held_out=7)
    halves = {r.id: r.half for r in plain_texts(docs, "doc_id", "text").select("id", "half").collect()}
    known = [(k, t, int(m)) for k, t, m in rows] + [(1, rows[1][1], 1), (3, rows[3][1], 0)]

    def expected(some, text):
        ordinary, toxic = words_by_class(some)
        ordinary, toxic = plain_model(ordinary + toxic, ordinary), plain_model(ordinary + toxic, toxic)
        words = text.lower().split()
        ratios, lengths = [toxic(w) - ordinary(w) for w in words], [len(w) + 1 for w in words]
        if not words:
            return [0, 0]
        size = min(STRETCH, len(words))
        return [sum(ratios) / sum(lengths), max(sum(ratios[i:i + size]) / sum(lengths[i:i + size]) for i in range(len(words) - size + 1))]

    found = {r.id: r for r in judge.found.collect()}
    assert len(found) == len(rows)
    assert [found[k].marks for k in (0, 1, 2, 3)] == [2, 3, 1, 3]
    for key in (0, 1, 3, 17, 50, 119):
        text, got = rows[key][1], found[key]
        assert np.allclose([got.mean, got.most], expected(known, text), rtol=1e-4, atol=1e-4)
        others = [row for row in known if halves[row[0]] != halves[key]]
        assert np.allclose([got.cross_mean, got.cross_most], expected(others, text), rtol=1e-4, atol=1e-4)


def test_other_documents_than_the_learned_ones(spark):
    chance = random.Random(7)
    rows = [(k, " ".join(chance.choices(["grob", "dolt", "a"] if k % 2 else ["fine", "a", "good"], k=9)), k % 2) for k in range(80)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(k, m) for k, _, m in rows], "doc_id LONG, toxic INT")
    judge = learn(docs, labels)
    want = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    other = [(rows[5][1], "x", b"1"), (rows[5][1], "x", b"1"), (rows[8][1], "y", b"2"), (None, None, None), ("neverseen", "z", b"")]
    frame = spark.createDataFrame(other, "body STRING, digest STRING, block BINARY")
    got = with_score(frame, judge, "score", "body")
    assert got.columns == ["body", "digest", "block", "score"]
    scores = {(r.body, r.digest): r.score for r in got.collect()}
    assert got.count() == 5 and all(0 <= s <= 1 for s in scores.values())
    assert math.isclose(scores[rows[5][1], "x"], want[5], rel_tol=1e-6) and math.isclose(scores[rows[8][1], "y"], want[8], rel_tol=1e-6)
    same = {r.doc_id: r.score for r in with_score(docs, judge, "score").collect()}
    assert all(math.isclose(same[k], want[k], rel_tol=1e-9) for k in want)


def test_texts_without_words(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "")], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id LONG, toxic INT")
    got = toxicity(docs, labels, held_out=7).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1


def test_models_of_no_words(spark):
    assert [len(some) for some in Tables(spark.createDataFrame([], "gram STRING, key LONG, n0 LONG, n1 LONG, n2 LONG, n3 LONG")).ratios([])] == [0, 0]


def test_pieces_of_a_block(monkeypatch):
    monkeypatch.setattr(module, "WORDS", 70)
    monkeypatch.setattr(module, "NAMES", 60)
    chance = random.Random(8)
    texts = [" ".join(f"w{chance.randrange(60)}" for _ in range(chance.randint(0, 40))) for _ in range(30)] + ["", "x" * 500]
    writer = Writer()
    for text in texts:
        writer.add(text)
    rows = pa.table(writer.packed(), names=list(Writer.COLUMNS))
    assert rows.num_rows > 5
    block = Block(rows.take(pa.array(chance.sample(range(rows.num_rows), rows.num_rows))))
    assert block.sizes.tolist() == [len(text.split()) for text in texts] and len(block.words) == block.sizes.sum()
    assert block.lengths[block.words].tolist() == [len(w) + 1 for text in texts for w in text.split()]
    # Each n-gram's own place as its ratio: words of equal n-grams are equal.
    assert len(block.places) == block.lengths.sum() and np.array_equal(block.keys[block.places], np.concatenate([one_word(w) for w in names_of(block, texts)]))


def names_of(block, texts):
    """The distinct words by number."""
    flat, out = [w for text in texts for w in text.split()], {}
    for number, word in zip(block.words.tolist(), flat):
        assert out.setdefault(number, word) == word
    return [out[number] for number in range(len(out))]


def one_word(word):
    x, predicted = module.padded([word])
    return module.top_keys(x)[predicted]


def test_features_of_texts():
    chance = np.random.default_rng(9)
    sizes = np.array([0, 1, 5, 6, 7, 0, 30, 2, 0])
    ratios, lengths = chance.normal(size=sizes.sum()), chance.integers(2, 9, sizes.sum())
    got, at = text_features(ratios, lengths, sizes), 0
    for size, (mean, most) in zip(sizes, got):
        r, n = ratios[at:at + size], lengths[at:at + size]
        at += size
        if size:
            w = min(STRETCH, size)
            assert math.isclose(mean, r.sum() / n.sum()) and math.isclose(most, max(r[i:i + w].sum() / n[i:i + w].sum() for i in range(size - w + 1)))
        else:
            assert (mean, most) == (0, 0)


def test_blocks_are_not_shuffled(spark):
    docs = spark.createDataFrame([(k, f"w{k}") for k in range(50)], "doc_id LONG, text STRING").repartition(4)
    stored = stored_texts(plain_texts(docs, "doc_id", "text"))
    plan = stored.groupBy("block").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not spark.sql("SHOW TABLES").filter("tableName LIKE 'bucketed%'").count()
