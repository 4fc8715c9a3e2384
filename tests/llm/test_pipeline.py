import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_minhash import brute
from tidegate.llm import quality_pu, toxicity
from tidegate.llm.decontaminate import normal
from tidegate.llm.packing import cut
from tidegate.llm.queries import tokenizer_path
from tidegate.llm.tokens import tokenizer

SMALL = "/root/testdata/sf0.001"


def step(spark, docs, number, sf_dir=SMALL):
    return corpus_pipeline.materialize(corpus_pipeline.STAGES[number][1](spark, docs, sf_dir), "step")


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for number in range(5):
        out.append(step(spark, out[-1], number))
    return out


def test_every_stage_against_a_plainer_way(spark, stages):
    rows = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in stages[:5]]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(stages[0], labels).filter("predicted = 1").collect()}
    assert set(rows[0]) - set(rows[1]) == toxic
    poor = {r.doc_id for r in quality_pu.quality(stages[1], labels).filter("predicted = 0").collect()}
    assert set(rows[1]) - set(rows[2]) == poor
    assert set(rows[3]) == {r[0] for r in brute(sorted(rows[2].items()), 5, 80) if r[3]}
    passages = [normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    whole = {k for k, t in rows[3].items() if any(p in normal(t) for p in passages)}
    assert whole and whole <= set(rows[3]) - set(rows[4])
    assert all(s.columns == stages[0].columns for s in stages[:5])
    tok, want = tokenizer(tokenizer_path()), []
    for key, text in rows[4].items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        want += [(key, i, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for i, (s, n) in enumerate(cut(len(ids), 2048))]
    got = stages[5].collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)


def test_run_gives_the_last_stage(spark, stages):
    columns = ["doc_id", "piece", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, SMALL).select(columns).collect()) == sorted(stages[5].select(columns).collect())


def test_odd_rows_pass(spark):
    long = "one two three four five six seven"
    rows = [(None, long, 1), (None, long, 2), (1, None, 3), (1, None, 3), (2, "", 4), (3, long, 5), (4, long.upper(), 6), (4, "other words", 7)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, score INT")
    kept = step(spark, docs, 2)
    assert kept.columns == docs.columns
    # Repeated rows go, and so does the upper-case copy, though another text of its id stays.
    assert sorted(r.score for r in kept.collect()) == [1, 2, 3, 4, 5, 7]
    for number in (0, 1, 3):
        assert step(spark, docs, number).columns == docs.columns
    for number in range(5):
        assert step(spark, docs.limit(0), number).count() == 0


def test_a_clean_text_survives_a_near_copy_with_its_id(spark):
    one, other = [f"one{i}" for i in range(80)], [f"other{i}" for i in range(80)]
    rows = [(3, " ".join(one), 1), (7, " ".join([*one[:-1], "x"]), 2), (7, " ".join(other), 3), (9, " ".join([*other[:-1], "x"]), 4)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, score INT")
    kept = {r.score for r in step(spark, docs, 2).collect()}
    assert kept == {1, 3}
