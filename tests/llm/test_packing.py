import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.llm import packing
from tidegate.llm.packing import TEXTS, best_two_fit, cut, packed_documents, place
from tidegate.llm.tokens import tokenizer
from tidegate.scale import batch_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(1, 63), min_size=1, max_size=300))
@settings(max_examples=200, deadline=None)
def test_bins_hold_every_length_once_and_stay_near_the_bound(lengths):
    bins = best_two_fit(np.array(lengths), 64)
    assert sorted(x for b in bins for x in b) == sorted(lengths)
    assert all(0 < sum(b) <= 64 for b in bins)
    fewest = max(-(-sum(lengths) // 64), sum(x > 32 for x in lengths))
    assert len(bins) <= fewest * 1.25 + 1


def test_two_lengths_replace_the_smallest_when_they_fit_more_tightly():
    assert best_two_fit(np.array([60, 30, 25, 14]), 100)[0] == [60, 25, 14]


def test_places_leave_no_gap():
    lengths = np.random.default_rng(1).integers(1, 2048, 3000)
    sequence, offset = place(lengths, 2048)
    for number in np.unique(sequence):
        mine = np.flatnonzero(sequence == number)
        mine = mine[np.argsort(offset[mine])]
        assert offset[mine].tolist() == [0, *np.cumsum(lengths[mine])[:-1].tolist()]
        assert lengths[mine].sum() <= 2048


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (4, [(0, 4)]), (5, [(0, 1), (1, 4)]), (8, [(0, 4), (4, 4)])])
def test_only_the_first_piece_may_be_short(n, want):
    assert cut(n, 4) == want


def test_documents_against_the_library(spark):
    texts = ["", None, "the end", "a  b\n c", "<|endoftext|> x", "word " * 5000, "same", "same"]
    rows = [(None if i == 6 else i, text, 1.0, 2) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, length DOUBLE, offset INT")
    got = packed_documents(docs, PATH, group=3).collect()
    tok = tokenizer(PATH)
    want = []
    for i, text in enumerate(texts):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(cut(len(ids), 2048)):
            want.append((None if i == 6 else i, piece, start, length, zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())))
    key = lambda row: tuple((x is None, x or 0) for x in row[:3])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        assert [o for o, _ in sorted(places)] == [0, *np.cumsum([n for _, n in sorted(places)])[:-1].tolist()]
    assert packed_documents(docs.limit(0), PATH).count() == 0


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.materialize

    def noted(df, name):
        seen.append(spark.conf.get(key))
        return write(df, name)

    monkeypatch.setattr(packing, "materialize", noted)
    before = spark.conf.get(key)
    assert packed_documents(spark.createDataFrame([(1, "a b")], "doc_id LONG, text STRING"), PATH).count() == 1
    assert seen == [str(TEXTS)] and spark.conf.get(key) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    with pytest.raises(ZeroDivisionError), batch_rows(spark, 300):
        got = [r.n for r in spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n LONG").collect()]
        with batch_rows(spark, 1000):  # the fewer rows hold
            assert spark.conf.get(key) == "300"
        1 / 0
    assert max(got) == 300 and sum(got) == 1000 and spark.conf.get(key) == before
