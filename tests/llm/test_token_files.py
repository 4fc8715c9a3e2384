import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.llm.token_files import Table, blocks, decode_ids, encode_ids, pack_block, read_block, read_token_files, shares, write_token_files
from tidegate.llm.tokens import tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 40), max_size=400), st.sampled_from([1, 3, 8]), st.sampled_from([1, 4]))
@settings(max_examples=150, deadline=None)
def test_round_trip_from_every_checkpoint(ids, lanes, check):
    ids = np.array(ids, np.uint32)
    table = Table(shares(np.bincount(ids, minlength=41)))
    marks, words, points, count = encode_ids(ids, table, lanes, check)
    assert len(words) == 4 * count and len(marks) == points * (8 + 8 * lanes)
    for point in range(points):
        assert decode_ids(len(ids), table, marks, words, lanes, check, point).tolist() == ids[point * check * lanes:].tolist()


def test_shares_fill_the_table_and_keep_rare_ids():
    f = shares(np.array([10**12, 1, 0, 5]))
    assert f.sum() == 1 << 20 and (f > 0).tolist() == [True, True, False, True]


def test_size_is_near_the_entropy():
    chance = np.random.default_rng(2)
    ids = np.minimum(chance.geometric(0.05, 200_000), 500).astype(np.uint32)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    data = pack_block([(1, False, len(ids))], ids, Table(shares(counts)))
    assert len(data) < -(p * np.log2(p)).sum() * len(ids) / 8 + 16_000


def test_documents_run_over_blocks_and_damage_is_noticed():
    docs = [(None, np.arange(5)), (3, np.arange(23) % 7), (4, np.array([0])), (9, np.arange(8))]
    table = Table(shares(np.bincount(np.concatenate([d for _, d in docs]))))
    data = b"".join(b + b"\n" for b in blocks(iter(docs), table, 8))
    at, got, seen = 0, [], {}
    while at < len(data):
        segments, ids, at = read_block(memoryview(data), at, table)
        first = 0
        for key, null, more, _, n in segments.tolist():
            seen.setdefault(None if null else key, []).extend(ids[first:first + n].tolist())
            first += n
            got.append(more)
    assert seen == {k: d.tolist() for k, d in docs} and got.count(0) == len(docs)
    for place in range(0, len(data), 7):
        bad = bytearray(data)
        bad[place] ^= 255
        with pytest.raises((ValueError, IndexError, MemoryError)):
            at = 0
            while at < len(bad):
                _, _, at = read_block(memoryview(bad), at, table)
    with pytest.raises(ValueError):
        read_block(memoryview(data[:20]), 0, table)


def test_files_against_the_library(spark, tmp_path):
    texts = ["", None, "the end", "a  b\n c", "<|endoftext|> x", "word " * 9000, "same", "same"]
    docs = spark.createDataFrame([(i * 5 % 8, t, "x", 1) for i, t in enumerate(texts)], "doc_id LONG, text STRING, n STRING, ids INT").repartition(3)
    tok, target = tokenizer(PATH), str(tmp_path / "out")
    write_token_files(docs, PATH, target, per_file=4000)
    want, start = [], 0
    for key, text in sorted((r.doc_id, r.text) for r in docs.fillna("").collect()):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in read_token_files(spark, target).collect()) == want
    assert sum(name.startswith("part-") for name in os.listdir(f"{target}/blocks")) > 1


def test_empty_table_null_and_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (2, "c"), (2, "c"), (None, None)], "doc_id LONG, text STRING")
    write_token_files(docs, PATH, str(tmp_path / "some"))
    got = sorted(read_token_files(spark, str(tmp_path / "some")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 2, 2] and sum(r.n_tokens for r in got) == 7
    write_token_files(docs.limit(0), PATH, str(tmp_path / "none"))
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_files_stay_small_when_a_third_of_the_rows_are_equal(spark, tmp_path):
    rows = [(7 if i % 3 == 0 else i, "the same words" if i % 3 == 0 else f"text {i} of some") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    target = str(tmp_path / "out")
    write_token_files(docs, PATH, target, per_file=1000)
    got = sorted(read_token_files(spark, target).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted(k for k, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    sizes = sorted(f.stat().st_size for f in (tmp_path / "out" / "blocks").glob("part-*") if f.stat().st_size)
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]
