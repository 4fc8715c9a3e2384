import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from tidegate.llm.token_counts import Counter, token_counts, whole_tokens
from tidegate.llm.tokens import Encoder, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\x85", "\x1c", "​", "　", "\r\n", "﻿", " the", "a", "é", "日本", "'s", "12", "!", "<|endoftext|>", "%%%"]


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(5)
    made = ["".join(chance.choice(PARTS) for _ in range(chance.randint(0, 15))) for _ in range(3000)]
    return [*made, "x" * 5000, "ab " * 3000, ""]


def test_ids_and_counts_are_those_of_the_library(texts):
    tok, mine, counter = tokenizer(PATH), Encoder(PATH), Counter(PATH, whole_tokens(PATH))
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, mine.encode(pa.array(texts))):
            want = tok.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want
            assert counter.count(text) == len(want)


class Seen:
    """A tokenizer that notes the length of what it gets in each call."""

    def __init__(self, tok):
        self.tok, self.calls = tok, []

    def encode_batch_fast(self, texts, **options):
        self.calls.append(sum(map(len, texts)))
        return self.tok.encode_batch_fast(texts, **options)


def test_new_words_go_to_the_library_once_and_in_small_calls():
    tok, mine = tokenizer(PATH), Encoder(PATH)
    mine.tok = seen = Seen(mine.tok)
    texts = ["a " + " ".join(f"w{i * j}x," for i in range(6000)) + end for j, end in ((1, ""), (7, "  b \n "), (1, " "))]
    for text, ids in zip(texts, mine.encode(pa.array(texts))):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    # A call of 100,000 characters took half as long again as 25 of 4,000.
    assert max(seen.calls) < 5000 and sum(seen.calls) > 80_000
    seen.calls.clear()
    for text, ids in zip(texts, mine.encode(pa.array(texts))):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    assert sum(seen.calls) < 10


def test_ids_are_put_together_for_few_pieces_at_once():
    mine, texts = Encoder(PATH), pa.array([f"start{i}" + " the cat sat on a mat" * 500 for i in range(400)])
    tracemalloc.start()
    found = mine.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tok = tokenizer(PATH)
    assert all(found[i].tolist() == tok.encode(texts[i].as_py(), add_special_tokens=False).ids for i in (0, 1, 37, 399))
    # 1.2 million pieces in 4 MB: places and ids took 3.3 bytes a byte of text, with all put together at once 11.4.
    assert most < 6 * texts.nbytes


def test_another_kind_of_tokenizer_is_used_as_it_is():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, mine = tokenizer(path), Encoder(path)
    assert whole_tokens(path) == frozenset()
    for text in ("Some  words", "", "A<|endoftext|>b"):
        assert mine.encode(pa.array([text]))[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_counts_of_a_table(spark, texts):
    rows = [(i if i % 7 else None, text, "x") for i, text in enumerate(texts[:50])] + [(1, None, "y"), (1, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_bytes STRING")
    tok = tokenizer(PATH)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    got = [tuple(r) for r in token_counts(docs, PATH, limit=5).collect()]
    assert sorted(got, key=key) == sorted([(*w, w[2] > 5) for w in want], key=key)
    assert token_counts(docs.limit(0), PATH).count() == 0
