import random

import numpy as np

from tidegate.llm.decontaminate import Index, budget, codes, gram_hashes, leaked_documents, normal, windows

SCHEMA = "doc_id LONG, text STRING, found STRING, more INT"


def fewest_edits(window, text):
    """Sellers' algorithm over the whole text, one cell after the other."""
    column = list(range(len(window) + 1))
    best = column[-1]
    for char in text:
        before, column[0] = column[0], 0
        for i, other in enumerate(window, 1):
            before, column[i] = column[i], min(before + (char != other), column[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


def brute(docs, items, q=12, window=64, edits=4):
    out = []
    for key, text in docs:
        found = {}
        for item, passage in items:
            x = normal(passage)
            if not x:
                continue
            size = min(window, len(x))
            n = min(fewest_edits(x[s:s + size], normal(text or "")) for s in range(windows(len(x), window)))
            if n <= budget(size, q, window, edits):
                found[item] = n
        out.append((key, bool(found), len(found), min(found.values(), default=None), sorted(found)))
    return out


def test_documents_against_full_alignment(spark):
    chance = random.Random(6)
    words = ["the", "and", "of", "tion", "ing", "ere", "hath", "é", "on"]
    speak = lambda n: " ".join("".join(chance.choices(words, k=chance.randint(1, 3))) for _ in range(n))

    def spoil(text, n):
        text = list(text)
        for _ in range(n):
            at = chance.randrange(len(text))
            text[at:at + chance.choice([0, 1, 1])] = chance.choice(["", "x", "y", "zz"][:3])
        return "".join(text)

    items = [(i, speak(chance.choice([3, 4, 6, 12, 20]))) for i in range(8)] + [(20, "short"), (21, "")]
    docs = [(0, speak(40)), (1, None), (2, ""), (3, "short"), (4, items[2][1])]
    for i in range(5, 40):
        passage = chance.choice(items[:8])[1]
        cut = passage[chance.randint(0, 10):]
        docs.append((i, speak(10) + "\n" + spoil(cut.upper() if i % 5 == 0 else cut, chance.choice([0, 1, 3, 4, 5, 8])) + " " + speak(10)))
    table = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], SCHEMA)
    bench = spark.createDataFrame([*items, (None, "x" * 80), (30, None), items[0]], "item_id LONG, text STRING")
    want = brute(docs, items)
    assert 15 < sum(r[1] for r in want) < 36
    assert any(r[0] == 3 and r[1] for r in want)
    for size in (1_000_000, 100):
        got = sorted(leaked_documents(table, bench, size=size).collect())
        assert [tuple(r) for r in got] == want


def test_no_window_is_lost_within_its_edits():
    """Passages of exactly one window from any place of an item, with as many edits as are allowed."""
    chance = random.Random(8)
    item = "".join(chance.choices("abcdefghij klmnop", k=400)).strip()
    item = normal(item)
    index = Index([1, 2], [codes(item), codes("elevenchars")], 12, 64, 4)
    for edits in range(5):
        for start in range(0, len(item) - 64, 7):
            passage = list(item[start:start + 64])
            for at in chance.sample(range(64), edits):
                passage[at] = chance.choice("QXYZ").lower() if chance.random() < 0.7 else ""
            text = "zz " * 9 + "".join(passage) + " yy" * 9
            want = min(fewest_edits(item[s:s + 64], normal(text)) for s in range(max(0, start - 5), min(start + 6, len(item) - 63)))
            found = index.search([text])[0]
            assert want > 4 or found == {0: found[0]} and found[0] <= want, (edits, start)
    assert index.search(["so elevenchars it is", "eleven chars", "x" * 300_000 + " elevenchars"]) == [{1: 0}, {}, {1: 0}]


def test_empty_tables_null_and_repeated_ids(spark):
    table = spark.createDataFrame([(None, "a" * 100, "x", 1), (1, "b", "x", 1), (1, "b", "x", 1)], SCHEMA)
    bench = spark.createDataFrame([(1, "a" * 70)], "item_id LONG, text STRING")
    got = sorted(map(tuple, leaked_documents(table, bench).collect()), key=lambda r: r[1])
    assert got == [(1, False, 0, None, []), (1, False, 0, None, []), (None, True, 1, 0, [1])]
    assert leaked_documents(table.limit(0), bench).count() == 0
    assert [r.n_items for r in leaked_documents(table, bench.limit(0)).collect()] == [0, 0, 0]


def test_hashes_of_any_length_tell_runs_apart():
    x = codes("abcabcabcabd" * 5)
    for q in (1, 2, 3, 5, 8, 12, 13):
        hashes = gram_hashes(x, q)
        runs = [tuple(x[i:i + q]) for i in range(len(x) - q + 1)]
        assert len(hashes) == len(runs) and len(set(hashes.tolist())) == len(set(runs))
        assert all((hashes[i] == hashes[0]) == (run == runs[0]) for i, run in enumerate(runs))
    assert len(gram_hashes(np.zeros(3, "<u4"), 4)) == 0
