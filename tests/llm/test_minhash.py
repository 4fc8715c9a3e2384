import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import minhash
from tidegate.llm.components import components
from tidegate.llm.minhash import FACTORS, MINIMA, digest_of_words, least_matches, minima, near_duplicates, packed, shingle_set, similar, words_of

SCHEMA = "doc_id LONG, text STRING, n INT, key STRING"


def brute(rows, width, percent):
    sets = [(key, shingle_set(words_of(text), width)) for key, text in rows]
    up = {key: key for key, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, one) in enumerate(sets):
        for b, other in sets[:i]:
            if similar(one, other, percent):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((key, len(found), root(key), root(key) == key) for key, found in sets)


def near_copies(seed, groups, size, words=60):
    chance = random.Random(seed)
    vocabulary = ["".join(chance.choices("abcdefgh", k=4)) for _ in range(900)]
    rows, key = [], 0
    for _ in range(groups):
        base = chance.choices(vocabulary, k=words)
        for _ in range(size):
            text = list(base)
            for _ in range(chance.choice([0, 1, 1, 2, 3, 4])):
                text[chance.randrange(words)] = chance.choice(vocabulary)
            rows.append((key, " ".join(text)))
            key += 1
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_all_pairs(spark, width):
    rows = near_copies(width, 12, 30) + [(1000 + i, f"{i} " * (i + 3)) for i in range(20)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in near_duplicates(docs, width=width).collect())
    assert got == brute(rows, width, 80)
    assert len({r[2] for r in got}) < len(rows) - 100


def test_edge_cases(spark):
    rows = [(4, "A b"), (2, "a\tB "), (7, ""), (3, None), (5, " \n"), (9, "one"), (8, "ONE"), (6, "É b"), (1, "é b")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows] + [(None, "a b", 1, "x"), (4, "A b", 1, "x")], SCHEMA)
    got = sorted(tuple(r) for r in near_duplicates(docs, width=2).collect() if r.doc_id is not None)
    assert got == [(1, 1, 1, True), (2, 1, 2, True), (3, 0, 3, True), (4, 1, 2, False), (4, 1, 2, False), (5, 0, 5, True), (6, 1, 6, True),
                   (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False)]
    lone = [tuple(r) for r in near_duplicates(docs, width=2).collect() if r.doc_id is None]
    assert lone == [(None, 1, None, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_bits_estimate_the_similarity():
    chance = np.random.default_rng(4)
    assert len(set(FACTORS.tolist())) == MINIMA
    common = chance.integers(0, 1 << 63, 800, dtype=np.uint64)
    for _ in range(20):
        sets = [np.concatenate([common, chance.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(2)]
        bits = packed(minima(sets))
        other = (bits[:, 0] ^ bits[:, 1]).view(np.uint64)
        equal = MINIMA - sum(bin(int((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))).count("1") for x in other)
        assert abs((equal / MINIMA - 0.25) / 0.75 - 0.8) < 0.2 and equal >= least_matches(80)
    assert 80 < least_matches(80) < MINIMA * 0.85


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1001 + i) for i in range(300)]
    links = spark.createDataFrame([*chain, *hub, (5, 5), (2000, 1999)], "a LONG, b LONG")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1301)} | {1999: 1999, 2000: 1999}
    assert components(links.limit(0)).count() == 0


def test_links_that_fit_a_task_need_no_round(spark, monkeypatch):
    import tidegate.llm.components as module

    written, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append(name) or write(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(500)], "a LONG, b LONG").repartition(7)
    assert {(r.id, r.component) for r in components(links).collect()} == {(i, 0) for i in range(501)}
    assert written == ["links", "forests"]


@pytest.mark.parametrize("task, held", [(20, 30), (60, 1000), (5000, 40)])
def test_components_of_more_links_than_a_task_holds(spark, monkeypatch, task, held):
    import tidegate.llm.components as module

    monkeypatch.setattr(module, "TASK", task)
    monkeypatch.setattr(module, "HELD", held)
    chance = random.Random(task)
    nodes = chance.sample(range(10_000), 700)
    links = [*zip(nodes[:150], nodes[1:151]), *((nodes[200], x) for x in nodes[201:400]), *(tuple(chance.sample(nodes[400:], 2)) for _ in range(140))]
    links += [(b, a) for a, b in links[:50]] + [(7, 7)]
    root = {x: x for pair in links[:-1] for x in pair}
    for _ in root:
        for a, b in links[:-1]:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(links, "a LONG, b LONG").repartition(6)
    got = components(frame).collect()
    assert len(got) == len(root) and {r.id: r.component for r in got} == root


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    import tidegate.llm.minhash as module

    rows = near_copies(8, 4, 60, words=40)
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], SCHEMA).repartition(5)
    for few, texts, block in ((4, 7, 16), (1000, 7, 2048)):
        monkeypatch.setattr(module, "FEW", few)
        monkeypatch.setattr(module, "TEXTS", texts)
        monkeypatch.setattr(module, "BLOCK", block)
        assert sorted(tuple(r) for r in near_duplicates(docs, width=2).collect()) == brute(rows, 2, 80)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    chance = random.Random(9)
    word = lambda: "".join(chance.choices("abcdefgh", k=5))
    one, other = [word() for _ in range(80)], [word() for _ in range(80)]
    near = lambda words: " ".join([*words[:-1], word()])
    rows = [(3, " ".join(one)), (7, near(one)), (7, " ".join(other)), (9, near(other)), (11, "some words"), (11, "Other  words"), (12, "other words"), (7, " ".join(other).upper())]
    docs = spark.createDataFrame([(k, t, i, "x") for i, (k, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(3, 3, True), (7, 3, False), (7, 7, True), (7, 7, True), (9, 7, False), (11, 11, True), (11, 11, True), (12, 11, False)]
    # Of near copies with one id, one is kept.
    twins = spark.createDataFrame([(5, " ".join(one), 1, "x"), (5, near(one), 1, "x"), (6, near(one), 1, "x"), (None, " ".join(one), 1, "x"), (None, near(one), 1, "x")], SCHEMA)
    got = near_duplicates(twins).collect()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    got = sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None)
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False)]
    chosen = near_duplicates(twins, choice=True).filter("doc_id IS NOT NULL").orderBy("doc_id", "chosen").collect()
    assert [(r.doc_id, r.chosen) for r in chosen] == [(5, False), (5, True), (6, False)]


def test_digests_by_sql_functions(spark):
    texts = [None, "", " \t\r\n\x0b\f ", "One  two\nÉ", "x", "\u00a0a\x1cb", "İ ſ K"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    mine = docs.select("doc_id", digest_of_words(F.col("text")).alias("digest"))
    assert sorted(mine.collect(), key=str) == sorted(near_duplicates(docs, choice=True).select("doc_id", "digest").collect(), key=str)


@pytest.mark.parametrize("few", [1, 64])
def test_pairs_are_found_though_nothing_was_proposed(spark, monkeypatch, few):
    import tidegate.llm.minhash as module

    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "proposals", lambda *_: spark.createDataFrame([], "id LONG, partner LONG"))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "other words")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in near_duplicates(docs).collect()) == brute(rows, 5, 80)


def test_heads_of_large_and_small_components(spark):
    """Nodes 0-199 are one component, 200-203 another, 204 is alone; the smallest class heads each, ties by digest."""
    of = {node: 0 if node < 200 else 200 for node in range(204)}
    rows = [(f"{(node * 37) % 205:03d}".encode(), 500 - node // 2, node) for node in range(205)]
    classes = spark.createDataFrame(rows, "digest binary, class long, node long")
    found = spark.createDataFrame(list(of.items()), "id long, component long")
    groups = {node: of.get(node, node) for node in range(205)}
    least = {g: min((c, d) for d, c, node in rows if groups[node] == g) for g in set(groups.values())}
    want = {d: least[groups[node]] for d, _, node in rows}
    got = {bytes(row["digest"]): (row["head"]["class"], bytes(row["head"]["digest"])) for row in minhash.headed(classes, found).collect()}
    assert got == want
    alone = minhash.headed(classes, None).collect()
    assert {bytes(row["digest"]): row["head"]["class"] for row in alone} == {d: c for d, c, _ in rows}
