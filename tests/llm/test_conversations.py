import hashlib
import random
import zlib

import pytest

from tidegate.llm import conversations
from tidegate.llm.conversations import CUT, GOES, cheapest, damaged, every_conversation, repair_conversations, repair_digests

SPACE = " \t\n\x0b\f\r"
# The grammar as a machine: what follows each initial.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def machine(rows):
    """(cost, audit) by the machine: rows are (initial, must go, truncated). No table, no lengths."""
    def insert(states):
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                for new in NEXT[state].replace("s", ""):
                    put(states, new, (cost + 3, audit + "I"))

    def put(states, state, value):
        states[state] = min(states.get(state, value), value)

    states = {"": (0, "")}
    for initial, goes, cut in rows:
        insert(states)
        after = {}
        for state, (cost, audit) in states.items():
            put(after, state, (cost + 4, audit + "D"))
            if not goes:
                for new in NEXT[state]:
                    if new == initial:
                        put(after, new, (cost + 3 * cut, audit + "K"))
                    elif new != "s":
                        put(after, new, (cost + 3 + 3 * cut, audit + "R"))
        states = after
    insert(states)
    return min(value for state, value in states.items() if state in ("", "a"))


def encoded(rows):
    return bytes(("sua".find(initial) if initial in "sua" else 3) + (GOES if goes else 0) + (CUT if cut else 0) for initial, goes, cut in rows)


def some_rows(chance, n):
    rows = []
    for i in range(n):
        goes = chance.random() < 0.2
        rows.append((chance.choice("suaux" if chance.random() < 0.5 else "ua"), goes, not goes and chance.random() < 0.2))
    return rows


@pytest.mark.parametrize("cells", [conversations.CELLS, 60])
def test_cheapest_against_the_machine(monkeypatch, cells):
    monkeypatch.setattr(conversations, "CELLS", cells)
    chance = random.Random(7)
    for n in [0, 1, 2, 3, 4, 5, 6, 7] * 120 + [40, 150]:
        rows = some_rows(chance, n)
        assert cheapest(encoded(rows)) == machine(rows), rows


def test_every_short_conversation():
    kinds = [(initial, goes, cut) for initial in "suax" for goes, cut in ((0, 0), (0, 1), (1, 0))]
    for a in kinds:
        for b in kinds:
            for rows in ([a], [a, b], [a, b, a], [b, a, a, b]):
                assert cheapest(encoded(rows)) == machine(rows), rows


def test_a_long_conversation():
    chance = random.Random(3)
    rows = [("ua"[i % 2], False, False) for i in range(4000)]
    for _ in range(300):
        rows.pop(chance.randrange(len(rows)))
    assert cheapest(encoded(rows)) == machine(rows)


def brute(rows):
    """The contract for one conversation's rows after the damage: (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged = set(), []
    for turn, role, text in rows:
        body = text.rstrip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", fault))
    cost, audit = machine([j[:3] for j in judged])
    turns = {r[0] for r in rows} - {None}
    out, at, state = [], 0, ""
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        initial = judged[at][0] if letter == "K" else NEXT[state][-1]
        role = rows[at][1] if letter == "K" else {"u": "user", "a": "assistant"}[initial]
        out.append(f"{role}:{'' if letter == 'I' else rows[at][2]}")
        state, at = initial, at + (letter != "I")
    faults = [j[3] for j in judged]
    pairs = [a[0] + b[0] for a, b in zip(judged, judged[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(pair not in ("su", "ua", "au") for pair in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        share = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if share == 1 else text.translate({ord(c): None for c in ".!?"}) if share == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if share == 4 else role, text)] * (0 if share == 0 else 2 if share == 3 else 1))
    return out


def result(docs):
    out = every_conversation(docs, repair_digests(repair_conversations(damaged(docs))))
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert out.columns == columns
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_damage_and_repair(spark):
    chance, rows = random.Random(5), []
    texts = ["Hi.", "Well?", "No", "", " ", None, "So! \n", "x" * 200_000 + ".", "Long, ß 漢😀.", "…", "a.\x85", "b.\x1c"]
    for conv in [*range(120), None]:
        for turn in range(chance.choice([1, 1, 2, 5, 8, 40])):
            role = ("user", "assistant")[turn % 2] if chance.random() < 0.8 else chance.choice(["system", "", None, "User", "usher", "bot"])
            rows.append((conv, chance.choice([turn, turn, turn, None]) if chance.random() < 0.2 else turn, role, f"T{conv}-{turn}." if chance.random() < 0.7 else chance.choice(texts)))
    rows += rows[:30]
    schema = "conv_id LONG, turn LONG, role STRING, text STRING, audit STRING, share STRING, pass INT, place INT, step INT"
    docs = spark.createDataFrame([(*row, "x", "y", 1, 2, 3) for row in rows], schema).repartition(5)
    want = sorted(((conv, *brute(kept)) for conv, kept in after_damage(rows).items()), key=repr)
    assert result(docs) == want
    assert any(row[7] == "" for row in want) and result(docs.limit(0)) == []


def test_one_conversation_holds_most_rows(spark):
    rows = [(1, turn, ("user", "assistant")[turn % 2], f"turn {turn}.") for turn in range(1500)] + [(conv, 0, "user", "a.") for conv in range(2, 300)]
    docs = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")
    assert result(docs) == sorted(((conv, *brute(kept)) for conv, kept in after_damage(rows).items()), key=repr)


def test_the_operator_gives_the_edited_turns(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "user", "There."), ("a", 2, "user", "There."), ("a", 5, "assistant", "Yes")]
    out = repair_conversations(spark.createDataFrame(rows, "chat STRING, n INT, who STRING, said STRING"), conversation_column="chat",
                               turn_column="n", role_column="who", text_column="said").orderBy("step").collect()
    assert [(r["step"], r["edit"], r["turn"], r["role"], r["text"]) for r in out[1:]] == [
        (1, "K", 1, "user", "Hi."), (2, "I", None, "assistant", ""), (3, "K", 2, "user", "There."), (4, "D", 2, "user", "There."),
        (5, "K", 5, "assistant", "Yes")]
    assert tuple(out[0]) == ("a", 0, None, None, None, None, 2, 0, 1, 1, 2, 10, "KIKDK")
