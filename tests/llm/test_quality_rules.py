import re

from tidegate.llm.quality_rules import BASE, BULLETS, CUTS, MEASURES, RULES, STOP_WORDS, Rule, quality_rules

SPACE = " \t\n\x0b\f\r"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    got = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_stop_words": sum(word.lower() in STOP_WORDS for word in words),
        "n_letter_words": sum(any(c.isalpha() for c in word) for word in words),
        "n_bullet_lines": sum(line.lstrip(SPACE).startswith(BULLETS) for line in lines),
        "n_cut_lines": sum(line.rstrip(SPACE).endswith(CUTS) for line in lines),
    }

    def fails(rule):
        value, per = got[rule.measure] * (100 if rule.per else 1), got[rule.per] if rule.per else 1
        return (rule.least is not None and value < rule.least * per) or (rule.most is not None and value > rule.most * per)

    failed = [rule.name for rule in [*BASE, *RULES] if fails(rule)]
    return (*[got[name] for name in MEASURES], any(fails(rule) for rule in BASE), not failed, failed)


TEXTS = [
    None, "", " \t\r\n\x0b\f", "one", "a b", "a b c", "a b c a b c", "x x x x", "x x x x x", "a b c d a b c e b c d", "é ü 漢字 😀 x😀",
    "# a\n# a\r\n# a\n\n \n# a", "- a\n* b\n • c...\nd… \ne", "| ".join("the words of a table and more".split()) * 12, "1 2 3 " * 30 + "the of",
    "the quick brown fox and the lazy dog met in a field of corn, " * 2 + " ".join(f"word{i} of" for i in range(60)),
    " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} the" for i in range(9000)), "y " * 30_000, "z" * 300_000,
    "ß É\x1cq \x00 \x85 w", "a b c\na b c\x0ba b c",
]


def test_measures_and_verdicts(spark):
    rows = [(i % 9 if i else None, text, "x", "y", "z") for i, text in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_words STRING, id STRING, content STRING").repartition(3)
    got = sorted((tuple(r) for r in quality_rules(docs).collect()), key=repr)
    assert got == sorted(((key, *brute(text)) for key, text, *_ in rows), key=repr)


def test_rules_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a #"), (3, "")], "n LONG, body STRING")
    rules = [Rule("short", "n_words", least=2), Rule("symbols", "n_symbols", "n_words", most=50), Rule("none", "n_symbols", "n_words", most=49)]
    out = quality_rules(docs, id_column="n", text_column="body", base=[], rules=rules).select("n", "base_failed", "kept", "failed")
    assert sorted(tuple(r) for r in out.collect()) == [(1, False, True, []), (2, False, False, ["none"]), (3, False, False, ["short"])]
    assert quality_rules(docs.limit(0), id_column="n", text_column="body").count() == 0


def test_one_projection_without_user_functions(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id LONG, text STRING")
    plan = quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
