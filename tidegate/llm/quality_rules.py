"""Quality rules: a table of thresholds becomes one projection of ratios.

Each row of the table bounds one measure against another (symbols per word, stop words per word, repeated lines per line).
Measures and rules are SQL functions alone: a text is cut into words and lines once, every row is judged where it is
read, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on was as this by at are from "
    "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als "
    "de la le et les en des un du une que est pour qui dans au sur par pas avec "
    "el y los se del las por con no para su es al lo"
).split()
# Characters that are symbols, and what starts a list item or ends a cut line.
SYMBOLS, BULLETS, CUTS = "#*$%&|<>", ("-", "*", "•", "‣", "●"), ("...", "…")
# White space that parts words.
SPACE = " \t\n\x0b\f\r"
BLANK = "[ \\t-\\r]+"


@dataclass(frozen=True)
class Rule:
    """A measure per hundred of another must lie in [least, most]; a bound that is None is open."""

    name: str
    measure: str
    per: str | None = None
    least: int | None = None
    most: int | None = None

    def holds(self) -> str:
        """The rule as an SQL condition on whole numbers, the same in Spark and elsewhere."""
        value = f"100 * {self.measure}" if self.per else self.measure
        bounds = [(self.least, ">="), (self.most, "<=")]
        return " AND ".join(f"{value} {sign} {bound}" + (f" * {self.per}" if self.per else "") for bound, sign in bounds if bound is not None)


BASE = [
    Rule("few_words", "n_words", least=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=50),
]
RULES = [
    Rule("many_words", "n_words", most=1_000_000),
    Rule("word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("stop_word_share", "n_stop_words", "n_words", least=4),
    Rule("letters", "n_letter_words", "n_words", least=80),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=30),
    Rule("bullets", "n_bullet_lines", "n_lines", most=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=30),
]
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letter_words", "n_bullet_lines",
    "n_cut_lines",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _counted(values: str, condition: str) -> str:
    return f"size(filter({values}, v -> {condition}))"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` under a name: it is computed once, also where lambdas read it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """How many words lie in a window of three words that occurs twice or more.

    Equal windows have equal hashes, so a text whose hashes all differ has none. In other texts the windows themselves are
    sorted with their places, so that equal ones are neighbours; windows that overlap share words.
    """
    starts = "slice(x.words, 1, greatest(size(x.words) - 2, 0))"
    hashes = f"array_distinct(transform({starts}, (w, i) -> xxhash64(w, x.words[i + 1], x.words[i + 2])))"
    windows = f"sort_array(transform({starts}, (w, i) -> struct(concat_ws(' ', w, x.words[i + 1], x.words[i + 2]) AS k, i AS i)))"
    found = """sort_array(transform(filter(transform(s, (e, j) -> struct(e.i AS i,
        (j > 0 AND s[greatest(j - 1, 0)].k = e.k) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].k = e.k) AS again)), e -> e.again), e -> e.i))"""
    gaps = "aggregate(transform(r, (p, j) -> IF(j = size(r) - 1, 3, least(3, r[least(j + 1, size(r) - 1)] - p))), 0, (a, b) -> a + b)"
    return f"IF(size({hashes}) = greatest(size(x.words) - 2, 0), 0, {_bound(windows, 's', _bound(found, 'r', gaps))})"


def measures(text: str) -> Column:
    """array<struct<MEASURES>> with one element, from an SQL expression of a text."""
    words = f"array_remove(split(t, {_quoted(BLANK)}), '')"
    lines = f"filter(split(t, '\\n'), v -> btrim(v, {_quoted(SPACE)}) != '')"
    starts = " OR ".join(f"startswith(trim(LEADING {_quoted(SPACE)} FROM v), {_quoted(mark)})" for mark in BULLETS)
    ends = " OR ".join(f"endswith(trim(TRAILING {_quoted(SPACE)} FROM v), {_quoted(mark)})" for mark in CUTS)
    stops = ", ".join(_quoted(word) for word in STOP_WORDS)
    fields = {
        "n_words": "size(x.words)",
        "word_chars": "char_length(array_join(x.words, ''))",
        "n_symbols": f"char_length(regexp_replace(x.t, {_quoted(f'[^{SYMBOLS}]+')}, ''))",
        "n_lines": "size(x.lines)",
        "n_dup_lines": "size(x.lines) - size(array_distinct(x.lines))",
        "n_repeat_words": _repeat_words(),
        "n_stop_words": _counted("x.words", f"lower(v) IN ({stops})"),
        "n_letter_words": _counted("x.words", "v RLIKE '\\\\p{L}'"),
        "n_bullet_lines": _counted("x.lines", starts),
        "n_cut_lines": _counted("x.lines", ends),
    }
    row = ", ".join(f"CAST({value} AS BIGINT) AS {name}" for name, value in fields.items())
    return F.expr(f"transform(transform(array(coalesce({text}, '')), t -> struct(t AS t, {words} AS words, {lines} AS lines)), x -> struct({row}))")


def quality_rules(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", base: list[Rule] = BASE,
                  rules: list[Rule] = RULES) -> DataFrame:
    """Per row: its id, the MEASURES, base_failed (a rule of ``base`` fails), kept (no rule fails), failed (their names).

    Words are runs of anything but the six ASCII spaces; a word, a line or a text may be of any length. A null or empty
    text has no words and measures of 0; a ratio over 0 holds when its measure is 0. Null and repeated ids and repeated
    texts are judged row by row. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    named = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("content"))
    # inline keeps the optimizer from computing a measure again for each rule that reads it.
    measured = named.select("id", F.inline(measures("content")))
    judged = [(rule, F.expr(rule.holds())) for rule in [*base, *rules]]
    fails = [F.when(~holds, F.lit(rule.name)) for rule, holds in judged]
    base_failed = F.lit(False)
    for _, holds in judged[:len(base)]:
        base_failed = base_failed | ~holds
    failed = F.filter(F.array(F.lit(None).cast("string"), *fails), lambda name: name.isNotNull())
    out = measured.select("id", *MEASURES, base_failed.alias("base_failed"), failed.alias("failed"))
    return out.select(F.col("id").alias(id_column), *MEASURES, "base_failed", (F.size("failed") == 0).alias("kept"), "failed")
