"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..scale import scratch_path
    from .token_files import read_token_files, write_token_files

    target = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), target)
    return read_token_files(spark, target)


@query
def op6_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..scale import scratch_path
    from .archive import read_archive, write_archive

    target = scratch_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), target)
    return read_archive(spark, target)


SQL["op6_content_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> ((3 - i % 4) * 5)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""


@query
def op1_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op2_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaked_documents

    return leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_pu import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import cross_entropy_difference

    wanted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), wanted)


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import MEASURES, quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


def _quality_rules_sql() -> str:
    from .quality_rules import BASE, BULLETS, CUTS, MEASURES, RULES, STOP_WORDS

    def either(function: str, line: str, marks: tuple[str, ...]) -> str:
        return " OR ".join(f"{function}({line}, '{mark}')" for mark in marks)

    stops = ", ".join(f"'{word}'" for word in STOP_WORDS)
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    base, all_rules = (" AND ".join(rule.holds() for rule in rules) for rules in (BASE, [*BASE, *RULES]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
      list_filter(string_split(text, chr(10)), lambda v: trim(v, {space}) <> '') AS l FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) FROM k WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  CAST(len(list_filter(w, lambda v: lower(v) IN ({stops}))) AS BIGINT) AS n_stop_words,
  CAST(len(list_filter(w, lambda v: regexp_matches(v, '\\p{{L}}'))) AS BIGINT) AS n_letter_words,
  CAST(len(list_filter(l, lambda v: {either('starts_with', f'ltrim(v, {space})', BULLETS)})) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(l, lambda v: {either('ends_with', f'rtrim(v, {space})', CUTS)})) AS BIGINT) AS n_cut_lines
  FROM t LEFT JOIN c USING (r))
SELECT doc_id, {', '.join(MEASURES)}, NOT ({base}) AS base_failed, {all_rules} AS kept FROM m"""


SQL["op12_quality_rules"] = _quality_rules_sql()


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, every_conversation, repair_conversations, repair_digests

    conversations = table(spark, sf_dir, "conversations")
    return every_conversation(conversations, repair_digests(repair_conversations(damaged(conversations))))


# crc32 bit by bit; the grammar as a machine whose states hold their cheapest audit (each row's edits after up to two
# insertions), one row of each conversation per round.
SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(key)),
    lambda j: CASE WHEN j % 8 = 0 THEN ascii(substr(key, (j // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT)),
    lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT)), 4294967295::BIGINT) % 20 AS share FROM k),
f AS (SELECT conv_id, turn, CASE share WHEN 4 THEN 'user' ELSE role END AS role,
  CASE share WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE share WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE share <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM f),
g AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS c,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
ins(q, r, letters) AS (VALUES ('', '', ''), ('', 'u', 'I'), ('', 'a', 'II'), ('s', 's', ''), ('s', 'u', 'I'), ('s', 'a', 'II'),
  ('u', 'u', ''), ('u', 'a', 'I'), ('a', 'a', ''), ('a', 'u', 'I')),
step(q, r) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
walk(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, '', {'cost': 0::BIGINT, 'audit': ''} FROM stats
  UNION ALL
  SELECT conv_id, i, q, min(best) FROM (
    SELECT w.conv_id, g.i, ins.r AS q, {'cost': w.best.cost + 3 * length(ins.letters) + 4, 'audit': w.best.audit || ins.letters || 'D'} AS best
    FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1 JOIN ins ON ins.q = w.q
    UNION ALL
    SELECT w.conv_id, g.i, step.r, {'cost': w.best.cost + 3 * length(ins.letters) + CASE WHEN g.c = step.r THEN 0 ELSE 3 END
        + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'audit': w.best.audit || ins.letters || CASE WHEN g.c = step.r THEN 'K' ELSE 'R' END}
    FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1 JOIN ins ON ins.q = w.q JOIN step ON step.q = ins.r
    WHERE fault IN ('', 'truncated') AND (g.c = step.r OR step.r <> 's'))
  GROUP BY conv_id, i, q),
ends AS (SELECT w.conv_id, min({'cost': w.best.cost + 3 * length(ins.letters), 'audit': w.best.audit || ins.letters}) AS best
  FROM walk w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.n JOIN ins ON ins.q = w.q AND ins.r IN ('', 'a') GROUP BY w.conv_id),
letters AS (SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS pos FROM ends),
edits AS (SELECT conv_id, pos, audit[pos] AS e, count(*) FILTER (audit[pos] <> 'I') OVER w AS i, count(*) FILTER (audit[pos] <> 'D') OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
kept AS (SELECT e.*, g.role, g.text, g.c, max(CASE WHEN place = 1 AND e = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS kind
  FROM edits e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i),
made AS (SELECT conv_id, string_agg(CASE e WHEN 'K' THEN role WHEN 'D' THEN NULL ELSE CASE WHEN (place - kind) % 2 = 1 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS body FROM kept WHERE e <> 'D' GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(ends.best.cost, 0) AS cost, coalesce(ends.best.audit, '') AS audit,
  sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM a.conv_id"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label_column=label)


SQL["op11_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10"""
