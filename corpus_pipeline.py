"""The corpus pipeline: what is toxic or poor goes, near-duplicates and benchmark leaks go, the rest is packed.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Null or
repeated ids, null and empty texts and further columns pass through the filters; each stage's operator says how it
judges them. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm import decontaminate, minhash, packing, quality_pu, toxicity
from tidegate.llm.queries import table, tokenizer_path
from tidegate.llm.rows import unused
from tidegate.scale import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below the threshold."""
    judge = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return toxicity.with_score(docs, judge, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of the threshold or more."""
    judge = quality_pu.learn(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return quality_pu.with_score(docs, judge, score).filter(F.col(score) >= quality_pu.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest id, and of the texts with
    that id the one with the smallest digest. Rows that share an id are judged by their texts: each text that is chosen
    stays once, texts without words once each. Rows with a null id stay."""
    judged = minhash.near_duplicates(docs, choice=True).filter("chosen AND doc_id IS NOT NULL")
    kept = materialize(judged.select("doc_id", "digest").distinct(), "kept")
    # Merged at every size, so that the plan that is tried on little data is the one that runs on much.
    rest = docs.join(kept.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select(docs.columns)
    repeated = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        digest, place = unused(docs, "digest"), unused(docs, "place")
        several = docs.join(repeated, "doc_id", "left_semi").withColumn(digest, minhash.digest_of_words(F.col("text")))
        known = kept.select(F.col("doc_id").alias("chosen_id"), F.col("digest").alias("chosen_digest"))
        several = several.join(known, (F.col("doc_id") == F.col("chosen_id")) & F.col(digest).eqNullSafe(F.col("chosen_digest")), "left_semi")
        bare = F.when(F.col(digest).isNull(), F.col("text"))
        first = several.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", digest, bare).orderBy("text")))
        rest = rest.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(first.filter(F.col(place) == 1).select(docs.columns))
    return rest.unionByName(docs.filter("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs."""
    name = unused(docs, "leaks")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), name=name)
    return found.filter(F.size(name) == 0).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]

# The models, the sets and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, in order; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
