"""A training corpus from raw documents: language, near duplicates, personal data, mixture, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.llm import language, mixing, ngram_join, packing, personal_data
from crossquote.llm.substrings import stored
from crossquote.llm.words import documents, keep_batches_small

LEAST_SCORE = 0.4  # of a document's language
SHINGLE, PERCENT = 5, 80


def lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage with small Arrow batches."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        keep_batches_small(spark)
        return stage(spark, docs, sf_dir)
    return run


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language of their own in the best path, go."""
    found = language.identify(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id stays.

    Rows of one id are one document: of different texts that with the smallest hash stays. Rows with a null id, and
    null or blank texts of different ids, link with nothing and stay. An empty table stays empty.
    """
    linked = stored(ngram_join.link_documents(docs, SHINGLE, PERCENT))
    repeated = linked.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        first = F.struct(F.xxhash64("text"), F.col("text"), F.xxhash64(*docs.columns))
        again = docs.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(
            F.min_by(F.struct(*docs.columns), first).alias("r")).select("r.*")
        alone = docs.join(repeated.select("doc_id"), "doc_id", "left_anti")  # null ids too
        docs = alone.unionByName(again)
    gone = linked.where("component_id <> doc_id").select("doc_id").distinct()
    if gone.count() <= ngram_join.FEW_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind. Every row stays, repeated ones too; a null text stays null, n_chars counts the new text."""
    tagger = personal_data.fit(personal_data.training_windows(docs.select("doc_id", "text")))
    return personal_data.redact(docs, tagger)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is one of its own; null and blank texts have no words and stay once at
    least; rows that repeat, and equal keys, count one by one. An empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed_documents(docs, mixing.quality_weights(labels))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, repeated ones too; a null or empty text is its end id. An empty table has no pieces."""
    return packing.pack(docs)


STAGES = [
    ("language", lean(known_language)),
    ("near_duplicates", lean(one_of_each_group)),
    ("personal_data", lean(without_personal_data)),
    ("mixing", lean(mixed_sources)),
    ("packing", lean(packed)),
]
ORACLE_SQL = None  # a fitted model and a tokeniser are no SQL; tests/llm/test_pipeline.py checks the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
