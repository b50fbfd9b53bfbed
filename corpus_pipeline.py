"""Corpus pipeline: training-data operators as stages, each over all that the stage before it kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  The first three remove documents, the
fourth takes each as often as the mix does, the last encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm._spark import settle, table
from loomwork.llm.bpe import encode_documents, vocabulary_path
from loomwork.llm.exact_dedup import keep_exact
from loomwork.llm.minhash import keep_one_of_near
from loomwork.llm.mixing import mixed
from loomwork.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), 0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return keep_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of similarity 0.8 or more on five-word shingles connect, the smallest id stays."""
    return keep_one_of_near(docs, width=5, threshold=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)``."""
    return encode_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", encoding),
]

#: The first stage is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
