"""The corpus pipeline: five stages that clean documents for training, each written and read again.

Every stage but the last returns the columns of documents. Decisions of a stage take
effect: rows that it rejects are gone for the next one, and texts that it changes are
changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlight.llm import bpe, decontaminate, ngram_join, pii, quality_rules
from loomlight.llm.queries import tokenizer_path
from loomlight.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five-word shingles, similarity 0.8."""
    return ngram_join.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    return pii.sanitised_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded text."""
    return bpe.report(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", encoding),
]

#: Near copies and byte pair encoding cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
