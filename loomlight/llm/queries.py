"""The operators of this package on the given tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlight.llm import (
    bpe, decontaminate, html_text, licenses, lm_scores, ngram_join, pii, prefix_trie, quality_crf, quality_rules,
    suffixes, token_counts, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(variable: str, name: str) -> str:
    """The file that the environment names, else the public one that is installed."""
    if variable in os.environ:
        return os.environ[variable]
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_path() -> str:
    """The word-piece vocabulary: $WORD_BPE_PATH, else the public one."""
    return _vocabulary("WORD_BPE_PATH", "word_bpe_49k.json")


def byte_tokenizer_path() -> str:
    """The byte-level vocabulary: $BYTE_BPE_PATH, else the public one."""
    return _vocabulary("BYTE_BPE_PATH", "byte_bpe_50k.json")


def op1_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op3_lm_scores(spark, sf_dir):
    return lm_scores.report(table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_license_scan(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffixes.report(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark, sf_dir):
    return quality_crf.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark, sf_dir):
    return html_text.report(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op11_whitening(spark, sf_dir):
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark, sf_dir):
    return token_counts.report(table(spark, sf_dir, "documents"), byte_tokenizer_path())


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_quality_rules, op3_lm_scores, op4_bpe, op5_license_scan, op6_suffix_dedup,
        op7_quality_classifier, op8_html_extraction, op9_ngram_jaccard_join, op10_pii,
        op11_whitening, op12_prefix_trie, op13_token_counts,
    )
}

ORACLES: dict[str, str] = {"op2_quality_rules": quality_rules.oracle()}
