"""The corpus pipeline, stage by stage, on a small table."""

import corpus_pipeline
from loomlight.llm import decontaminate, ngram_join, pii, quality_rules
from loomlight.session import stored

from . import brute

SMALL = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SMALL), name)
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == columns
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.report(before).collect() if r.kept}
            assert {r.doc_id for r in docs.collect()} == kept
        elif name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            firsts = {x[1] for x in brute.classes(rows, 5, 80)}
            assert {r.doc_id for r in docs.collect()} == firsts
        elif name == "decontamination":
            items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            assert not any(r.contaminated for r in decontaminate.report(docs, items).collect())
        elif name == "pii":
            assert docs.count() == before.count()
            assert all(not brute.personal(r.text) and r.n_chars == len(r.text) for r in docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "bpe" and docs.count() == seen["pii"].count()


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.count() == 0
