"""N-gram Jaccard join, suffix dedup and decontamination against brute force."""

from pyspark.sql import functions as F

from loomlight.llm import decontaminate, ngram_join, suffixes
from loomlight.llm.frames import components, maybe_in

from . import brute, tables


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL = "/root/testdata/sf0.001"


def with_texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_classes_of_the_small_table(spark):
    docs = read(spark, SMALL, "documents")
    rows = with_texts(docs)
    want = sorted((d, *x) for (d, _), x in zip(rows, brute.classes(rows)))
    assert sorted(tuple(r) for r in ngram_join.report(docs).collect()) == want


def test_classes_of_families_at_every_threshold(spark):
    for seed, percent in ((1, 85), (2, 60), (3, 80), (4, 95)):
        rows = tables.families(seed)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        found = ngram_join.jaccard_classes(docs, ["doc_id"], 3, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
        assert got == {d: x for (d, _), x in zip(rows, brute.classes(rows, 3, percent))}


def key(row):
    return tuple((v is None, str(v)) for v in row)


def test_class_edge_cases(spark):
    rows = [(r[0], r[1]) for r in tables.edge_rows()]
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute.classes(rows))), key=key)
    # a row without words has its own doc_id, a class without ids has none
    got = sorted((tuple(r) for r in ngram_join.report(tables.edge_docs(spark)).collect()), key=key)
    assert got == want
    assert ngram_join.report(tables.no_docs(spark)).collect() == []


def test_one_of_each_class_stays(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words stand in here now"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, row string")
    kept = ngram_join.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(200)}


def test_the_bitmap_filter_loses_no_key(spark):
    rows = spark.range(5000)
    keys = spark.range(0, 5000, 7)
    got = {r.id for r in maybe_in(rows, "id", keys).collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 800


def test_near_copies_do_not_make_all_pairs(spark):
    base = [f"u{i}" for i in range(200)]
    rows = []
    for i in range(300):
        text = list(base)
        text[i % 200] = f"z{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r.component_id for r in ngram_join.report(docs).collect()} == {0}


def test_repeats_of_the_small_table(spark):
    docs = read(spark, SMALL, "documents")
    rows = with_texts(docs)
    want = sorted((d, *x) for (d, _), x in zip(rows, brute.repeats(rows)))
    assert sorted(tuple(r) for r in suffixes.report(docs).collect()) == want


def test_repeats_of_families(spark, monkeypatch):
    for seed in (5, 6):
        rows = tables.families(seed)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        got = {r.doc_id: tuple(r)[1:] for r in suffixes.report(docs).collect()}
        assert got == {d: x for (d, _), x in zip(rows, brute.repeats(rows))}


def test_blocks_of_one_anchor_go_on(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 7)
    rows = [(i, f"{i} " * (i % 5) + "the same passage of more than fifty bytes stands in each of these texts" + f" {i}" * (i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.report(docs).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute.repeats(rows))}


def test_runs_of_short_period_are_repeats(spark):
    """Their anchors are all one or a few; those with the highest bit set were lost."""
    runs = [x * 60 for x in (" ", "=", "*", "#", "-", "ha")]
    rows = [(1, "one head" + "".join(f"<{i} one {x} end one>" for i, x in enumerate(runs)))]
    rows += [(2, "another" + "".join(f"[two {x} two {i}]" for i, x in enumerate(runs)))]
    rows += [(3 + i, f"{i} only {x} here {i}") for i, x in enumerate(runs)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = {d: x for (d, _), x in zip(rows, brute.repeats(rows))}
    assert all(want[d][2] for d, _ in rows[1:])
    assert {r.doc_id: tuple(r)[1:] for r in suffixes.report(docs).collect()} == want


def test_repeat_edge_cases(spark):
    rows = [(r[0], r[1]) for r in tables.edge_rows()]
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute.repeats(rows))), key=key)
    assert sorted((tuple(r) for r in suffixes.report(tables.edge_docs(spark)).collect()), key=key) == want
    assert suffixes.report(tables.no_docs(spark)).collect() == []


def test_multikey_order_is_the_order_of_bytes():
    import numpy as np

    rng = np.random.default_rng(1)
    raw = rng.integers(0, 2, (500, 24)).astype(np.uint8)
    raw[:, 3:20] = 0
    doc = rng.integers(0, 50, 500)
    order, cls = suffixes.multikey_order(raw.view(">u8").astype(np.uint64), doc)
    listed = [(raw[i].tobytes(), doc[i]) for i in order]
    assert listed == sorted(listed)
    assert [a[0] == b[0] for a, b in zip(listed, listed[1:])] == (cls[1:] == cls[:-1]).tolist()


def test_contamination_of_the_small_table(spark):
    docs, items = read(spark, SMALL, "documents"), read(spark, SMALL, "benchmark")
    rows = with_texts(docs)
    want = brute.contamination([t for _, t in rows], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = sorted(tuple(r) for r in decontaminate.report(docs, items).collect())
    assert got == sorted((d, *x) for (d, _), x in zip(rows, want))
    assert any(r[-1] for r in got)


def test_contamination_edge_cases(spark):
    few = [(1, "one"), (2, None), (3, ""), (None, "日本語 ünïcödé"), (5, tables.TEXTS[4]), (6, "w0x0 W1x1"), (7, tables.TEXTS[4])]
    items = spark.createDataFrame(few, "item_id bigint, text string")
    named = [("null" if i is None else i, t) for i, t in few]
    rows = [(r[0], r[1]) for r in tables.edge_rows()]
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute.contamination([t for _, t in rows], named))), key=key)
    docs = tables.edge_docs(spark)
    assert sorted((tuple(r) for r in decontaminate.report(docs, items).collect()), key=key) == want
    blocks = decontaminate.contamination(docs.toDF(*"abcdefgh").selectExpr("a AS doc_id", "b AS text"), items, ["doc_id"], block=3)
    assert sorted(len(r["items"]) for r in blocks.collect()) == sorted(x[3] for x in want)
    nothing = decontaminate.report(docs, items.limit(0))
    assert not any(r.contaminated for r in nothing.collect())
    assert decontaminate.report(tables.no_docs(spark), items).collect() == []


def test_only_clean_documents_stay(spark):
    docs = read(spark, SMALL, "documents").withColumn("hits", F.lit(1))
    items = read(spark, SMALL, "benchmark")
    bad = {r.doc_id for r in decontaminate.report(docs, items).collect() if r.contaminated}
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
