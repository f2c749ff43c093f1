"""Whitening, the prefix tree and token counts, against plain versions."""

import math
import random

import numpy as np
import pytest
import regex

from loomlight.llm import prefix_trie, token_counts, whitening
from loomlight.llm.queries import QUERIES, byte_tokenizer_path, tokenizer_path

from . import brute, tables

SMALL = "/root/testdata/sf0.001"


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


# ---- whitening -------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, x string, component int, VEC_ID string"


def embeddings(spark, lists):
    return spark.createDataFrame([(i, e, 0, "clash", 7, "clash") for i, e in lists], VECTORS).repartition(3)


def whole(lists):
    kept = [(i, e) for i, e in lists if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    return [i for i, _ in kept], [[math.floor(1024 * float(np.float32(c))) + 100000 for c in e] for _, e in kept]


def check_whitening(df, lists):
    ids, x = whole(lists)
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    centred = [[n * r[d] - sums[d] for d in range(dims)] for r in x]
    v = np.array([[sum(r[i] * r[j] for r in centred) / n**3 for j in range(dims)] for i in range(dims)])
    values, unit = np.linalg.eigh(v)
    values, unit = values[::-1], unit[:, ::-1]
    k = min(8, int((values > 1e-9 * values[0]).sum()))
    got = whitening.report(df).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i in ids for c in range(k))
    deviations = sorted((i, sum(y * y for y in r)) for i, r in zip(ids, centred) for _ in range(k))
    assert sorted((r.vec_id, int(r.deviation_digits)) for r in got) == deviations
    assert all(r.deviation == int(r.deviation_digits) for r in got if int(r.deviation_digits) < 1 << 63)
    want = {(i, c): abs(np.dot(r, unit[:, c]) / n) / math.sqrt(values[c]) for i, r in zip(ids, centred) for c in range(k)}
    for r in got:
        c = r.component - 1
        assert r.n == n and r.explained == pytest.approx(values[c] / np.trace(v), rel=1e-9)
        assert abs(r.whitened) == pytest.approx(want[r.vec_id, c], abs=1e-6) and r.identity_error < 1e-9
    return got


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(11, 11)) * np.logspace(0, -1, 11)[:, None]
    lists = [(i, [float(np.float32(c)) for c in rng.normal(size=11) @ mix]) for i in range(300)]
    lists += [(900, None), (901, lists[0][1][:-1] + [None]), (902, [float("nan")] * 11), (903, [float("inf")] * 11)]
    lists += [(904, lists[3][1]), (905, lists[3][1])]
    check_whitening(embeddings(spark, lists), lists)


def test_whitening_of_few_dimensions_and_large_entries(spark):
    rng = np.random.default_rng(6)
    lists = [(i, [float(np.float32(c)) for c in rng.normal(size=3) * (4e3, 1.0, 1.0)]) for i in range(60)]
    got = check_whitening(embeddings(spark, lists), lists)
    assert max(r.component for r in got) == 3


def test_whitening_keeps_the_rank(spark):
    lists = [(i, [float(i % 7), float(2 * (i % 7)), 1.0, float(i % 3)]) for i in range(42)]
    got = check_whitening(embeddings(spark, lists), lists)
    assert max(r.component for r in got) == 2


def test_whitening_without_spread_or_rows(spark):
    for lists in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        found = whitening.report(embeddings(spark, lists))
        assert found.count() == 0 and found.columns[:3] == ["vec_id", "component", "n"]


def test_vectors_of_another_length_are_left_out(spark):
    lists = [(i, [float(i), float(i * i % 11)]) for i in range(20)]
    got = check_whitening(embeddings(spark, lists + [(99, [1.0, 2.0, 3.0]), (98, [])]), lists)
    assert {r.vec_id for r in got} == set(range(20))


def test_a_long_deviation_is_given_in_digits(spark):
    lists = [(i, [float(i) * 1e9, float(i % 5)]) for i in range(50)]
    got = whitening.report(embeddings(spark, lists)).collect()
    assert all(r.deviation is None or r.deviation == int(r.deviation_digits) for r in got)
    assert any(r.deviation is None and int(r.deviation_digits) >= 1 << 63 for r in got)


def test_factor_and_rotations():
    rng = np.random.default_rng(7)
    for dims in (1, 2, 5, 40):
        a = rng.normal(size=(dims, dims + 2)) * np.logspace(0, -3, dims)[:, None]
        v = a @ a.T
        factor, order = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-13 * np.trace(v))
        assert np.allclose(np.triu(factor, 1), 0) and (np.diff(np.diag(factor)) <= 1e-15).all()
        columns = whitening.rotated(factor)
        gram = columns.T @ columns
        assert np.allclose(gram, np.diag(np.diag(gram)), atol=1e-12 * np.trace(v))
        values, unit = whitening.eigen(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-9) and np.allclose(unit.T @ unit, np.eye(dims))


# ---- prefix tree -----------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, CONV_ID string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS).repartition(5)


def some_rows(seed, n=150, longest=6):
    """Few different turns, so that beginnings are shared; null and repeated turns; groups of copies."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-120, 420), n):
        said = [(rng.choice(("user", "assistant", None)), rng.choice(("a", "", None, "bé", "日本")))
                for _ in range(rng.randint(1, longest))]
        if c % 3 == 0:
            said = [("user", "hello"), ("assistant", "hello\nto you")] + [("user", "x")] * (c % 4)
        first = rng.choice((0, 5, -3))
        rows += [(c, None if i == 0 and c % 5 == 0 else first + i, *s) for i, s in enumerate(said)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("head", (1, 3, prefix_trie.HEAD))
def test_prefix_nodes(spark, seed, head):
    rows = some_rows(seed)
    same(prefix_trie.report(conversations(spark, rows), head).collect(), brute.prefix_nodes(rows))


def test_prefix_nodes_of_copies_over_many_shards(spark):
    rows = [(c * 100, i, "user", f"turn {i}") for c in range(300) for i in range(4)]
    rows += [(c * 100, i, "user", f"turn {min(i, 2)}") for c in range(300, 330) for i in range(c % 6 + 1)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        same(prefix_trie.report(conversations(spark, rows)).collect(), brute.prefix_nodes(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_a_long_conversation_and_its_copy(spark):
    rows = [(c, i, "user", str(i % 7)) for c in (100, 200) for i in range(70)]
    rows += [(300, i, "user", str(i % 5)) for i in range(900)] + [(407, 1, "user", "z" * 100_000)]
    same(prefix_trie.report(conversations(spark, rows), 8).collect(), brute.prefix_nodes(rows))


def test_prefix_nodes_of_the_given_table_and_of_none(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op12_prefix_trie"](spark, SMALL).collect(), brute.prefix_nodes(rows))
    assert prefix_trie.report(conversations(spark, [])).count() == 0
    assert prefix_trie.report(conversations(spark, [(None, 1, "user", "no id")])).count() == 0


def test_repeated_turns_have_one_order(spark):
    rows = [(100, 1, "user", t) for t in "abcab"] + [(200, 1, "user", t) for t in "bcbaa"]
    got = prefix_trie.report(conversations(spark, rows)).collect()
    assert sorted((r.depth, r.n_convs) for r in got) == [(d, 2) for d in range(6)]


def test_medians_and_the_search_tree():
    assert sorted(prefix_trie.medians(100)) == list(range(100)) and next(prefix_trie.medians(100)) == 50
    tree, depth = prefix_trie.Tree(), 0
    for i in prefix_trie.medians(1000):
        tree.insert([i], [1])
    for i in range(1000):
        at, steps = tree.same[0], 1
        while tree.key[at] != i:
            at, steps = (tree.low if i < tree.key[at] else tree.high)[at], steps + 1
        depth = max(depth, steps)
    assert depth <= 10


# ---- token counts ----------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(byte_tokenizer_path())
    return lambda text: len(coder.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_equal_the_library(spark, library):
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    for docs, rows in (
        (small, [(r.doc_id, r.text) for r in small.collect()]),
        (tables.edge_docs(spark), [(r[0], r[1]) for r in tables.edge_rows()]),
        (tables.no_docs(spark), []),
    ):
        got = token_counts.report(docs, byte_tokenizer_path())
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        want = [(d, len((t or "").encode()), library(t), library(t) > 1024) for d, t in rows]
        same(got.collect(), want)


def test_counts_of_odd_texts_equal_the_library(library):
    count = token_counts.Counts(token_counts.load(byte_tokenizer_path()))
    rng = random.Random(3)
    signs = [
        "a", "B", "1", "é", " ", "  ", "\n", "\t", "\r", "'s", "'", "'LL", "!", "<|endoftext|>", "<|end", "日", "٣",
        "\U0001f600", "́", " ", "　", " ", "\x00", "\x0b", "\x1c", "\x85", "​", "͸",
        "࢏", "\U000107bb", "￿",
    ]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 20)))
        assert count(text) == library(text), repr(text)


def test_counts_do_not_depend_on_stretches_or_memory(library, monkeypatch):
    text = tables.LONG[:30_000] + "\n\n  x 's <|endoftext|> " * 50
    for stretch, memory in ((7, 50), (100, 1), (1000, 10**9)):
        monkeypatch.setattr(token_counts, "STRETCH", stretch)
        monkeypatch.setattr(token_counts, "MEMORY", memory)
        count = token_counts.Counts(token_counts.load(byte_tokenizer_path()))
        assert count(text) == library(text)


def test_proven_strings_are_one_token_each(library):
    shared = token_counts.load(byte_tokenizer_path())
    assert len(shared["whole"]) > 40_000 and shared["special"] == ["<|endoftext|>"]
    for word in random.Random(4).sample(shared["whole"], 2000):
        if len(regex.findall(token_counts.PRE_TOKEN, word)) == 1:
            assert library(word) == 1


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.load(tokenizer_path())
