"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, TEXT string"

LONG = " ".join(f"w{i % 5003}x{i % 17}" for i in range(30_000))

TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "Some few words of a text that is long enough to have windows and shingles in it, twenty words at least, or more.",
    "Some few words of a text that is long enough to have windows and shingles in it, twenty words at least, or more!",
    LONG,
    LONG + " and one more end",
    "x" * 70_000,
    "7" * 30_000,
    "ä́ ünïcödé 日本語 \U0001f600 " * 20,
    "a.b@c.de +49 (30) 1234-5678 10.0.0.255 4111 1111 1111 1111 10.0.0.256 Licensed under the Apache License",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\nmit license, MIT license",
]


def edge_rows():
    """Null ids, repeated rows, one id with two texts, and columns with clashing names."""
    rows = [(i, t, "en", "s", 1, "clash", "clash", "other") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, TEXTS[4], None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None), (6, TEXTS[11], "en", None, 3, "clash", None, None)]
    return rows


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def families(seed: int, n: int = 60, words: int = 40):
    """Texts in families that differ a little, over few words, so that all kinds of near misses occur."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    out, base = [], []
    for i in range(n):
        if not base or rng.random() < 0.25:
            base = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        text = list(base)
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            text.insert(rng.randrange(len(text) + 1), passage)
        out.append((i, rng.choice((" ", "\n")).join(text)))
    rng.shuffle(out)
    return out
