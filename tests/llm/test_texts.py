"""Operators that look at one text at a time, against plain versions."""

import collections
import html
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomlight.llm import bpe, html_text, licenses, lm_scores, pii, quality_crf, quality_rules
from loomlight.llm.queries import tokenizer_path

from . import brute, tables

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def read(spark, name, sf_dir=SMALL):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark):
    """(table, rows as (doc_id, text)) of the small and the hand-made documents."""
    small = read(spark, "documents")
    yield small, [(r.doc_id, r.text) for r in small.collect()]
    yield tables.edge_docs(spark), [(r[0], r[1]) for r in tables.edge_rows()]
    yield tables.no_docs(spark), []


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# ---- quality rules ---------------------------------------------------------


def test_quality_counts(spark):
    for docs, rows in cases(spark):
        found = quality_rules.report(docs)
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        got = found.collect()
        same([[r[c] for c in names] for r in got], [(d, *brute.quality_counts(t)) for d, t in rows])
        assert not any(r.kept and r.base_failed for r in got)


def test_quality_verdicts_equal_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{MIDDLE}/documents.parquet'")
    want = con.execute(quality_rules.oracle())
    names = [d[0] for d in want.description]
    same([[r[c] for c in names] for r in quality_rules.report(read(spark, "documents", MIDDLE)).collect()], want.fetchall())


def test_quality_rules_keep_the_clean_and_drop_the_bad(spark):
    docs = read(spark, "documents", MIDDLE).withColumn("outside", F.lit(1))
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    words = {r.doc_id: r.n_words for r in quality_rules.report(docs).collect()}
    marks = {r.doc_id: r.quality for r in read(spark, "labels", MIDDLE).collect()}
    good = [d in ids for d, q in marks.items() if q == 1 and words[d] >= 20]
    bad = [d in ids for d, q in marks.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_fences_follow_the_noise_of_their_group(spark):
    draw = random.Random(7)

    def text(marked):
        return " ".join(f"word{draw.randrange(900)}" + ("," if draw.random() < marked else "") for _ in range(120))

    rows = [(i, text(0.08), "xx", "calm") for i in range(60)] + [(100 + i, text(0.7), "xx", "loud") for i in range(60)]
    docs = spark.createDataFrame([*rows, (999, text(0.7), "xx", "calm")], "doc_id long, text string, lang string, source string")
    fences = {r.source: r for r in quality_rules.thresholds(quality_rules.measured(docs, [])).collect()}
    assert fences["loud"].hi_punctuation > 2 * fences["calm"].hi_punctuation
    kept = {r.doc_id: r.kept for r in quality_rules.report(docs).collect()}
    assert not kept.pop(999) and all(kept.values())  # usual in one group, far outside in the other
    fences = quality_rules.thresholds(quality_rules.measured(read(spark, "documents", MIDDLE), []))
    for k in ("punctuation", "sameness", "stutters", "word_length"):
        assert fences.select(f"hi_{k}").distinct().count() > 1


def test_quality_rules_have_no_python(spark):
    plan = quality_rules.report(read(spark, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- encoding --------------------------------------------------------------


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    coder = Tokenizer.from_file(path)
    odd = [
        "It's <|endoftext|> 12 we'll <|startoftext|><|endoftext|>x", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ﬁn Å é ẞ",
        "\u0085a b c　d\x1ce", "½ ² Ⅷ ੧ !!'s don't !'s", "́̂ \U0001d400 ﻿", "<|endoftext|", "a​b­c",
    ]
    more = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    for docs, rows in [*cases(spark), (more, list(enumerate(odd)))]:
        want = []
        for d, t in rows:
            ids = coder.encode(t or "", add_special_tokens=False).ids
            shown = coder.decode(ids, skip_special_tokens=False)
            want.append((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(shown)))
        same(bpe.report(docs, path).collect(), want)


def test_chunks_that_end_early_and_decoding_by_join(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 500)
    path = tokenizer_path()
    docs = read(spark, "documents").select("doc_id", "text").repartition(2)
    found = bpe.encoded(docs, path, ["doc_id"]).cache()
    again = {r.doc_id: r.decoded for r in bpe.decode(found.select("doc_id", "ids"), path, ["doc_id"]).collect()}
    assert again == {r.doc_id: r.decoded for r in found.collect()} and len(again) == docs.count()
    found.unpersist()


# ---- license scans ---------------------------------------------------------


def test_license_places(spark):
    for docs, rows in cases(spark):
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
        got = licenses.report(docs).collect()
        same([[r[c] for c in names] for r in got], [(d, *brute.license_places(t, licenses.BASE)) for d, t in rows])
        for r in got:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("expression", "postfix"),
    [
        ("MIT", "MIT"),
        ("MIT OR Apache-2.0 AND GPL-2.0", "MIT Apache-2.0 GPL-2.0 and or"),
        ("(MIT or Apache-2.0) and GPL-2.0 with Classpath-exception-2.0", "MIT Apache-2.0 or GPL-2.0 Classpath-exception-2.0 with and"),
        ("MIT AND", "MIT"),
        ("OR MIT", ""),
        ("MIT and ( or", "MIT"),
        ("((MIT)", "MIT"),
        ("MIT) OR BSD-3-Clause", "MIT"),
        ("MIT and some words", "MIT some and"),
    ],
)
def test_expressions(expression, postfix):
    assert " ".join(licenses.parse(expression)) == postfix


def test_an_expression_decides_the_score(spark):
    texts = ["SPDX-License-Identifier: MIT OR GPL-2.0", "SPDX-License-Identifier: MIT AND GPL-2.0", "no licence", "all rights reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.report(docs).collect()}
    assert got == {0: ("gpl,mit", 0.95), 1: ("gpl,mit", 0.3), 2: ("", 0.0), 3: ("proprietary", 0.0)}


# ---- pages -----------------------------------------------------------------


def test_articles_of_the_given_pages(spark):
    pages = read(spark, "pages")
    got = {r.page_id: r for r in html_text.report(pages).collect()}
    for row in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", body)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b.replace("<br>", " "))).split()) for b in blocks]
        want = "\n".join(x for x in plain if x)
        assert (got[row.page_id].text, got[row.page_id].n_chars) == (want, len(want))


PROSE = "This is the story of a man who was in the town and had not been to the sea for all of his days, as it is told."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("no markup at all", ""),
        (f"<p>{PROSE}</p>", PROSE),
        (f"<div class='cookie-notice'>{PROSE}</div><p>{PROSE}</p>", PROSE),
        (f"<div class='site-header top'>{PROSE}</div><div id=post-comments><p>{PROSE}</p></div><p>{PROSE} x</p>", f"{PROSE} x"),
        (f"<nav>menu</nav><div class='article-header'><h1>Head</h1></div><p>{PROSE}</p>", f"Head\n{PROSE}"),
        (f"<article class='social-history'><h1>Head</h1><p>{PROSE}</p></article>", f"Head\n{PROSE}"),
        (f"<p>{PROSE}</p><div class='related-stories'><p><a>One more to read</a> of these</p></div>", PROSE),
        (f"<p>{PROSE}</p><p>short one</p><p>{PROSE}</p>", f"{PROSE}\nshort one\n{PROSE}"),
        (f"<p>{PROSE}</p><p><a href=x>more links</a></p>", PROSE),
        ("<article><p>A &lt;b&gt; &amp; c&nbsp;d<br>e</p><section id=comments><p>me too</p></section></article>", "A <b> & c d e"),
        ("<main><aside>x</aside><script>if (a<b) {}</script><p title='a>b'>y</main><footer>z", "y"),
        ("<article><p>one<p>two<!-- open", "one\ntwo"),
        ("<article><p>one <b>bold</b> <span class=ad>buy</span> end</p></article>", "one bold\nend"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


FINNISH = "Vanha kalastaja kertoi meille pitkän tarinan merestä, tuulesta ja kaukaisista saarista, joilla kukaan ei enää asu."
LINKS = "".join(f"<li><a href=x{i}>another headline</a></li>" for i in range(4))


@pytest.mark.parametrize(
    ("page", "kept", "gone"),
    [
        (f"<div><p>{PROSE}</p></div><article><a href=x>Teaser of it</a></article>", [PROSE], ["Teaser"]),
        (f"<div><p>{PROSE}</p></div><article><p>Teaser of it</p></article>", [PROSE], []),
        (f"<article><p>{PROSE}</p><ul>{LINKS}</ul></article>", [PROSE], ["headline"]),
        (f"<div><p>{PROSE}</p><p>{FINNISH}</p><p>{PROSE}</p></div>", [PROSE, FINNISH], []),
        (f"<nav>{LINKS}</nav><div><p>{FINNISH}</p></div><footer>end</footer>", [FINNISH], ["headline", "end"]),
    ],
)
def test_an_article_element_is_one_sign_of_several(page, kept, gone):
    text = html_text.main_text(page)
    assert all(x in text for x in kept) and not any(x in text for x in gone)


def test_page_edge_cases(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<article>" + "<p>word</p>" * 20_000 + "</article>", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.report(pages).collect()) == [0, 0, 20_000 * 5 - 1]
    assert html_text.with_text(pages, "text").columns == ["page_id", "url", "html", "text"]
    assert html_text.report(pages.limit(0)).collect() == []


# ---- personal data ---------------------------------------------------------


def shown(spans):
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)


def test_personal_data(spark):
    extra = [
        "a@b.c_d@e.f x@y z@.com @a.b a@b..c", "1.2.3.4.5.6.7.8 001.002.003.0255 1.2.3", "4111-1111-1111-1111 4111 1111 1111 1112",
        "0000 0000 0000 0000 0000 12", "+1 (555) 010-9999. +1+2 345 678 901 +12", "é" * 50 + "q@r.st", "1" * 20_000 + "." + "a" * 20_000,
        " ".join(f"m{i}@n.org" for i in range(1500)), "+1" + "(" * 5000,
    ]
    more = spark.createDataFrame(list(enumerate(extra)), "doc_id bigint, text string")
    for docs, rows in [*cases(spark), (more, list(enumerate(extra)))]:
        want = []
        for d, t in rows:
            spans = brute.personal(t)
            counts = [sum(s[1] == k for s in spans) for k in range(4)]
            want.append((d, *counts, brute.sha(shown(spans))))
        got = pii.report(docs).collect()
        same([r[:6] for r in got], want)
        for r in got:
            base = [x for x in r.spans.split(",") if x and not x.startswith("term:")]
            assert brute.sha(",".join(base)) == r.base_sha256


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"the common words here zorbax owns mail to bob@corp.org of the town {i}") for i in range(6)]
    rows += [(10 + i, f"the common words here owns mail to of the town number {i}") for i in range(60)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, n_chars bigint")
    for r in pii.report(docs).collect():
        want = r.doc_id < 10
        assert ("term:" in r.spans) == want
        if want:
            text = dict(rows)[r.doc_id]
            at = text.index("zorbax")
            assert [x for x in r.spans.split(",") if x.startswith("term:")] == [f"term:{at}:{at + 6}"]
    clean = {r.doc_id: r for r in pii.sanitised_documents(docs).collect()}
    assert clean[0].text == "the common words here  owns mail to <EMAIL> of the town 0"
    assert clean[0].n_chars == len(clean[0].text) and clean[12].text == dict(rows)[12]


def test_terms_of_entities_in_one_or_two_documents(spark):
    """On the given table, terms are found, all of them rare; words of many documents stay."""
    docs = read(spark, "documents", MIDDLE)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    holding = {}
    for text in texts.values():
        for word in set(brute.alnum_words(text)):
            holding[word] = holding.get(word, 0) + 1
    n_terms = 0
    for r in pii.report(docs).collect():
        for x in r.spans.split(","):
            if x.startswith("term:"):
                _, s, e = x.split(":")
                n_terms += 1
                assert holding[texts[r.doc_id][int(s) : int(e)].lower()] <= len(texts) ** 0.5
    assert n_terms > 0


def test_a_name_goes_in_every_place_however_it_is_written(spark):
    """In byline, beside the address and in the signature; capitals are the same word, parts of words are not."""
    text = "Zorblatt Ödegård writes. Write to abc@quux.org or call Zorblatt soon, says Ödegård there. " + "Some lines of text follow here. " * 5
    text += "Signed ZORBLATT öDEGÅRD"
    rows = [(0, text)] + [(i, f"Write to the town or call somebody soon, says she there. Some lines of text follow here {i}. Signed Rite") for i in range(1, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    words = [text[int(s) : int(e)] for kind, s, e in (x.split(":") for x in found[0].split(",")) if kind == "term"]
    assert words == ["Zorblatt", "Ödegård", "Zorblatt", "Ödegård", "ZORBLATT", "öDEGÅRD"]
    assert not any(v for d, v in found.items() if d)
    clean = {r.doc_id: r.text for r in pii.sanitised_documents(docs).collect()}
    assert "blatt" not in clean[0].lower() and "abc@" not in clean[0] and clean[0].count("Write to <EMAIL>") == 1
    assert all(clean[d] == t for d, t in rows if d)


def test_terms_equal_the_plain_estimate(spark):
    import math

    rng = random.Random(11)
    words = [f"w{i}" for i in range(25)] + ["Név", "rare"]
    mails = ["a@b.org", "c@d.net", "e@f.com"]
    rows = [(i, " ".join(rng.choice(mails) if rng.random() < 0.03 else rng.choice(words[: rng.choice((5, 27))]) for _ in range(40))) for i in range(120)]
    rows += [(200 + i, f"x{i} {mails[i % 3]} Solo{i % 3} solo{i % 3} tail") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans, tokens = {}, {}
    for d, t in rows:
        spans[d] = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(brute.PERSONAL["email"], t)]
        kept = [(m.start(), m.end()) for m in re.finditer(r"\w+", t) if not any(a < m.end() and m.start() < b for a, b, _ in spans[d])]
        tokens[d] = [(a, b, t[a:b].lower()) for a, b in kept]
    every = collections.Counter(w for _, t in rows for w in (x.lower() for x in re.findall(r"\w+", t)))
    joint = collections.Counter()
    for d, t in rows:
        near = set()
        for a, b, e in spans[d]:
            left = [w for s, _, w in tokens[d] if s < a][-5:]
            right = [w for s, _, w in tokens[d] if s >= b][:5]
            near |= {(e, w) for w in left + right}
        own = collections.Counter(x.lower() for x in re.findall(r"\w+", t))
        for e, w in near:
            joint[e, w] += own[w]
    holding = collections.Counter(e for d, _ in rows for e in {x[2] for x in spans[d]})
    told = set()
    for (e, w), n in joint.items():
        likely, base = n / (every[w] + 1), holding[e] / len(rows)
        if likely * math.log(likely / base) / math.log(1 / base) >= pii.DISCLOSURE:
            told.add((e, w))
    want = {(d, s, e) for d, _ in rows for s, e, w in tokens[d] if any((x[2], w) in told for x in spans[d])}
    got = {(r.doc_id, *map(int, x.split(":")[1:])) for r in pii.report(docs).collect() for x in r.spans.split(",") if x.startswith("term:")}
    assert got == want and want


def test_many_addresses_in_one_text_take_linear_time(spark):
    import time

    def took(n):
        text = " ".join(f"word{i} m{i}@n.org" for i in range(n))
        docs = spark.createDataFrame([(1, text), (2, "none")], "doc_id bigint, text string")
        begin = time.time()
        assert pii.sanitised_documents(docs).filter("doc_id = 1").first().text.count("<EMAIL>") == n
        return time.time() - begin

    took(100)
    assert took(8000) < 30  # 170 kB; a square of the number would take minutes


def test_personal_data_has_no_python(spark):
    plan = pii.report(read(spark, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- language model --------------------------------------------------------


def test_scores_equal_the_plain_counts(spark, monkeypatch):
    import collections
    import math

    monkeypatch.setattr(lm_scores, "CHUNK_WORDS", 2000)
    for order in (1, 2, 3):
        for docs, rows in cases(spark):
            texts = [brute.alnum_words(t) for _, t in rows]
            counts = collections.Counter(tuple(w[i : i + n]) for w in texts for n in range(1, order + 1) for i in range(len(w) - n + 1))
            total = sum(map(len, texts))
            want = []
            for (d, _), w in zip(rows, texts):
                value = 0.0
                for i in range(len(w)):
                    longest = min(i + 1, order)
                    for n in range(longest, 0, -1):
                        gram = tuple(w[i - n + 1 : i + 1])
                        if n == 1 or (counts[gram] >= 2 and (n == 2 or counts[gram[:-1]] >= 2)):
                            base = total if n == 1 else counts[gram[:-1]]
                            value += math.log(counts[gram] / base) + math.log(0.4) * (longest - n)
                            break
                want.append((d, len(w), round(value / len(w), 6) if w else None))
            from loomlight.llm.frames import pick

            got = lm_scores.scores(pick(docs, doc_id="bigint", text="string"), ["doc_id"], order).collect()
            same([(r.doc_id, r.n_words, None if r.score is None else round(r.score, 6)) for r in got], want)


# ---- quality classifier ----------------------------------------------------


def test_held_out_accuracy(spark):
    import zlib

    docs, labels = read(spark, "documents", MIDDLE), read(spark, "labels", MIDDLE)
    got = quality_crf.report(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    tried = [r.predicted == marks[r.doc_id] for r in got if r.held_out and r.doc_id in marks]
    assert sum(tried) >= 0.93 * len(tried)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality_crf.report(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality_crf.report(docs, turned).collect()}


def test_marginals_equal_all_labellings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    first = np.array([0, 4, 5, 8])
    score, stay = rng.normal(size=8), np.array([0.7, -0.4])
    p, gg, bb, at = quality_crf.chain(score, first, stay)
    for a, b in zip(first[:-1], first[1:]):
        total, good = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            e = sum(score[a + i] for i, v in enumerate(y) if v)
            e += sum(stay[0] if u and v else stay[1] if not u and not v else 0 for u, v in zip(y, y[1:]))
            total += np.exp(e)
            good += np.exp(e) * np.array(y)
        assert np.allclose(p[a:b], good / total)
    assert np.all(gg + bb <= 1 + 1e-9) and len(at) == 5


def test_classifier_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(13)] + [(None, 1, "x"), (3, None, "x")], "doc_id bigint, quality int, Quality2 string")
    docs = tables.edge_docs(spark)
    assert docs.count() == len(quality_crf.report(docs, labels).collect())
    assert all(0 <= r.score <= 1 for r in quality_crf.report(docs, labels.limit(0)).collect())
    assert quality_crf.report(tables.no_docs(spark), labels).collect() == []


# ---- time on long inputs ----------------------------------------------------


def test_scans_take_time_by_length():
    import time

    begin = time.time()
    for text in ("cc by " * 170_000, "mit license cc by gnu general public license " * 22_000):
        found = licenses.scan(text.encode(), licenses.automaton())
        assert found[:5] == brute_places(text)
    for page in ("<div>" * 100_000 + "text", "<div>" * 60_000 + "</p>" * 60_000 + "text", "<nav>" + "<div>a</div>" * 80_000):
        html_text.main_text(page)
    assert time.time() - begin < 15


def brute_places(text):
    n, places, first, last, labels = brute.license_places(text, licenses.BASE)
    return n, places, first, last, set(labels.split(",")) if labels else set()


def test_prose_behind_a_licence_is_no_licence():
    def labels(text):
        return licenses.scan(text.encode(), licenses.automaton())[5]

    assert labels("SPDX-License-Identifier: MIT and see the rest") == {"mit"}
    assert labels("SPDX-License-Identifier: MIT or LicenseRef-Own") >= {"mit", "other"}
    assert labels("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0") == {"mit", "apache", "gpl"}
