"""Quality rules whose thresholds come from the corpus, for each language and source.

Every measure of a document is a whole number. Its distribution in a group is kept as a
quantile sketch: counts of values cut to their two leading digits. Such sketches merge by
adding counts, need at most ninety counters for each power of ten, and give quantiles that
are at most a tenth too low. Fences are quartiles of the sketch moved outwards by four
interquartile ranges. A group with few documents takes the merged sketch of its language,
and a small language that of the whole corpus.

The measures are such as differ between all documents, so that the spread of a group, and
not a fixed number, says where its fence stands: punctuation for the characters, sameness
(how far the distinct words fall short of the words, on a log scale) and stutters. Repeated
lines are rare, so their sketch holds only the documents that have any. Documents that fail the
base rule go anyhow and are not in the sketches.

All of it is DataFrame expressions. Measures are written once; the thresholds, one row for
each group and measure, are written too, so Spark knows their size when it plans the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.llm.frames import ROW, packed, pick, unpacked
from loomlight.session import stored

WORD = r"[^\x20\x09-\x0D]+"
#: All but the punctuation of ASCII, in Java's words (twenty times as fast as ranges) and as ranges.
PLAIN, PLAIN_RANGES = r"\P{Punct}+", r"[^!-/:-@\[-`{-~]+"
RUN = 8

#: measure -> (least interquartile range, for groups of equal values; whether low values are
#: fenced off too; whether only documents with a value above zero are in the sketch)
MEASURES = {
    "punctuation": (5, False, False),
    "dup_lines": (20, False, True),
    "sameness": (5, False, False),
    "stutters": (3, False, False),
    "word_length": (20, True, False),
}
TWO_SIDED = [k for k, (_, both, _) in MEASURES.items() if both]
SPARSE = [k for k, (_, _, sparse) in MEASURES.items() if sparse]
#: Added to the words, characters and lines that counts are set against, so that one event
#: in a short text is no high rate.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 100, 200, 10
#: Interquartile ranges between a quartile and its fence.
REACH = 4
#: Documents below which a group takes the sketch of a larger one.
LEAST_GROUP = 50


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once for each row, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _covered(windows: Column) -> Column:
    """Words inside runs of eight whose hash stands at several places of ``windows``."""
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        found = F.filter(s, lambda x, k: near(x, k - 1) | near(x, k + 1))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct(
        (a["n"] + p + RUN - F.greatest(a["end"], p)).alias("n"), (p + RUN).alias("end")
    )
    return F.aggregate(let(placed, twins), start, step, lambda a: a["n"])


def repeated_words(hashes: Column) -> Column:
    """Words in runs of eight words that stand at least twice in the text."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - RUN + 1), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(RUN)))
    )
    none = F.lit(0).cast("bigint")
    counted = let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), none).otherwise(_covered(v)))
    return F.when(F.size(hashes) < RUN, none).otherwise(counted)


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, lang, source and the counts of each text, in one pass over the rows."""
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(
        F.regexp_extract_all(text, F.lit(WORD), 0),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n"),
            F.aggregate(w, zero, lambda s, x: s + F.length(x)).alias("chars"),
            let(
                F.transform(w, lambda x: F.xxhash64(x)),
                lambda h: F.struct(
                    repeated_words(h).alias("repeat"),
                    F.size(F.filter(h, lambda x, i: F.coalesce(F.get(h, i - 1) == x, F.lit(False)))).alias("stutter"),
                    F.size(F.array_distinct(h)).alias("distinct"),
                ),
            ).alias("again"),
        ),
    )
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    marks = F.length(F.regexp_replace(text, PLAIN, ""))
    counted = docs.select(
        *carry, F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        of_words.alias("w"), of_lines.alias("l"), symbols.cast("bigint").alias("n_symbols"), marks.cast("bigint").alias("n_marks"),
    )
    return counted.select(
        *carry, "lang", "source", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"),
        "n_symbols", F.col("l.dup").cast("bigint").alias("n_dup_lines"),
        F.col("w.again.repeat").alias("n_repeat_words"), F.col("l.n").cast("bigint").alias("n_lines"),
        F.col("w.again.stutter").cast("bigint").alias("n_stutters"),
        F.col("w.again.distinct").cast("bigint").alias("n_distinct"), "n_marks",
    )


def failed() -> Column:
    """The base rule: too few words, or too many of them in runs that repeat."""
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def rates() -> dict[str, Column]:
    """The measures, as whole numbers: thousandths, and hundredths of a character."""
    share = lambda a, b, prior: F.floor(F.col(a) * 1000 / (F.col(b) + prior)).cast("bigint")
    variety = F.ln(F.col("n_distinct") + 1.0) / F.ln(F.col("n_words") + 2.0)
    return {
        "punctuation": share("n_marks", "word_chars", PRIOR_CHARS),
        "dup_lines": share("n_dup_lines", "n_lines", PRIOR_LINES),
        "sameness": F.lit(1000) - F.floor(variety * 1000 + 1e-6).cast("bigint"),
        "stutters": share("n_stutters", "n_words", PRIOR_WORDS),
        "word_length": F.floor(F.col("word_chars") * 100 / F.greatest(F.col("n_words"), F.lit(1))).cast("bigint"),
    }


def thresholds(counted: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """(lang, source, hi_<measure>, lo_<measure>): the fences of each group that has rows above the base rule.

    A measure whose quartiles are equal takes its least interquartile range. In a group with
    no rows that count for a measure, and none in its language or anywhere, the quartiles are 0.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in rates().items()]))
    values = counted.filter(~failed()).select("lang", "source", each.alias("m")).select("lang", "source", "m.measure", "m.v")
    unit = F.pow(F.lit(10.0), F.greatest(F.length(F.col("v").cast("string")) - 2, F.lit(0))).cast("bigint")
    sketch = values.groupBy("lang", "source", "measure", (F.col("v") - F.col("v") % unit).alias("v")).agg(
        F.sum(F.when(F.col("measure").isin(SPARSE) & (F.col("v") == 0), 0).otherwise(1)).alias("n")
    )
    sketch = stored(sketch, "sketch")

    def quartiles(keys: list[str], level: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "measure", "v").agg(F.sum("n").alias("n"))
        below = W.partitionBy(*keys, "measure").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = merged.withColumn("upto", F.sum("n").over(below)).withColumn(
            "all", F.sum("n").over(W.partitionBy(*keys, "measure"))
        )
        return placed.groupBy(*keys, "measure").agg(
            F.struct(
                F.max("all").alias("n"),
                F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("v"))).alias("q1"),
                F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("v"))).alias("q3"),
            ).alias(level)
        )

    own = quartiles(["lang", "source"], "own")
    wider = own.join(quartiles(["lang"], "of_lang"), ["lang", "measure"]).join(
        quartiles([], "of_all"), ["measure"]
    )
    enough = lambda c: F.col(c)["n"] >= least_group
    chosen = F.when(enough("own"), F.col("own")).when(enough("of_lang"), F.col("of_lang")).otherwise(F.col("of_all"))
    slack = F.create_map(*[F.lit(x) for k, (least, _, _) in MEASURES.items() for x in (k, least)])
    spread = F.greatest(F.col("q")["q3"] - F.col("q")["q1"], slack[F.col("measure")]) * REACH
    fenced = wider.select(
        "lang", "source", "measure", chosen.alias("q")
    ).select("lang", "source", "measure", (F.col("q")["q1"] - spread).alias("lo"), (F.col("q")["q3"] + spread).alias("hi"))
    at = lambda c, k: F.max(F.when(F.col("measure") == k, F.col(c)))
    return fenced.groupBy("lang", "source").agg(
        *[at("hi", k).alias(f"hi_{k}") for k in MEASURES],
        *[at("lo", k).alias(f"lo_{k}") for k in TWO_SIDED],
    )


def judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and, for each row of ``docs`` (text, lang, source): the counts, base_failed, outside, kept.

    ``base_failed``: fewer than 20 words, or more than 30 of 100 words in runs of eight
    that repeat. ``outside`` lists the measures beyond their group's fences. A row is
    ``kept`` if neither holds. A null text has no words; a null language or source is
    the group with an empty name; repeated rows count as often as they stand there. Values that
    tie with a fence are inside. Texts have any length; an empty table has no rows.
    """
    counted = stored(measured(docs, carry), "measures")
    return verdicts(counted, stored(thresholds(counted), "thresholds"), carry)


def verdicts(counted: DataFrame, fences: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, the counts and verdicts of measured rows by the fences of their groups."""
    beyond = []
    for k, value in rates().items():
        out = value > F.col(f"hi_{k}")
        if k in TWO_SIDED:
            out = out | (value < F.col(f"lo_{k}"))
        beyond.append(F.when(out, F.lit(k)))
    out = counted.join(fences, ["lang", "source"], "left")
    return out.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed().alias("base_failed"), F.array_compact(F.array(*beyond)).alias("outside"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, all columns as they were.

    Texts are measured twice, once for the thresholds and once for the verdicts, so that
    only measures are written in between and no copy of the texts.
    """
    whole = packed(docs, text="string", lang="string", source="string")
    fences = stored(thresholds(stored(measured(whole, []), "measures")), "thresholds")
    return unpacked(verdicts(measured(whole, [ROW]), fences, [ROW]).filter("kept"), docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    found = judged(pick(docs, doc_id="bigint", text="string", lang="string", source="string"), ["doc_id"])
    return found.drop("outside")


def oracle() -> str:
    """The report in DuckDB's SQL, for tables whose doc_id is unique."""
    values = ", ".join(
        f"('{k}', {e})"
        for k, e in {
            "punctuation": f"n_marks * 1000 // (word_chars + {PRIOR_CHARS})",
            "dup_lines": f"n_dup_lines * 1000 // (n_lines + {PRIOR_LINES})",
            "sameness": "1000 - floor(ln(n_distinct + 1.0) / ln(n_words + 2.0) * 1000 + 1e-6)::BIGINT",
            "stutters": f"n_stutters * 1000 // (n_words + {PRIOR_WORDS})",
            "word_length": "word_chars * 100 // greatest(n_words, 1)",
        }.items()
    )
    slack = " ".join(f"WHEN '{k}' THEN {least}" for k, (least, _, _) in MEASURES.items())
    two_sided, sparse = (", ".join(f"'{k}'" for k in ks) for ks in (TWO_SIDED, SPARSE))
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split
), stutters AS (
  SELECT doc_id, count(*) FILTER (word = before) AS n_stutters, count(DISTINCT word) AS n_distinct,
    sum(length(word)) AS word_chars
  FROM (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM words) GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split)
), twice AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT doc_id, sum(least(8, coalesce(nxt, i + 8) - i)) AS n_repeat_words FROM twice GROUP BY doc_id
), counted AS (
  SELECT s.doc_id, s.lang, s.source, len(s.w)::BIGINT AS n_words,
    coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(s.t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_stutters, 0) AS n_stutters, coalesce(n_distinct, 0) AS n_distinct,
    length(regexp_replace(s.t, '{PLAIN_RANGES}', '', 'g'))::BIGINT AS n_marks
  FROM split s LEFT JOIN lines USING (doc_id) LEFT JOIN stutters USING (doc_id) LEFT JOIN repeats USING (doc_id)
), valued AS (
  SELECT doc_id, lang, source, m.measure, m.v
  FROM counted, LATERAL (VALUES {values}) AS m(measure, v)
  WHERE NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
), sketch AS (
  SELECT lang, source, measure, v - v % (10 ** greatest(length(v::VARCHAR) - 2, 0))::BIGINT AS v,
    count(*) FILTER (NOT (v = 0 AND measure IN ({sparse}))) AS n
  FROM valued GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang, source, measure, v, n FROM sketch
  UNION ALL SELECT 2, lang, NULL, measure, v, sum(n) FROM sketch GROUP BY lang, measure, v
  UNION ALL SELECT 3, NULL, NULL, measure, v, sum(n) FROM sketch GROUP BY measure, v
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY v) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, measure) AS total
  FROM levels
), quartiles AS (
  SELECT level, lang, source, measure, max(total) AS n,
    min(v) FILTER (upto * 4 >= total) AS q1, min(v) FILTER (upto * 4 >= total * 3) AS q3
  FROM placed GROUP BY level, lang, source, measure
), chosen AS (
  SELECT o.lang, o.source, o.measure,
    CASE WHEN o.n >= {LEAST_GROUP} THEN o.q1 WHEN l.n >= {LEAST_GROUP} THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN o.n >= {LEAST_GROUP} THEN o.q3 WHEN l.n >= {LEAST_GROUP} THEN l.q3 ELSE a.q3 END AS q3
  FROM quartiles o
  JOIN quartiles l ON l.level = 2 AND l.lang = o.lang AND l.measure = o.measure
  JOIN quartiles a ON a.level = 3 AND a.measure = o.measure
  WHERE o.level = 1
), fences AS (
  SELECT *, greatest(q3 - q1, CASE measure {slack} END) * {REACH} AS spread FROM chosen
), outside AS (
  SELECT v.doc_id, bool_or(v.v > f.q3 + f.spread OR (v.measure IN ({two_sided}) AND v.v < f.q1 - f.spread)) AS out
  FROM valued v JOIN fences f USING (lang, source, measure) GROUP BY v.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(out, false) AS kept
FROM counted LEFT JOIN outside USING (doc_id)
"""
