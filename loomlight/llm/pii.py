"""Personal data: patterns find it, and corpus co-occurrence finds the terms that give it away.

An entity is a value that a pattern found (an address, a number). Candidate terms are the
words that stand within five words of it. How likely the entity is where the term stands is
estimated from counts over the corpus: the term's occurrences in documents where it stands
near the entity, over all its occurrences and one more, so that a word seen once proves
little. What that tells of the entity is the information gained, as a share of the entity's
information content, times that likelihood. Terms beyond a threshold are generalised to a
placeholder in all places of every document that holds the entity, and removed if they
disclose nearly all.

All of it is DataFrame expressions. Places of matches follow from the lengths of the
matches and of the parts between them. The patterns match what their plain forms match,
but loops that cannot give anything back are possessive, and matches start where a run
starts, so that very long runs cost neither stack nor square time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.llm.frames import ROW, may_be_in, maybe_in, packed, pick, unpacked
from loomlight.llm.quality_rules import let
from loomlight.session import stored

#: The kinds in the order of their listing, with their patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "phone": "+"}
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words on each side of an entity that are its candidates.
WORDS = 5
#: Least share of the entity's information that a term discloses, and from which on it is removed.
DISCLOSURE, REMOVED = 0.6, 0.8
#: Occurrences that a term is taken to have elsewhere, beyond those seen.
ELSEWHERE = 1
#: Matches that one list holds while places are worked out, so that long lists are not copied for each.
CHUNK = 256

_SPAN = "array<struct<s:int,e:int,v:string>>"


def scanned(items: Column, zero: Column, plus, value, emit, kind: str) -> Column:
    """``emit(state, x)`` of each item, the state being the sum of ``value(x)`` over the items before it.

    ``plus`` adds two states, ``kind`` is the type of what is given. Lists of CHUNK items are
    walked on their own, from the sum over the lists before, as Spark copies what a walk holds
    at each step: a long list then takes time by its length, not its square.
    """

    def run(own: Column) -> Column:
        part = lambda c: F.slice(own, c * CHUNK + 1, F.lit(CHUNK))
        total = lambda xs: F.aggregate(xs, zero, lambda a, x: plus(a, value(x)))
        at = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int"))
        none = F.array_compact(F.array(F.when(F.lit(False), zero)))
        starts = F.aggregate(
            F.transform(at, lambda c: total(part(c))), F.struct(zero.alias("now"), none.alias("out")),
            lambda a, x: F.struct(plus(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")),
            lambda a: a["out"],
        )

        def walked(y: Column) -> Column:
            start = F.struct(y["start"].alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
            step = lambda a, x: F.struct(
                plus(a["now"], value(x)).alias("now"), F.concat(a["out"], F.array(emit(a["now"], x))).alias("out")
            )
            return F.aggregate(part(y["c"]), start, step, lambda a: a["out"])

        return F.flatten(F.transform(F.arrays_zip(at.alias("c"), starts.alias("start")), walked))

    return let(items, lambda own: F.when(F.size(own) == 0, F.array().cast(f"array<{kind}>")).otherwise(run(own)))


_PLACE = "struct<s:int,e:int,v:string>"


def located(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as structs of start, end (code points, exclusive) and value."""

    def placed(x: Column) -> Column:
        m, gaps = x["m"], x["gaps"]
        items = F.transform(
            m, lambda v, i: F.struct(F.length(gaps[i]).alias("gap"), F.length(v).alias("own"), v.alias("v"))
        )
        return scanned(
            items, F.lit(0), lambda a, b: a + b, lambda y: y["gap"] + y["own"],
            lambda at, y: F.struct((at + y["gap"]).alias("s"), (at + y["gap"] + y["own"]).alias("e"), y["v"].alias("v")),
            _PLACE,
        )

    def found(m: Column) -> Column:
        both = F.struct(m.alias("m"), F.split(text, pattern, -1).alias("gaps"))
        return F.when(F.size(m) == 0, F.array().cast(_SPAN)).otherwise(let(both, placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), found)


def _small(part: Column) -> Column:
    """Whether a run of digits is at most 255, however many zeros lead it."""
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + weight(i))
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: let(_digits(v), lambda d: F.length(d).between(12, 19) & _luhn(d)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
ENTITY = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits}


def base_spans(text: Column) -> Column:
    """Structs (s, k, e, v): start, index of the kind, end, value; by start, then kind."""
    def of_kind(k: int, kind: str, pattern: str) -> Column:
        own = F.filter(located(text, pattern), lambda x: VALID[kind](x["v"]))
        shaped = F.transform(
            own, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v"))
        )
        if kind not in HINTS:
            return shaped
        none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
        return F.when(F.contains(text, F.lit(HINTS[kind])), shaped).otherwise(none)

    each = [of_kind(k, kind, pattern) for k, (kind, pattern) in enumerate(PATTERNS.items())]
    return F.array_sort(F.concat(*each))


def _entity(x: Column) -> Column:
    kinds = list(PATTERNS)
    value = F.lit(None).cast("string")
    for k, kind in enumerate(kinds):
        value = F.when(x["k"] == k, F.concat(F.lit(f"{kind}:"), ENTITY[kind](x["v"]))).otherwise(value)
    return value


def words_of(text: Column) -> Column:
    """The words of a text as :func:`located` gives them; A-Z match as small letters, places are the text's own."""
    return located(F.translate(text, CAPITALS, SMALL), TERM)


def _apart(words: Column, spans: Column) -> Column:
    """(words, after): the words that touch no span, and how many of them stand before each span.

    Words and spans are walked together in the order of their starts. A word touches a span
    that has begun before and not ended, or one that begins inside it, which comes next.
    """
    merged = F.array_sort(F.concat(
        F.transform(words, lambda w: F.struct(w["s"].alias("s"), F.lit(1).alias("word"), w["e"].alias("e"), w["v"].alias("v"))),
        F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("word"), x["e"].alias("e"), F.lit("").alias("v"))),
    ))

    def judged(own: Column) -> Column:
        follows = F.transform(
            own,
            lambda x, i: F.struct(
                x.alias("x"), F.when(F.get(own, i + 1)["word"] == 0, F.get(own, i + 1)["s"]).alias("next_span")
            ),
        )
        kept = scanned(
            follows, F.lit(0), lambda a, b: F.greatest(a, b), lambda y: F.when(y["x"]["word"] == 0, y["x"]["e"]).otherwise(0),
            lambda end, y: F.struct(
                y["x"]["s"].alias("s"), y["x"]["e"].alias("e"), y["x"]["v"].alias("v"), (y["x"]["word"] == 0).alias("span"),
                ((y["x"]["word"] == 1) & (y["x"]["s"] >= end) & ~F.coalesce(y["next_span"] < y["x"]["e"], F.lit(False))).alias("kept"),
            ),
            "struct<s:int,e:int,v:string,span:boolean,kept:boolean>",
        )

        def both(items: Column) -> Column:
            before = scanned(
                items, F.lit(0), lambda a, b: a + b, lambda y: y["kept"].cast("int"),
                lambda n, y: F.struct(n.alias("n"), y["span"].alias("span")), "struct<n:int,span:boolean>",
            )
            plain = lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), y["v"].alias("v"))
            return F.struct(
                F.transform(F.filter(items, lambda y: y["kept"]), plain).alias("words"),
                F.transform(F.filter(before, lambda y: y["span"]), lambda y: y["n"]).alias("after"),
            )

        return let(kept, both)

    return let(merged, judged)


def context(text: Column, spans: Column) -> Column:
    """Structs (entity, term): the words within WORDS words of each span, none of them touching a span."""

    def near(x: Column) -> Column:
        words, after = x["words"], x["after"]
        each = F.arrays_zip(spans.alias("span"), after.alias("n"))

        def of_span(y: Column) -> Column:
            begin = F.greatest(y["n"] - WORDS, F.lit(0))
            own = F.slice(words, begin + 1, y["n"] - begin + WORDS)
            pair = lambda entity: F.transform(own, lambda w: F.struct(entity.alias("entity"), F.lower(w["v"]).alias("term")))
            return let(_entity(y["span"]), pair)

        return F.flatten(F.transform(each, of_span))

    return let(_apart(words_of(text), spans), near)


def occurrences(docs: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """(key, term, s, e) of the words of ``docs`` (key, text) that may be asked for: of ``asked``, all are there.

    ``on`` names what is asked: terms, or terms of one key.
    """
    words = docs.select("key", F.explode(words_of(F.col("text"))).alias("w"))
    said = words.select("key", F.lower("w.v").alias("term"), "w.s", "w.e").withColumn("h", F.xxhash64(*on))
    return maybe_in(said, "h", asked.select(F.xxhash64(*on).alias("h"))).drop("h")


def disclosing(found: DataFrame, holding: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, share): terms that disclose at least DISCLOSURE of the entity.

    ``found`` has a key, the spans and the context of each row that has spans, ``holding`` the
    key and the text of these, ``docs`` those of all. Rows of one key count once for the
    entities and the terms near them, and as often as they stand there for all else.
    """
    pairs = stored(found.select("key", F.explode("context").alias("c")).select("key", "c.entity", "c.term").distinct(), "pairs")
    asked = pairs.select("key", "term").distinct()
    times = occurrences(holding, asked, ["key", "term"]).groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"))
    joint = stored(pairs.join(times, ["key", "term"]).groupBy("entity", "term").agg(F.sum("n").alias("n")), "joint")
    entity = F.explode(F.array_distinct(F.transform("spans", _entity)))
    of_entity = found.select("key", entity.alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    spoken = F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(TERM), 0)
    said = docs.select(F.explode(spoken).alias("term")).withColumn("term", F.lower("term"))
    said = said.withColumn("h", F.xxhash64("term"))
    terms = joint.select(F.xxhash64("term").alias("h")).distinct()
    of_term = maybe_in(said, "h", terms).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = docs.agg(F.count(F.lit(1))).scalar()
    known = joint.join(of_term, "term").join(of_entity, "entity").withColumn("n_all", total)
    likely = F.col("n") / (F.col("n_term") + ELSEWHERE)
    base = F.least(F.col("n_entity") / F.col("n_all"), F.lit(1.0))
    share = F.when(base < 1, likely * F.log(likely / base) / F.log(1 / base)).otherwise(F.lit(0.0))
    return known.select("entity", "term", share.alias("share")).filter(F.col("share") >= DISCLOSURE)


def examined(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, spans and terms for each row of ``docs`` (doc_id, text and ``carry``).

    ``spans`` are the base spans, ``terms`` the sorted places of disclosing terms (s, e,
    share) of the text. Null and empty texts have neither; repeated rows get the same.
    """
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    found = stored(with_spans(keyed, carry), "spans")
    told = told_terms(found, keyed.select("key", "text"))
    return with_terms(found.drop("context"), told).select(*carry, "spans", "terms")


def with_spans(keyed: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, key, spans and the context of the spans of each row; no context where there are no spans."""
    text = F.coalesce("text", F.lit(""))
    found = keyed.select(*carry, "key", text.alias("_text"), let(text, base_spans).alias("spans"))
    both = let(F.struct("_text", "spans"), lambda x: F.when(F.size(x["spans"]) > 0, context(x["_text"], x["spans"])))
    return found.select(*carry, "key", "spans", both.alias("context"))


def told_terms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, terms) of the rows that have disclosing terms: each place of such a term in a text that holds its entity."""
    rows = stored(found.filter(F.size("spans") > 0).select("key", "spans", "context").dropDuplicates(["key"]), "rows")
    holding = maybe_in(docs, "key", rows).join(rows.select("key"), "key", "left_semi").dropDuplicates(["key"])
    holding = stored(holding, "holding")
    told = stored(disclosing(rows, holding, docs), "disclosing")
    places = occurrences(holding, told, ["term"]).join(told, "term")
    held = rows.select("key", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
    hits = places.join(held, ["key", "entity"], "left_semi").groupBy("key", "s", "e").agg(F.max("share").alias("share"))
    # a term inside a span goes with the span
    spans = rows.select("key", F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("spans"))
    listed = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "e", "share"))).alias("terms"))
    return listed.join(spans, "key").select("key", outside(F.col("terms"), F.col("spans")).alias("terms"))


def outside(terms: Column, spans: Column) -> Column:
    """The places (s, e, share) that touch no span; their words are told apart by where they begin and end."""
    words = F.transform(terms, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["share"].cast("string").alias("v")))
    kept = let(_apart(words, spans), lambda x: x["words"])
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].cast("double").alias("share")))


def with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<s:int,e:int,share:double>>")
    return rows.join(terms, "key", "left").withColumn("terms", F.coalesce("terms", none))


def sanitised(text: Column, spans: Column, terms: Column) -> Column:
    """The text with spans and generalised terms as placeholders, and fully disclosing terms removed."""
    names = F.array(*[F.lit(f"<{kind.upper()}>") for kind in PATTERNS])
    marked = F.concat(
        F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), names[x["k"]].alias("by"))),
        F.transform(
            terms,
            lambda x: F.struct(
                x["s"].alias("s"), x["e"].alias("e"),
                F.when(x["share"] >= REMOVED, F.lit("")).otherwise(F.lit("<TERM>")).alias("by"),
            ),
        ),
    )
    def replaced(own: Column) -> Column:
        parts = scanned(
            own, F.lit(0), lambda a, b: F.greatest(a, b), lambda x: x["e"],
            lambda at, x: F.when(
                x["s"] >= at, F.concat(F.substring(text, at + 1, x["s"] - at), x["by"])
            ).otherwise(""),
            "string",
        )
        end = F.array_max(F.transform(own, lambda x: x["e"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(marked) == 0, text).otherwise(let(F.array_sort(marked), replaced))


def sanitised_documents(docs: DataFrame) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced; n_chars follows the text.

    Spans are found in one pass and written without texts. Only documents that may have
    some meet them again by key; all others pass as they are.
    """
    whole = packed(docs, doc_id="bigint", text="string").withColumn("key", F.xxhash64("doc_id", "text"))
    found = stored(with_spans(whole, []).filter(F.size("spans") > 0), "spans")
    marks = with_terms(found.drop("context").dropDuplicates(["key"]), told_terms(found, whole.select("key", "text")))
    marks = stored(marks, "marks")
    sifted = may_be_in(whole, "key", marks)
    met = sifted.filter("may_be").drop("may_be").join(marks, "key", "left")
    changed = F.when(F.col("spans").isNull(), F.col("text")).otherwise(sanitised(F.col("text"), F.col("spans"), F.col("terms")))
    clean = met.select(ROW, changed.alias("text"))
    clean = clean.unionByName(sifted.filter("NOT may_be").select(ROW, "text"))
    columns = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.length("text").cast(kind)
    return unpacked(clean, docs.columns, **columns)


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in [*PATTERNS, "term"]])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of each kind, base_sha256 and spans."""
    found = examined(pick(docs, doc_id="bigint", text="string"), ["doc_id"])
    bare = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    more = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), F.lit(len(PATTERNS)).alias("k"), x["e"].alias("e")))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("bigint")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select(
        "doc_id", *counts, F.sha2(_shown(bare).cast("binary"), 256).alias("base_sha256"),
        _shown(F.array_sort(F.concat(bare, more))).alias("spans"),
    )
