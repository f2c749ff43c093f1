"""Which class each line of a source lies in: strings, comments, openings and ends.

A first scan finds in what state each line begins: in code, inside a string or a block
comment, and whether a class word, a class name or ``end`` still waits for what follows it.
The function of a line has one entry for each such state. A second scan carries the names of
the open classes; what a line does to them is some names taken off and some put on. Both run
in blocks (:func:`loomlight.operators.scans.block_scan`), so a huge file is no single task.

A file of at most one block begins in a known state, so its lines need no functions: given as
a text, it is read through in its own row (:func:`nested_texts`), and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import text as T
from loomlight.operators.ordering import partitions
from loomlight.operators.scans import SIZE, block_scan
from loomlight.session import stored

#: States at the start of a line, and a text that leads into each: code, a class word without
#: name, a name that may be followed by "=", an "end" without name; a string; a block comment,
#: also behind each of the three. A class word is written behind its state's two letters.
LEADS = {
    "C": "", "CK": "\x01 ", "CN": "\x01 \x02 ", "CE": "end ", "S": '"',
    "B": "/*", "BK": "\x01 /*", "BN": "\x01 \x02 /*", "BE": "end /*",
}
#: What a blank line does, and one of plain code up to a semicolon.
BLANK = ["C", "CK\x01", "CN", "CE", "S", "B", "BK\x01", "BN", "BE"]
PLAIN = ["C", "C", "C", "C", "S", "B", "BK\x01", "BN", "BE"]
#: What begins a string, a quoted name or a comment.
SIGNS = ['"', "'", "/*", "//"]
OPENING_WORDS = "model class package function record block connector type operator \x01".split(" ")
AWAITS_NAME = rf"{T.LEAD}({T.OPENING_WORD})(?:\s+extends)?\s*\z"
AWAITS_EQUALS = rf"{T.LEAD}{T.OPENING_WORD}\s+(?:extends\s+)?{T.NAME}\s*\z"
AWAITS_END = rf"{T.LEAD}end\s*\z"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _holds(text: Column, parts: list[str]) -> Column:
    """Whether any of the parts stands in the text; a look at plain signs saves most lines the patterns."""
    return reduce(or_, [F.contains(text, F.lit(part)) for part in parts])


def _code(text: Column) -> Column:
    """A text with a lone quote for each string and blanks for comments; only an open one leaves its sign at the end."""
    bare = lambda t: F.when(_holds(t, SIGNS), F.regexp_replace(t, T.NO_CODE, "$1$2 $3$4")).otherwise(t)
    return _with(text, bare)


def _body(code: Column) -> Column:
    n_signs = F.when(F.endswith(code, F.lit('"')), 1).when(F.endswith(code, F.lit("/*")), 2).otherwise(0)
    return F.substring(code, F.lit(1), F.length(code) - n_signs)


def _waits(body: Column) -> Column:
    """What the end of a code text waits for: K and a class word, N, E or nothing."""

    def waits(text: Column) -> Column:
        opens = F.when(_holds(text, OPENING_WORDS), F.regexp_extract(text, AWAITS_NAME, 1))
        ends = F.when(F.contains(text, F.lit("end")) & text.rlike(AWAITS_END), "E").otherwise("")
        named = lambda word: (
            F.when(word != "", F.concat(F.lit("K"), word)).when(word.isNotNull() & text.rlike(AWAITS_EQUALS), "N").otherwise(ends)
        )
        return _with(opens, named)

    return _with(body, waits)


def _trimmed(line: Column) -> Column:
    return F.rtrim(line, F.lit(" \t\n\x0b\f\r"))


def _kind(line: Column) -> Column:
    """Most lines end in a semicolon or hold no string or comment, and need no look at their signs."""
    trimmed = _trimmed(line)
    mixed = _holds(line, [*SIGNS, "*/"])
    kinds = F.when(trimmed == "", "blank").when(mixed, "mixed")
    return kinds.when(F.endswith(trimmed, F.lit(";")), "plain").otherwise("code")


def _after(code: Column, lead: Column) -> Column:
    """The state behind a line, given its code and what code came before it."""
    waits = _waits(F.concat(lead, _body(code)))
    return F.when(F.endswith(code, F.lit('"')), "S").otherwise(
        F.concat(F.when(F.endswith(code, F.lit("/*")), "B").otherwise("C"), waits)
    )


def _entry(state: Column, function: Column) -> Column:
    """What a line's function makes of a state; \\x01 is the word that the state has."""
    place = F.array_position(_strings(LEADS), F.substring(state, 1, 2)).cast("int")
    return F.replace(F.element_at(function, place), F.lit("\x01"), F.substring(state, 3, 99))


def line_functions(lines: DataFrame) -> DataFrame:
    """Add ``_step``: for each state in which a line may begin, the one in which the next line begins."""
    line = F.col("line")
    seen = lines.withColumn("_kind", _kind(line))
    mixed = F.col("_kind") == "mixed"
    for name, lead in (("_in_code", ""), ("_in_text", '"'), ("_in_remark", "/*")):
        seen = seen.withColumn(name, F.when(mixed, _code(F.concat(F.lit(lead), "line"))))
    seen = seen.withColumn("_own", F.when(F.col("_kind") == "code", F.concat(F.lit("C"), _waits(line))))
    begun = {"C": "_in_code", "S": "_in_text", "B": "_in_remark"}
    froms = [
        F.struct(F.col(begun[state[0]]).alias("code"), F.lit(lead.rstrip('/*"')).alias("lead"))
        for state, lead in LEADS.items()
    ]
    full = F.transform(F.array(*froms), lambda x: _after(x["code"], x["lead"]))
    own = F.col("_own")
    word = F.concat(F.lit("C"), _waits(F.concat(F.lit("\x01 "), line)))
    code = F.array(own, word, own, own, *[F.lit(v) for v in BLANK[4:]])
    step = (
        F.when(F.col("_kind") == "blank", _strings(BLANK))
        .when(F.col("_kind") == "plain", _strings(PLAIN))
        .when(mixed, full)
        .otherwise(code)
    )
    return seen.withColumn("_step", step).drop("_kind", "_in_code", "_in_text", "_in_remark", "_own")


def _unmarked(text: Column) -> Column:
    return F.when(_holds(text, ["\x01", "\x02"]), F.translate(text, "\x01\x02", "  ")).otherwise(text)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _state_after(state: Column, line: Column) -> Column:
    """The state behind a line that begins in a known state; :func:`line_functions` for one state."""
    in_code = F.startswith(state, F.lit("C"))
    second = F.substring(state, 2, 1)
    begun = F.when(in_code, "").when(state == "S", '"').otherwise("/*")
    lead = F.when(second == "K", "\x01 ").when(second == "N", "\x01 \x02 ").when(second == "E", "end ").otherwise("")
    mixed = _with(_code(F.concat(begun, line)), lambda code: _after(code, lead))
    plain = F.concat(F.lit("C"), _waits(F.when(second == "K", F.concat(F.lit("\x01 "), line)).otherwise(line)))
    named = lambda after: F.replace(after, F.lit("\x01"), F.substring(state, 3, 99))
    trimmed = _trimmed(line)
    return (
        F.when(trimmed == "", state)
        .when(_holds(line, [*SIGNS, "*/"]), named(mixed))
        .when(~in_code, state)
        .when(F.endswith(trimmed, F.lit(";")), "C")
        .otherwise(named(plain))
    )


def line_states(lines: DataFrame, size: int = SIZE) -> DataFrame:
    """(file, line_no, line) with the ``state`` at the start of each line."""
    clean = lines.select("file", "line_no", _unmarked(F.col("line")).alias("line"))
    return block_scan(
        clean, "file", "line_no", line_functions, _strings(BLANK),
        lambda f, g: F.transform(f, lambda state: _entry(state, g)), F.lit("C"), _entry, "state", size,
    )


NO_EVENTS = "array<struct<kind:string,restriction:string,name:string>>"
MAY_HOLD_EVENTS = [*OPENING_WORDS, "end", "within"]


def _events(line: Column, state: Column) -> Column:
    """What a line opens, ends and names, as (kind, restriction, name) in order."""
    place = F.array_position(_strings(LEADS), F.substring(state, 1, 2)).cast("int")
    may = _holds(line, MAY_HOLD_EVENTS) | (F.length(state) > 1)
    text = F.when(may, F.concat(F.element_at(_strings(LEADS.values()), place), line))
    found = _with(_code(text), lambda code: F.regexp_extract_all(_body(code), F.lit(T.EVENT), F.lit(0)))
    parts = F.transform(
        found,
        lambda e: F.struct(
            e.alias("text"), F.regexp_extract(e, rf"({T.NAME})\s*=?\z", 1).alias("name"),
            F.regexp_extract(e, rf"\A({T.OPENING_WORD})", 1).alias("word"),
        ),
    )

    def event(p):
        is_short = F.endswith(p["text"], F.lit("="))
        before = p["name"] == "\x02"  # the name stands on an earlier line, where it has opened its class
        kind = (
            F.when(F.startswith(p["text"], F.lit("redeclare")) | (before & ~is_short), "none")
            .when(before | F.startswith(p["text"], F.lit("end")), "end")
            .when(F.startswith(p["text"], F.lit("within")), "within")
            .when(is_short, "short")
            .otherwise("open")
        )
        restriction = F.when(p["word"] == "\x01", F.substring(state, 3, 99)).otherwise(p["word"])
        within = F.regexp_extract(p["text"], r"\Awithin\s+([\w.]+)\z", 1)
        return F.struct(
            kind.alias("kind"), restriction.alias("restriction"), F.when(within != "", within).otherwise(p["name"]).alias("name")
        )

    events = F.filter(F.transform(parts, event), lambda x: x["kind"] != "none")
    return F.coalesce(events, F.array().cast(NO_EVENTS))


def with_events(states: DataFrame) -> DataFrame:
    """Add ``events``: what a line opens, ends and names, as (kind, restriction, name) in order."""
    return states.withColumn("events", _events(F.col("line"), F.col("state")))


def _names_put_on(event: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(event["kind"] == "open", F.array(event["name"])).when(
        event["kind"] == "within", F.split(event["name"], r"\.")
    ).otherwise(none)


def _moved(off: Column, names: Column) -> Column:
    return F.struct(off.cast("int").alias("off"), names.alias("names"))


def _compose(f: Column, g: Column) -> Column:
    """Names taken off and then put on, by f and then by g."""
    left = F.greatest(F.size(f["names"]) - g["off"], F.lit(0))
    below = F.greatest(g["off"] - F.size(f["names"]), F.lit(0))
    return _moved(f["off"] + below, F.concat(F.slice(f["names"], F.lit(1), left), g["names"]))


def _names_after(stack: Column, f: Column) -> Column:
    kept = F.greatest(F.size(stack) - f["off"], F.lit(0))
    return F.concat(F.slice(stack, F.lit(1), kept), f["names"])


def _move(event: Column) -> Column:
    return _moved(F.when(event["kind"] == "end", 1).otherwise(0), _names_put_on(event))


def _nothing() -> Column:
    return _moved(F.lit(0), F.array().cast("array<string>"))


def nested(lines: DataFrame, size: int = SIZE) -> DataFrame:
    """(file, line_no, line, state, events, scope): ``scope`` has the names of the classes open at the line's start.

    The names of the ``within`` clause come first. An ``end`` without an open class ends
    nothing. The result is stored, as classes, declarations and imports all read it.
    """
    moves = F.aggregate("events", _nothing(), lambda acc, e: _compose(acc, _move(e)))
    step = F.when(F.size("events") > 0, moves).otherwise(_nothing())
    prepare = lambda states: with_events(states).withColumn("_step", step)
    none = F.array().cast("array<string>")
    return stored(
        block_scan(
            line_states(lines, size), "file", "line_no", prepare, _nothing(), _compose, none, _names_after, "scope", size
        ),
        "structure",
    )


def _begun(items: Column, start: str, after: Callable[[Column, Column], Column]) -> Column:
    """For each item the text state in which it begins.

    States are gathered in one text: an array would be copied with all of its strings at each step.
    """
    states = F.aggregate(
        items,
        F.struct(F.lit(start).alias("now"), F.lit("").alias("out")),
        lambda acc, x: F.struct(after(acc["now"], x).alias("now"), F.concat(acc["out"], acc["now"], F.lit("\x02")).alias("out")),
        lambda acc: acc["out"],
    )
    return F.split(states, "\x02")


def _marked_names_after(names: Column, event: Column) -> Column:
    """:func:`_names_after` one event, for names in one text, with \\x01 before each."""
    last = F.substring_index(names, "\x01", -1)
    put_on = F.when(event["kind"] == "within", F.replace(event["name"], F.lit("."), F.lit("\x01"))).otherwise(event["name"])
    return (
        F.when(event["kind"] == "end", F.substring(names, F.lit(1), F.length(names) - F.length(last) - 1))
        .when(event["kind"].isin("open", "within"), F.concat(names, F.lit("\x01"), put_on))
        .otherwise(names)
    )


def _short_nested(texts: DataFrame) -> DataFrame:
    """:func:`nested` of texts that are each a whole file and are read through in their row."""
    held = F.zip_with("_lines", "_states", lambda line, state: _events(line, state))

    def moved(names: Column, events: Column) -> Column:
        return F.when(F.size(events) > 0, F.aggregate(events, names, _marked_names_after)).otherwise(names)

    read = texts.select("file", T.lines(_unmarked(F.col("text"))).alias("_lines"))
    read = read.withColumn("_states", F.slice(_begun(F.col("_lines"), "C", _state_after), F.lit(1), F.size("_lines")))
    read = read.withColumn("_events", held).withColumn("_scopes", _begun(F.col("_events"), "", moved))
    scopes = F.slice("_scopes", F.lit(1), F.size("_lines")).alias("_scopes")
    lines = read.select("file", F.posexplode(F.arrays_zip("_lines", "_states", "_events", scopes)).alias("pos", "x"))
    scope = F.col("x._scopes")
    names = F.when(scope == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(scope, F.lit(2), F.length(scope)), "\x01"))
    return lines.select(
        "file", (F.col("pos") + 1).alias("line_no"), F.col("x._lines").alias("line"), F.col("x._states").alias("state"),
        F.col("x._events").alias("events"), names.alias("scope"),
    )


def nested_texts(files: DataFrame, size: int = SIZE) -> DataFrame:
    """:func:`nested` of the lines of (file, text).

    Only files of more than ``size`` lines, and those that come in several rows, go through the scans.
    The texts are spread first, as the rows that they are written from may lie in few splits.
    """
    texts = files.select("file", "text").repartition(partitions(files), "file")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    counts = texts.groupBy("file").agg(F.count(F.lit(1)).alias("_rows"), F.max(n_lines).alias("_lines"))
    others = stored(counts.filter((F.col("_rows") > 1) | (F.col("_lines") > size)).select(F.col("file").alias("_file")), "files")
    if others.isEmpty():
        return stored(_short_nested(texts), "structure")
    is_other = F.col("file").eqNullSafe(F.col("_file"))
    scanned = nested(_lines_of(texts.join(others, is_other, "left_semi")), size)
    return stored(_short_nested(texts.join(others, is_other, "left_anti")), "structure").unionByName(scanned)


def _lines_of(texts: DataFrame) -> DataFrame:
    lines = texts.select("file", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return lines.select("file", (F.col("pos") + 1).alias("line_no"), "line")


def dotted(names: Column) -> Column:
    return F.nullif(F.array_join(names, "."), F.lit(""))


def classes(structure: DataFrame) -> DataFrame:
    """Classes by their full name: (class_name, parent, restriction, file, line_no)."""
    opened = F.aggregate(
        "events",
        F.struct(
            F.col("scope").alias("scope"),
            F.array().cast("array<struct<scope:array<string>,restriction:string,name:string>>").alias("out"),
        ),
        lambda acc, e: F.struct(
            _names_after(acc["scope"], _move(e)).alias("scope"),
            F.when(
                e["kind"].isin("open", "short"),
                F.concat(
                    acc["out"],
                    F.array(F.struct(acc["scope"].alias("scope"), e["restriction"].alias("restriction"), e["name"].alias("name"))),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return structure.select("file", "line_no", F.inline(opened)).select(
        F.concat_ws(".", "scope", "name").alias("class_name"), dotted(F.col("scope")).alias("parent"), "restriction",
        "file", "line_no",
    )


def imports(structure: DataFrame) -> DataFrame:
    """(scope, alias, target) of each import; the alias is null where all of ``target`` is meant.

    ``import A.B`` has the alias B, ``import A.{B, C}`` is two imports. A clause stands on one line.
    """
    code = F.when(F.startswith("state", F.lit("C")), _code(F.col("line"))).otherwise(F.lit(""))

    def each(clause):
        alias, target, more = (F.regexp_extract(clause, T.IMPORT, i) for i in (1, 2, 3))
        listed = F.split(F.regexp_replace(more, r"[\s.{}]", ""), ",")
        last = F.substring_index(target, ".", -1)
        entry = lambda a, t: F.struct(a.alias("alias"), t.alias("target"))
        return (
            F.when(F.contains(more, F.lit("*")), F.array(entry(F.lit(None).cast("string"), target)))
            .when(more != "", F.transform(listed, lambda x: entry(x, F.concat_ws(".", target, x))))
            .otherwise(F.array(entry(F.when(alias != "", alias).otherwise(last), target)))
        )

    clauses = F.regexp_extract_all(code, F.lit(T.IMPORT), F.lit(0))
    found = F.flatten(F.transform(clauses, each))
    return structure.select(F.array_join("scope", ".").alias("scope"), F.inline(found)).distinct()
