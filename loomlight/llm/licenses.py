"""License scans: an automaton finds phrases and tags, and a shunting-yard parser reads expressions.

The words of a text, in lower case and parted by single spaces, go through one
Aho-Corasick automaton for all phrases. Where it finds an identifier tag, the expression
behind it is read from the text as it stands: identifiers with and, or, with and brackets.
A text is one row, and texts are independent, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.frames import ROW, field, map_texts, packed, pick, text_buffer
from loomlight.llm.wordhash import ALNUM

# The phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notices.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# How freely a text under a family of licences may be used, from 0 to 1.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "apache": 0.9,
    "zlib": 0.95, "cc-by": 0.85, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.45, "gpl": 0.3, "agpl": 0.2,
    "cc-by-nc": 0.1, "cc-by-nd": 0.1, "proprietary": 0.0, "other": 0.2,
}
#: What an exception behind "with" adds to a licence.
EXCEPTION = 0.2

_EXPRESSION = re.compile(r"spdx[^a-z0-9]*license[^a-z0-9]*identifier[^a-z0-9\n(]*([^\n\r*<>\"']*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_BINDING = {"or": 1, "and": 2, "with": 3}


def family(name: str) -> str:
    """The label of a licence identifier: its longest known beginning."""
    low = name.lower().rstrip("+")
    for known in sorted(FREEDOM, key=len, reverse=True):
        if low == known or low.startswith(known + "-"):
            return known
    return "cc-by" if low.startswith("cc-by") else "other"


def named(token: str, operator: str) -> bool:
    """Whether a token behind an operator is a licence, or an exception behind ``with``."""
    low = token.lower()
    return "exception" in low if operator == "with" else low.startswith("licenseref-") or family(token) != "other"


def parse(expression: str) -> list[str]:
    """The expression in postfix order by the shunting-yard method, as far as it can be read.

    It ends before the first token that cannot stand where it stands; operators and
    brackets that are still open then are dropped with what they lack. Behind an operator,
    a word that is no known licence or exception is prose, as in "MIT and see the rest".
    """
    out: list[str] = []
    waiting: list[str] = []
    wants_name = True
    depth = 0
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _BINDING:
            if wants_name:
                break
            while waiting and waiting[-1] != "(" and _BINDING[waiting[-1]] >= _BINDING[low]:
                out.append(waiting.pop())
            waiting.append(low)
            wants_name = True
        elif token == "(":
            if not wants_name:
                break
            waiting.append(token)
            depth += 1
        elif token == ")":
            if wants_name or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif wants_name:
            if waiting and waiting[-1] in _BINDING and not named(token, waiting[-1]):
                break
            out.append(token)
            wants_name = False
        else:
            break
    if wants_name:  # the last operator has nothing behind it, and may have brackets before it
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    out.extend(x for x in reversed(waiting) if x != "(")
    return out


def evaluate(postfix: list[str]) -> tuple[float, set[str]] | None:
    """Freedom of an expression and the labels in it: or offers the freer, and binds to the stricter."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token not in _BINDING:
            own = family(token)
            stack.append((FREEDOM[own], {own}))
            continue
        (b, more), (a, labels) = stack.pop(), stack.pop()
        if token == "with":  # the right side names an exception, not a licence
            stack.append((min(1.0, a + EXCEPTION), labels))
        else:
            stack.append(((max if token == "or" else min)(a, b), labels | more))
    return stack[-1] if stack else None


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in [*BASE, *MORE, TAG]:
        found.add_word(f" {phrase}", (phrase, len(phrase)))
    found.make_automaton()
    return found


_SPACES = bytes(ALNUM).replace(b"\0", b" ")


def scan(raw: bytes, machine) -> tuple[int, int, int | None, int | None, set[str], set[str], float]:
    """Words, base places, first and last base place, base labels, all labels, score of one text."""
    words = raw.translate(_SPACES).split(b" ")
    words = [w for w in words if w]
    line = f" {b' '.join(words).decode('latin-1')} "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    tagged = False
    at, before = 0, 0  # words before a place, counted on from the last place
    for end, (phrase, size) in machine.iter(line):
        if line[end + 1] != " ":
            continue
        if phrase in BASE:
            start = end - size
            before += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            starts.append(before)
            base.add(BASE[phrase])
        elif phrase in MORE:
            labels.add(MORE[phrase])
        else:
            tagged = True
    labels |= base
    freedom = [FREEDOM[x] for x in labels]
    if tagged:
        for found in _EXPRESSION.finditer(raw.decode("utf-8", "replace")):
            value = evaluate(parse(found[1]))
            if value:
                freedom.append(value[0])
                labels |= value[1]
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, base, labels, min(freedom, default=0.0)


def scanned(docs: DataFrame, carry: list[str]) -> DataFrame:
    """For each row of ``docs`` (text and ``carry``): n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` says how freely the text may be used: the least freedom of the notices and
    expressions found, 0 if there are none. Null and empty texts have no words and no
    labels; repeated rows get the same.
    """
    fields = [
        field("n_words", "bigint"), field("n_base", "bigint"), field("first_word", "bigint"),
        field("last_word", "bigint"), field("base_labels", "array<string>"), field("labels", "array<string>"),
        field("score", "double"),
    ]

    def make():
        machine = automaton()

        def work(texts):
            data, bounds = text_buffer(texts)
            raw = data.tobytes()
            rows = [scan(raw[a:b], machine) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            columns = list(zip(*rows)) if rows else [[]] * 7
            names = [[sorted(x) for x in columns[i]] for i in (4, 5)]
            longs = [pa.array(columns[i], pa.int64()) for i in range(4)]
            lists = [pa.array(x, pa.list_(pa.string())) for x in names]
            return [*longs, *lists, pa.array(columns[6], pa.float64())]

        return work

    return map_texts(docs, "text", carry, fields, make)


def with_licenses(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as a struct ``document`` beside what :func:`scanned` finds in them."""
    found = scanned(packed(docs, text="string"), [ROW])
    names = F.struct(*[F.col(ROW)[f"_c{i}"].alias(c) for i, c in enumerate(docs.columns)])
    return found.select(names.alias("document"), *[c for c in found.columns if c != ROW])


def report(docs: DataFrame) -> DataFrame:
    """As :func:`scanned` with doc_id, labels joined by commas."""
    found = scanned(pick(docs, doc_id="bigint", text="string"), ["doc_id"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
