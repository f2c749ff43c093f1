"""Column functions over names and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words a Modelica source may use as keywords, and its primitive types.
KEYWORDS = """
algorithm and annotation block break class connect connector constant constrainedby
der discrete each else elseif elsewhen encapsulated end enumeration equation expandable
extends external false final flow for function if import impure in initial inner input
loop model not operator or outer output package parameter partial protected public pure
record redeclare replaceable return stream then true type when while within
""".split()
PRIMITIVE_TYPES = "Boolean Integer Real String".split()

# The closed list of suggestion kinds.
KINDS = "Type Variable Function Keyword Package Model Class Property".split()

# Declaration syntax. The whole line must match, so they are anchored
# with \A and \z; "$" would also match before a final line break.
MODIFIERS = r"(?:(?:parameter|discrete|input|output|flow)\s+)?"
DECLARATION = r"\A\s*" + MODIFIERS + r"(\w[\w\-.]*\s+\w[\w\-]*).*\z"
DECLARATION_COMMENT = r"\s\"([^\"]+)\";\z"
IDENTIFIER = r"(\w[\w\-]*)"
CLASS_PREFIXES = r"(?:(?:encapsulated|partial|final|expandable|operator|pure|impure)\s+)*"
CLASS_WORDS = r"(model|class|package|function|record|block|connector|type)"
CLASS_OPENING = r"\A\s*" + CLASS_PREFIXES + CLASS_WORDS + r"\s+([A-Za-z_]\w*)"
FUNCTION_INPUT = r"\binput\s+(\w+)\s+(\w+)"
# Words that open a class, and names, between texts that are no code. \x01 and \x02 stand for
# a word and a name on an earlier line.
LEAD = r"(?<![\w.'])"
OPENING_WORD = r"(?:model|class|package|function|record|block|connector|type|operator|\x01)"
OPENING_PREFIX = r"(?:replaceable|encapsulated|partial|final|inner|outer|expandable|operator|pure|impure)"
NAME = rf"(?:(?!(?:{OPENING_WORD}|extends)\b)[A-Za-z_]\w*|'(?:[^'\\]|\\.)*+'|\x02)"
IMPORT = LEAD + r"import\s+(?:([A-Za-z_]\w*)\s*=\s*)?([A-Za-z_][\w.]*\w|[A-Za-z_])\s*(\.\s*\*|\.\s*\{[^}]*\})?"
EVENT = (
    rf"{LEAD}redeclare\s+(?:{OPENING_PREFIX}\s+)*{OPENING_WORD}\s+{NAME}\s*="
    rf"|{LEAD}{OPENING_WORD}\s+(?:extends\s+)?{NAME}(?:\s*=(?!=))?"
    rf"|{LEAD}end\s+(?!(?:if|for|when|while)\b){NAME}"
    rf"|{LEAD}within\s+[A-Za-z_][\w.]*"
)
# Strings and comments, also ones that the line does not end; quoted names are code.
NO_CODE = (
    r"""(?s)('(?:[^'\\]|\\.)*+')|(")(?:[^"\\]|\\.)*+"|/\*.*?\*/|//.*"""
    r"""|(")(?:[^"\\]|\\.?)*+\z|(/\*).*\z"""
)
# A string is one token, so comment signs inside it are text.
COMMENT_TOKENS = r'(?s)"(?:[^"\\]|\\.)*+"|/\*.*?\*/|//[^\n]*|[^/"]+|[/"]'


def lines(text: Column) -> Column:
    """The lines of a text as an array; see :func:`loomlight.operators.corpus.corpus_lines`."""
    pieces = F.split(text, "\n")
    pieces = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    without_return = lambda raw: F.when(
        F.endswith(raw, F.lit("\r")), F.substring(raw, F.lit(1), F.length(raw) - 1)
    ).otherwise(raw)
    return F.transform(pieces, without_return)


def matched(column: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, or null where there is no match or it is empty."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def tail_after(column: Column, separator: str) -> Column:
    """The part after the last one-character separator; empty without a separator."""
    return F.when(
        F.contains(column, F.lit(separator)), F.substring_index(column, separator, -1)
    ).otherwise(F.lit(""))


def head_before(column: Column, separator: str) -> Column:
    """The part before the last one-character separator; the whole without a separator."""
    kept = F.length(column) - F.length(F.substring_index(column, separator, -1)) - 1
    return F.when(
        F.contains(column, F.lit(separator)), F.substring(column, F.lit(1), kept)
    ).otherwise(column)


def without_comments(column: Column) -> Column:
    """Text without // and /* */ comments; line breaks in comments stay, so lines keep their numbers."""
    tokens = F.regexp_extract_all(column, F.lit(COMMENT_TOKENS), F.lit(0))
    is_comment = lambda t: t.startswith("//") | t.startswith("/*")
    kept = F.transform(
        tokens,
        lambda t: F.when(is_comment(t), F.regexp_replace(t, r"[^\n]", "")).otherwise(t),
    )
    return F.array_join(kept, "")


def kind_of_restriction(restriction: Column) -> Column:
    """Suggestion kind for the restriction word a class is declared with."""
    return (
        F.when(restriction == "function", "Function")
        .when(restriction == "package", "Package")
        .when(restriction == "type", "Type")
        .when(restriction == "model", "Model")
        .otherwise("Class")
    )


def clean_comment(comment: Column) -> Column:
    """Comment without surrounding quotes; null where nothing is left."""
    return F.nullif(F.trim(comment, F.lit('"')), F.lit(""))
