"""From file texts to lines, declarations, classes, parameters and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import text as T
from loomlight.operators import structure
from loomlight.operators.scans import SIZE


def corpus_lines(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, text) to (file, line_no from 1, line).

    A final line break opens no extra line, and a carriage return before a break is dropped.
    Lines may have any length.
    """
    pieces = F.split(F.col(text), "\n")
    pieces = F.when(
        F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    ).otherwise(pieces)
    exploded = files.select(F.col(file).alias("file"), F.posexplode(pieces).alias("pos", "raw"))
    return exploded.select(
        "file",
        (F.col("pos") + 1).alias("line_no"),
        F.when(F.endswith("raw", F.lit("\r")), F.expr("substring(raw, 1, length(raw) - 1)"))
        .otherwise(F.col("raw"))
        .alias("line"),
    )


def strip_comments(files: DataFrame, text: str = "text") -> DataFrame:
    """Blank out // and /* */ comments; run it before :func:`corpus_lines`."""
    return files.withColumn(text, T.without_comments(F.col(text)))


def _type_and_name(declared: Column) -> Column:
    """The two words of a declaration; cut by plain blanks, as a pattern is compiled per row."""
    words = F.translate(declared, "\t\n\x0b\f\r", "     ")
    return F.struct(
        F.substring_index(words, " ", 1).alias("type"),
        F.substring_index(words, " ", -1).alias("name"),
    )


def extract_variables(lines: DataFrame, strict: bool = False, *more: str) -> DataFrame:
    """Lines to declared variables: (file, line_no, type, name, comment) and the columns ``more``.

    Only the shape of a line counts, so ``end X`` is read as a declaration too;
    ``strict`` leaves out rows whose type or name is a keyword. The match is a
    generator, not a filter, so that later null checks do not run it again.
    """
    declared = F.transform(
        F.regexp_extract_all("line", F.lit(T.DECLARATION), F.lit(1)), _type_and_name
    )
    variables = lines.select("file", "line_no", "line", *more, F.inline(declared)).select(
        "file",
        "line_no",
        "type",
        "name",
        T.matched(F.col("line"), T.DECLARATION_COMMENT, 1).alias("comment"),
        *more,
    )
    if strict:
        is_word = F.col("type").isin(T.KEYWORDS) | F.col("name").isin(T.KEYWORDS)
        variables = variables.filter(~is_word)
    return variables


def extract_classes(lines: DataFrame) -> DataFrame:
    """Lines that open a class: (file, line_no, restriction, class_name)."""
    opened = F.transform(
        F.regexp_extract_all("line", F.lit(T.CLASS_OPENING), F.lit(0)),
        lambda o: F.struct(
            F.regexp_extract(o, T.CLASS_OPENING, 1).alias("restriction"),
            F.regexp_extract(o, T.CLASS_OPENING, 2).alias("class_name"),
        ),
    )
    return lines.select("file", "line_no", F.inline(opened))


def class_catalogue(lines: DataFrame, size: int = SIZE) -> DataFrame:
    """Classes by their full name: (class_name, parent, restriction, file, line_no).

    The full name is the ``within`` clause of the file, the names of the classes that are
    open, and the own name. A short definition (``type X = ...``) opens nothing; strings and
    comments, also over many lines, hold no class; a line may open and end several.
    """
    return structure.classes(structure.nested(lines, size))


def scoped_variables(nested: DataFrame, strict: bool = False) -> DataFrame:
    """As :func:`extract_variables`, with the ``scope`` around each; lines that begin in a string or comment are none."""
    code = nested.filter(F.startswith("state", F.lit("C")))
    return extract_variables(code, strict, "scope")


def first_declaration(variables: DataFrame) -> DataFrame:
    """The topmost declaration of each name in each file, with the ``class_name`` of its type where that is known.

    ``min`` combines on the map side, so a name declared very often moves one row per task.
    """
    kept = [c for c in ("line_no", "type", "comment", "class_name") if c in variables.columns]
    first = variables.groupBy("file", "name").agg(F.min(F.struct(*kept)).alias("first"))
    return first.select("file", "name", *[f"first.{c}" for c in kept])


def extract_parameters(
    classes: DataFrame, kind: str = "kind", source: str = "source", names: str = "parameter_names"
) -> DataFrame:
    """Add ``parameters``: inputs as ``type name`` for functions, plain names for models
    and classes, null for everything else and where there are none."""
    inputs = F.regexp_extract_all(F.col(source), F.lit(T.FUNCTION_INPUT), F.lit(0))
    typed = F.transform(
        inputs,
        lambda i: F.concat_ws(
            " ",
            F.regexp_extract(i, T.FUNCTION_INPUT, 1),
            F.regexp_extract(i, T.FUNCTION_INPUT, 2),
        ),
    )
    plain = F.transform(F.col(names), lambda n: F.trim(n, F.lit('"')))
    listed = F.when(F.col(kind) == "Function", typed).when(
        F.col(kind).isin("Model", "Class"), plain
    )
    return classes.withColumn("parameters", F.when(F.size(listed) > 0, listed))


def class_kind(classes: DataFrame, restriction: str = "restriction") -> DataFrame:
    """Add ``kind`` by the word a class is declared with."""
    return classes.withColumn("kind", T.kind_of_restriction(F.col(restriction)))


def class_comments(classes: DataFrame, comment: str = "comment") -> DataFrame:
    """Class comments without their quotes; empty ones become null."""
    return classes.withColumn(comment, T.clean_comment(F.col(comment)))


def distinct_classes(classes: DataFrame) -> DataFrame:
    """Each (class, kind) once."""
    return classes.select("name", "kind").distinct()


def display(kind: Column, name: Column) -> Column:
    """How one suggestion is shown in a log."""
    return F.concat(kind, F.lit(" - "), name)
