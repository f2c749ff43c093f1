"""Types, sources and declarations for whole tables of requests (req_id, file, line, word)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.functions import text as T
from loomlight.operators.corpus import first_declaration
from loomlight.operators.ordering import asked_keys, lookup_join, split_join
from loomlight.session import stored

LIBRARY = "Modelica"  # fixed value: names that start so have no source in the corpus


def position_filter(requests: DataFrame, variables: DataFrame) -> DataFrame:
    """Variables a request can see: those of its file up to its line, all if it has no line."""
    seen = split_join(requests, variables, ["file"], ["req_id"], ["line_no", "name"])
    return seen.filter(F.col("line").isNull() | (F.col("line_no") <= F.col("line")))


def asked_declarations(keys: DataFrame, variables: DataFrame) -> DataFrame:
    """First declarations of the (file, name) pairs asked for.

    The pairs are made distinct and thin the variables out before these are grouped.
    """
    wanted = asked_keys(keys, ["file", "name"])
    return first_declaration(variables.join(wanted, ["file", "name"], "left_semi"))


def type_lookup(requests: DataFrame, variables: DataFrame) -> DataFrame:
    """Type and comment of the word's first identifier, declared at or above the line.

    The topmost declaration counts, not the nearest one. So it is enough to know
    one row per name and file: if that one is below the line, all others are. Variables
    that know the ``class_name`` of their type hand it on.
    """
    identifiers = F.regexp_extract_all("word", F.lit(T.IDENTIFIER), F.lit(1))
    named = requests.select("*", F.explode(F.slice(identifiers, 1, 1)).alias("name"))
    found = asked_declarations(named, variables)
    typed = lookup_join(named, found, ["file", "name"])
    more = [c for c in ("class_name",) if c in variables.columns]
    return typed.filter(F.col("line").isNull() | (F.col("line_no") <= F.col("line"))).select(
        *requests.columns, "name", "type", "comment", *more
    )


def source_table(classes: DataFrame) -> DataFrame:
    """Class name to the first file that declares it."""
    return classes.groupBy("class_name").agg(F.min("file").alias("source_file"))


def project_sources(sources: DataFrame) -> DataFrame:
    """Sources that may be asked for; library classes have none."""
    return sources.filter(~F.startswith("class_name", F.lit(LIBRARY)))


def class_source_lookup(
    requests: DataFrame, sources: DataFrame, class_name: str = "word"
) -> DataFrame:
    """Add the file that declares the class; null if there is none or it is a library class."""
    keyed = requests.withColumn("class_name", F.col(class_name))
    return lookup_join(keyed, project_sources(sources), ["class_name"], "left").select(
        *requests.columns, "source_file"
    )


def declared_classes(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """Full class name to the file and line that declare it.

    The line is the first one in the class's file that opens a class of that full name,
    or else of the last part of the name. A class whose file has no such line is left out.
    """
    simple = F.substring_index("class_name", ".", -1).alias("simple")
    place = F.min("line_no")
    openings = classes.groupBy(F.col("file").alias("source_file"), simple).agg(place.alias("_any"))
    exact = classes.groupBy(F.col("file").alias("source_file"), "class_name").agg(place.alias("_own"))
    named = project_sources(sources).select("*", simple)
    lines = named.join(openings, ["source_file", "simple"]).join(exact, ["source_file", "class_name"], "left")
    return lines.withColumn("class_line", F.coalesce("_own", "_any")).drop("simple", "_any", "_own")


def declaration_lookup(
    requests: DataFrame, classes: DataFrame, variables: DataFrame, sources: DataFrame
) -> DataFrame:
    """Where a word is declared: as a class, else as a variable of the request's own file.

    ``sources`` maps full class names to files. Variables are looked up first, as the
    requests are then still a plain table; the result is stored, as the next look-up counts it first.
    """
    named = requests.withColumn("name", F.col("word"))
    found = asked_declarations(named, variables).select("file", "name", "line_no")
    local = stored(lookup_join(named, found, ["file", "name"], "left"), "local")
    declared = declared_classes(classes, sources).withColumnRenamed("class_name", "name")
    both = lookup_join(local, declared, ["name"], "left", ["req_id"])
    as_class = F.col("class_line").isNotNull()
    return both.select(
        *requests.columns,
        F.when(as_class, F.col("source_file"))
        .when(F.col("line_no").isNotNull(), F.col("file"))
        .alias("declared_in"),
        F.coalesce("class_line", "line_no").alias("declared_at"),
    )


def object_sources(requests: DataFrame, variables: DataFrame, sources: DataFrame) -> DataFrame:
    """For words with a member: the object before the last dot and the file its type comes from.

    Nothing for a word without a member and for objects of a primitive type. The type is a
    full class name, unless the variables have the ``class_name`` found by their scope.
    """
    word = F.col("word")
    objects = requests.filter(T.tail_after(word, ".") != "").select(
        "req_id", F.col("word").alias("asked"), "file", "line", T.head_before(word, ".").alias("word")
    )
    typed = type_lookup(objects, variables).filter(~F.col("type").isin(T.PRIMITIVE_TYPES))
    full = "class_name" if "class_name" in variables.columns else "type"
    owners = typed.select("req_id", "asked", F.col("word").alias("object"), F.col(full).alias("class_name"))
    return owners.join(project_sources(sources), "class_name").select(
        "req_id", F.col("asked").alias("word"), "object", F.col("source_file").alias("file")
    )


def member_access(requests: DataFrame, variables: DataFrame, sources: DataFrame) -> DataFrame:
    """Variables of the type of the object before the last dot, as ``object.name``."""
    wanted = object_sources(requests, variables, sources)
    return split_join(wanted, variables, ["file"], ["req_id"], ["line_no", "name"]).select(
        "req_id", "word", F.concat_ws(".", "object", "name").alias("name"), "type", "comment"
    )
