"""Types by the scope they are written in, for whole tables of declarations.

A type name is looked up from the class around outwards: in each class first what is
declared there, then its imports by name, then all that it imports from. The first part of
a dotted name is found this way and the rest lies in it. Each (scope, first part) asks once,
as one row for each class around, and all look-ups are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.functions import text as T
from loomlight.operators.ordering import lookup_join, split_join
from loomlight.session import stored

ASKED = ["scope", "head"]
#: What is found in one class comes in this order: declared, imported by name, imported with all.
DECLARED, NAMED, ALL = range(3)


def first_parts(asked: DataFrame, catalogue: DataFrame, imports: DataFrame) -> DataFrame:
    """(scope, head, found): the nearest class or import that ``head`` names in ``scope`` (array of names).

    ``catalogue`` has each full ``class_name``, ``imports`` are (scope, alias, target). Several
    imports of one rank give the first target by name. What stands nowhere has no row.
    What is asked is stored with a number, so that a row for a class around is a short one.
    """
    numbered = stored(asked.select(*ASKED).withColumn("ask", F.monotonically_increasing_id()), "asked")
    known = catalogue.select("class_name").distinct()
    level = F.explode(F.sequence(F.lit(0), F.size("scope"))).alias("level")
    around = F.array_join(F.slice("scope", F.lit(1), F.size("scope") - F.col("level")), ".")
    looked = numbered.select("*", level).withColumn("around", around)
    row_id = ["ask", "level"]
    inside = lambda name: F.concat_ws(".", F.nullif("around", F.lit("")), name).alias("inside")
    place = lambda rank: F.struct((F.col("level") * 3 + rank).alias("rank"), "found").alias("near")
    # Declared classes and imports by name are both found under the name they have in the class around.
    own = catalogue.select(F.col("class_name").alias("inside"), F.lit(DECLARED).alias("rank"), F.col("class_name").alias("found"))
    by_name = imports.filter("alias IS NOT NULL").withColumn("around", F.col("scope"))
    by_name = by_name.select(inside("alias"), F.lit(NAMED).alias("rank"), F.col("target").alias("found"))
    first = own.unionByName(by_name).groupBy("inside").agg(F.min(F.struct("rank", "found")).alias("first"))
    named = lookup_join(looked.select(*row_id, inside("head")), first, ["inside"], row_id=row_id)
    named = named.select("*", "first.*").select("ask", place(F.col("rank")))
    packages = imports.filter("alias IS NULL").select(F.col("scope").alias("around"), "target").distinct()
    opened = split_join(looked.select(*row_id, "around", "head"), packages, ["around"], row_id, ["target"])
    opened = opened.withColumn("class_name", F.concat_ws(".", "target", "head"))
    opened = lookup_join(opened, known, ["class_name"], row_id=[*row_id, "target"])
    opened = opened.withColumn("found", F.col("class_name")).select("ask", place(F.lit(ALL)))
    near = named.unionByName(opened).groupBy("ask").agg(F.min("near")["found"].alias("found"))
    return numbered.join(near, "ask").select(*ASKED, "found")


def scoped_types(variables: DataFrame, catalogue: DataFrame, imports: DataFrame) -> DataFrame:
    """``variables`` (with ``type`` and ``scope``) with the full ``class_name`` of the type.

    It is null for primitive types and where the first part of the type stands nowhere. The
    rest of a dotted type is not looked for, as it may be inherited or lie outside of the corpus.
    ``variables`` and ``imports`` are stored, as each of them is read by several steps.
    """
    head = F.substring_index("type", ".", 1)
    is_class = ~F.col("type").isin(T.PRIMITIVE_TYPES)
    rows = stored(variables.withColumn("head", F.when(is_class, head)), "declared")
    asked = rows.filter(is_class).select(*ASKED).distinct()
    found = first_parts(asked, catalogue, stored(imports, "imports"))
    rest = F.substring(F.col("type"), F.length("head") + 1, F.length("type"))
    return lookup_join(rows, found, ASKED, "left", ["file", "line_no", "name"]).select(
        *variables.columns, F.concat("found", rest).alias("class_name")
    )
