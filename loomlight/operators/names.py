"""Names, name spaces and completion of unfinished words.

Requests are rows (req_id, word[, file, line]). A request only ever meets the
candidates of its own scope, by equi-join on the scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.functions import text as T
from loomlight.operators.corpus import display
from loomlight.operators.lookup import object_sources, position_filter
from loomlight.operators.ordering import lookup_join, ordered_blocks, split_join

SUGGESTION = ["kind", "name", "parameters", "comment", "type"]


def vocabulary_array() -> Column:
    """The fixed words as one literal array of (kind, name)."""
    words = [("Keyword", w) for w in T.KEYWORDS] + [("Type", w) for w in T.PRIMITIVE_TYPES]
    pairs = ", ".join(f"named_struct('kind', '{k}', 'name', '{w}')" for k, w in words)
    return F.expr(f"array({pairs})")


def vocabulary(spark: SparkSession) -> DataFrame:
    """The fixed words as a table (kind, name)."""
    return spark.range(1).select(F.inline(vocabulary_array()))


def namespace_table(names: DataFrame, name: str = "name") -> DataFrame:
    """Add the parent name space (null at the top) and the simple name."""
    col = F.col(name)
    dotted = F.contains(col, F.lit("."))
    return names.withColumn("parent", F.when(dotted, T.head_before(col, "."))).withColumn(
        "simple", F.substring_index(col, ".", -1)
    )


def namespace_children(requests: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the name space a request asks for.

    ``A.B.`` asks for the members of ``A.B``, ``A.B.x`` too; a word without a dot
    asks for the top level. ``classes`` needs ``name`` and may carry kind,
    parameters and comment; it may have a name space of any size.
    """
    scope = F.when(F.contains("word", F.lit(".")), T.head_before(F.col("word"), ".")).otherwise("")
    members = namespace_table(classes).withColumn("scope", F.coalesce("parent", F.lit("")))
    asked = requests.withColumn("scope", scope)
    found = split_join(asked, members, ["scope"], ["req_id"], ["name"])
    return found.select(*requests.columns, *classes.columns)


def is_prefix() -> Column:
    return F.startswith("name", F.col("word"))


def prefix_match(scoped: DataFrame) -> DataFrame:
    """Candidates that start with the request word; case counts."""
    return scoped.filter(is_prefix())


def prefix_nonmatch(scoped: DataFrame) -> DataFrame:
    """Candidates that do not start with the request word."""
    return scoped.filter(~is_prefix())


def prefix_lookup(words: DataFrame, names: DataFrame) -> DataFrame:
    """Names that start with a word, for a table of words and one unscoped list of names.

    A name is cut at the lengths that the words have, and only leads that are words are
    joined, so no name is compared with a word that it does not start with.
    """
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect() if r[0])
    every = F.lit(lengths) if lengths else F.array().cast("array<int>")
    cuts = F.filter(every, lambda n: n <= F.length("name"))
    leads = names.select(
        *names.columns, F.explode(F.transform(cuts, lambda n: F.left("name", n))).alias("_lead")
    )
    asked = words.withColumn("_lead", F.col("word"))
    known = leads.join(asked.select("_lead").distinct(), "_lead", "left_semi")
    return split_join(asked, known, ["_lead"]).select(*words.columns, *names.columns)


def edit_distance() -> Column:
    """Distance of the members behind the last dot, or of the objects if the word has no member."""
    word, name = F.col("word"), F.col("name")
    member = T.tail_after(word, ".")
    return (
        F.when(member != "", F.levenshtein(T.tail_after(name, "."), member))
        .otherwise(F.levenshtein(T.head_before(name, "."), T.head_before(word, ".")))
        .cast("int")
    )


def near_enough(candidates: DataFrame) -> DataFrame:
    """Add ``distance``, 0 for prefix hits; drop other names that are not nearer than they are long.

    The distance is a generator of no or one row, so that it is worked out once and
    not a second time in a pushed-down filter.
    """
    distance = F.when(is_prefix(), 0).otherwise(edit_distance())
    near = lambda d: is_prefix() | (d < F.length("name"))
    return candidates.select("*", F.explode(F.filter(F.array(distance), near)).alias("distance"))


def fuzzy_rank(scoped: DataFrame, best: int | None = None) -> DataFrame:
    """Candidates without the prefix, nearest first, if nearer than their own length.

    The order is distance, then name, then kind. ``best`` keeps that many per request.
    """
    ranked = near_enough(prefix_nonmatch(scoped))
    order = ["distance", "name", "kind"]
    if best is not None:
        ranked = best_per_request(ranked, order, best)
    return ranked.orderBy("req_id", *order)


def best_per_request(rows: DataFrame, order: list[str], best: int) -> DataFrame:
    """The first ``best`` rows of each request; Spark limits each task before the shuffle."""
    place = F.row_number().over(W.partitionBy("req_id").orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= best).drop("_place")


def vocabulary_candidates(requests: DataFrame) -> DataFrame:
    """Every request with the fixed words: a constant number of rows per request."""
    return requests.select("req_id", "word", F.inline(vocabulary_array()))


def completion_union(
    requests: DataFrame, classes: DataFrame, variables: DataFrame, sources: DataFrame
) -> DataFrame:
    """All suggestions for a table of requests (req_id, word, file, line).

    Candidates are the fixed words, the members of the word's name space, the
    variables of the file up to the cursor line, and the members of the object
    before the last dot. Prefix hits are tier 0, the others tier 1 by distance;
    :func:`in_order` sorts by these. ``variables`` is read more than once, so it should
    be a stored table.
    A word that ends in a dot lists the name space as it is; an empty word gives nothing.
    Duplicates between the sources stay.
    """
    asked = requests.filter("word <> ''")
    listing = asked.filter(F.endswith("word", F.lit(".")))
    typed = asked.filter(~F.endswith("word", F.lit(".")))

    listed = namespace_children(listing, classes).select(
        "req_id",
        "word",
        *SUGGESTION[:4],
        F.lit(None).cast("string").alias("type"),
        F.lit(0).alias("tier"),
        F.lit(0).alias("distance"),
    )
    # Both looks into files, the request's own and the object's, share one pass over the variables.
    own = typed.select("req_id", "word", "file", "line", F.lit(None).cast("string").alias("object"))
    others = object_sources(typed, variables, sources)
    views = own.unionByName(others.withColumn("line", F.lit(None).cast("int")))
    in_files = position_filter(views, variables).select(
        "req_id",
        "word",
        F.when(F.col("object").isNull(), "Variable").otherwise("Property").alias("kind"),
        F.concat_ws(".", "object", "name").alias("name"),
        "comment",
        "type",
    )
    candidates = (
        vocabulary_candidates(typed)
        .unionByName(
            namespace_children(typed, classes).select("req_id", "word", *SUGGESTION[:4]),
            allowMissingColumns=True,
        )
        .unionByName(in_files, allowMissingColumns=True)
    )
    tier = F.when(is_prefix(), 0).otherwise(1)
    judged = near_enough(candidates.withColumn("tier", tier))
    return judged.unionByName(listed).select("req_id", "word", "tier", "distance", *SUGGESTION)


def in_order(suggestions: DataFrame) -> DataFrame:
    """Suggestions as they are shown: by request, prefix hits first, then by distance and name."""
    return suggestions.orderBy("req_id", "tier", "distance", "name", "kind")


def completion_counts(suggestions: DataFrame) -> DataFrame:
    """Number of suggestions per request, in all and by tier."""
    return suggestions.groupBy("req_id").agg(
        F.count(F.lit(1)).alias("n_suggestions"),
        F.count_if(F.col("tier") == 0).alias("n_prefix"),
        F.count_if(F.col("tier") == 1).alias("n_fuzzy"),
    )


def completion_summary(suggestions: DataFrame, size: int = 512) -> DataFrame:
    """Counts per request with the sorted display strings, in blocks of at most ``size``."""
    shown = suggestions.select("req_id", "tier", display(F.col("kind"), F.col("name")).alias("shown"))
    blocks = ordered_blocks(shown, ["req_id"], ["shown", "tier"], F.col("shown"), "displays", size)
    return lookup_join(blocks, completion_counts(suggestions), ["req_id"], row_id=["req_id", "block"])
