"""Compiler logs to rows (log_id, seq, type, file, start, end, message), and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import paths as P
from loomlight.functions import text as T
from loomlight.operators.ordering import lookup_join

# The log syntax of the first dialect. A word is a run of these
# characters; repeats are possessive, so a long log is scanned without backtracking.
WORD = r"[\p{L}\w.+\-*,;:=<>?!(){}/\\\"']"
MESSAGE = rf"((?:(?!Error){WORD}++\s*+)++)"
POSITIONED = (
    r"\[([^\[\]:]+(?::[\\/][^\[\]:]*)?):(\d+):(\d+)-(\d+):(\d+):\w+\]\s*(\w+)\s*:\s*" + MESSAGE
)
PROCESSING = (
    r"\A\s*Error\s+processing\s+file:\s*((?:[A-Za-z]:)?[\w\-.+<>?=/\\ ]+)\s"
    rf"(?:(?!Error){WORD}++\s*+)*+Error\s*:\s*" + MESSAGE
)
BARE = r"(?<!\S)\"?Error\s*:\s*" + MESSAGE
UNREADABLE = "Couldn't understand compiler:\n"

# The log syntax of the second dialect.
B_ERROR = r"Error: in file '([^']+)':\n\w+ error at line (\d+), column (\d+):\n\s*(.*)"
B_WARNING = r"Warning: in file '([^']+)':\n\w+ line (\d+), column (\d+):\n\s*(.*)"

# Check reports.
CHECK_COUNTS = r"Class (\S+) has (\d+) equation\(s\) and (\d+) variable\(s\)"
CHECK_TRIVIAL = r"(\d+) of these are trivial equation"

GROUP_BREAK = "\x01"
POSITIONED_FORM, PROCESSING_FORM, BARE_FORM, UNREADABLE_FORM = 1, 2, 3, 4


def position(line: Column, column: Column) -> Column:
    return F.struct(
        F.coalesce(line.try_cast("int"), F.lit(0)).alias("line"),
        F.coalesce(column.try_cast("int"), F.lit(0)).alias("column"),
    )


def folded(message: Column) -> Column:
    """Words joined by one blank; a lone hyphen starts a new line."""
    return F.regexp_replace(F.trim(F.regexp_replace(message, r"\s+", " ")), r" -(?= |\z)", "\n-")


def without_dangling(message: Column) -> Column:
    return F.regexp_replace(message, r"(?:\\\"|[\"\s])+\z", "")


def diagnostics_a(logs: DataFrame, text: str = "text") -> DataFrame:
    """First dialect. One form is chosen per log: positioned findings, else the finding of
    a processed file, else bare errors, else one row that holds the log."""
    log = F.col(text)
    kept = [c for c in logs.columns if c != text]
    bracketed = F.contains(log, F.lit("["))
    positioned = F.when(bracketed, F.regexp_extract_all(log, F.lit(POSITIONED), F.lit(0)))
    forms = logs.filter(F.contains(log, F.lit("Error"))).select(
        *kept,
        log.alias("_log"),
        F.coalesce(positioned, F.array().cast("array<string>")).alias("_positioned"),
    )
    none_positioned = F.size("_positioned") == 0
    forms = forms.withColumn(
        "_processing", F.when(none_positioned, T.matched(F.col("_log"), PROCESSING))
    ).withColumn(
        "_bare",
        F.when(
            none_positioned & F.col("_processing").isNull(),
            F.regexp_extract_all("_log", F.lit(BARE), F.lit(0)),
        ),
    )
    form = (
        F.when(~none_positioned, POSITIONED_FORM)
        .when(F.col("_processing").isNotNull(), PROCESSING_FORM)
        .when(F.size("_bare") > 0, BARE_FORM)
        .otherwise(UNREADABLE_FORM)
    )
    pieces = (
        F.when(form == POSITIONED_FORM, F.col("_positioned"))
        .when(form == PROCESSING_FORM, F.array("_processing"))
        .when(form == BARE_FORM, F.col("_bare"))
        .otherwise(F.array("_log"))
    )
    found = forms.select(*kept, form.alias("_form"), F.posexplode(pieces).alias("seq", "_piece"))
    # All groups of a finding in one pass, set apart by a character no log holds.
    groups = F.regexp_replace(
        "_piece", rf"\A{POSITIONED}\z", GROUP_BREAK.join(f"${n}" for n in range(1, 8))
    )
    fields = F.when(F.col("_form") == POSITIONED_FORM, F.split(groups, GROUP_BREAK))
    found = found.withColumn("_fields", fields)

    def part(group: int) -> Column:
        return F.get("_fields", group - 1)

    def of_form(n: int) -> Column:
        return F.col("_form") == n

    no_place = position(F.lit("0"), F.lit("0"))
    message = (
        F.when(of_form(POSITIONED_FORM), folded(without_dangling(part(7))))
        .when(of_form(PROCESSING_FORM), folded(F.regexp_extract("_piece", PROCESSING, 2)))
        .when(of_form(BARE_FORM), folded(without_dangling(F.regexp_extract("_piece", BARE, 1))))
        .otherwise(F.concat(F.lit(UNREADABLE), "_piece"))
    )
    file = (
        F.when(of_form(POSITIONED_FORM), P.canonical(part(1)))
        .when(of_form(PROCESSING_FORM), P.canonical(F.trim(F.regexp_extract("_piece", PROCESSING, 1))))
        .otherwise("")
    )
    return found.select(
        *kept,
        "seq",
        F.when(of_form(POSITIONED_FORM), part(6)).otherwise("Error").alias("type"),
        file.alias("file"),
        F.when(of_form(POSITIONED_FORM), position(part(2), part(3))).otherwise(no_place).alias("start"),
        F.when(of_form(POSITIONED_FORM), position(part(4), part(5))).otherwise(no_place).alias("end"),
        message.alias("message"),
    )


def _second_dialect(logs: DataFrame, text: str, kind: str, pattern: str) -> DataFrame:
    kept = [c for c in logs.columns if c != text]
    found = logs.select(
        *kept,
        F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("seq", "_piece"),
    )
    place = position(
        F.regexp_extract("_piece", pattern, 2), F.regexp_extract("_piece", pattern, 3)
    )
    return found.select(
        *kept,
        "seq",
        F.lit(kind).alias("type"),
        F.regexp_extract("_piece", pattern, 1).alias("file"),
        place.alias("start"),
        place.alias("end"),
        F.regexp_extract("_piece", pattern, 4).alias("message"),
    )


def diagnostics_b(logs: DataFrame, text: str = "text") -> DataFrame:
    """Second dialect: all errors of a log, then all its warnings; the end is the start."""
    return diagnostics_union(
        _second_dialect(logs, text, "Error", B_ERROR),
        _second_dialect(logs, text, "Warning", B_WARNING),
    )


def diagnostics_union(*groups: DataFrame) -> DataFrame:
    """Findings of several groups in one table; ``part`` and ``seq`` give their order."""
    numbered = [g.withColumn("part", F.lit(n)) for n, g in enumerate(groups)]
    result = numbered[0]
    for more in numbered[1:]:
        result = result.unionByName(more)
    return result


def library_warnings(failures: DataFrame, text: str = "text") -> DataFrame:
    """Libraries that could not be loaded, as warnings without a place."""
    kept = [c for c in failures.columns if c != text]
    no_place = position(F.lit("0"), F.lit("0"))
    return failures.select(
        *kept,
        F.lit(0).alias("seq"),
        F.lit("Warning").alias("type"),
        F.lit("").alias("file"),
        no_place.alias("start"),
        no_place.alias("end"),
        F.col(text).alias("message"),
    )


def project_scope_filter(diagnostics: DataFrame, root: str = "root") -> DataFrame:
    """Findings without a file, in the project, or in a script.

    The test is a generator of one or no row, in which both paths are made plain once: as a
    filter it would be pushed down, and the file parsed again for each part of it.
    """

    def in_scope(x):
        below = (x["_file"] == x["_top"]) | F.startswith(x["_file"], F.concat(x["_top"], F.lit("/")))
        return (x["file"] == "") | below | F.endswith(x["file"], F.lit(".mos"))

    row = F.struct(*diagnostics.columns, P.plain(F.col("file")).alias("_file"), P.plain(F.col(root)).alias("_top"))
    return diagnostics.select(F.inline(F.filter(F.array(row), in_scope))).drop("_file", "_top")


def gated_diagnostics(
    first: DataFrame, second: DataFrame, not_instantiable: DataFrame, key: str
) -> DataFrame:
    """Findings of the first stage; those of the second only for inputs that had none
    and that can be instantiated."""
    blocked = first.select(key).union(not_instantiable.select(key)).distinct()
    passed = lookup_join(second, blocked, [key], "left_anti")
    return first.withColumn("stage", F.lit(1)).unionByName(
        passed.select(*second.columns).withColumn("stage", F.lit(2))
    )


def model_size(reports: DataFrame, text: str = "text") -> DataFrame:
    """Check reports to class name and its equation and variable counts."""
    report = F.col(text)
    kept = [c for c in reports.columns if c != text]
    parsed = reports.select(
        *kept,
        T.matched(report, CHECK_COUNTS, 1).alias("class_name"),
        T.matched(report, CHECK_COUNTS, 2).try_cast("bigint").alias("equations"),
        T.matched(report, CHECK_COUNTS, 3).try_cast("bigint").alias("variables"),
        F.coalesce(T.matched(report, CHECK_TRIVIAL, 1).try_cast("bigint"), F.lit(0)).alias("trivial"),
    )
    return parsed.dropna(subset=["class_name"])


def model_size_totals(sizes: DataFrame, *keys: str) -> DataFrame:
    return sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("equations").alias("equations"),
        F.sum("variables").alias("variables"),
        F.sum("trivial").alias("trivial"),
    )
