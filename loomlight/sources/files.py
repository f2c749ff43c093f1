"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.functions import paths as P
from loomlight.operators.ordering import group_positions, lookup_join


def file_path(uri: Column) -> Column:
    """The plain path of a file URI: decoded, a plus sign kept, and without the scheme ``file:``."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^file:/+", "/")


def inventory(paths: DataFrame, extension: str = ".mo", path: str = "path") -> DataFrame:
    """Source files of a path table: right ending, not hidden, sorted, with their file name."""
    name = P.file_name(F.col(path))
    kept = paths.filter(F.endswith(path, F.lit(extension)) & ~P.is_hidden(name))
    return kept.withColumn("file_name", name).orderBy(path)


def corpus_inventory(spark: SparkSession, root: str, extension: str = ".mo") -> DataFrame:
    """All source files below a root. File contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{extension}")
        .option("recursiveFileLookup", True)
        .load(root)
    )
    plain = found.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length")
    return inventory(plain, extension)


def read_corpus(spark: SparkSession, root: str, extension: str = ".mo") -> DataFrame:
    """Source files below a root as (file, text)."""
    texts = (
        spark.read.option("pathGlobFilter", f"*{extension}")
        .option("recursiveFileLookup", True)
        .text(root, wholetext=True)
    )
    return texts.select(
        file_path(F.col("_metadata.file_path")).alias("file"),
        F.col("value").alias("text"),
    )


def read_words(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A word list file as (kind, name); empty lines are dropped."""
    words = spark.read.text(path).filter("value <> ''")
    return words.select(F.lit(kind).alias("kind"), F.col("value").alias("name"))


def write_words(words: DataFrame, path: str) -> None:
    """Save the names of a word table as a word list, one to a line."""
    words.select(F.col("name").alias("value")).write.mode("errorifexists").text(path)


def csv_cells(line: Column) -> Column:
    """The cells of one CSV line; a quoted cell may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(line, F.lit(r'(?<=^|,)("(?:[^"]|"")*+"|[^,]*)'), F.lit(1))
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when(F.startswith(c, F.lit('"')), inner(c)).otherwise(c))


def read_run_results(spark: SparkSession, path: str, run: str = "run_id") -> DataFrame:
    """Result files as cells (run, row_idx, variable, text); each file has a header of its own.

    Runs are sub-folders ``run_id=...`` and may have different variables. Spark keeps no
    order over a shuffle, so each line gets its place (file, block in the file, line in
    the block) before any.
    """
    lines = spark.read.text(path).select(
        run,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("_line"),
    )
    place = ["_file", "_block", "_row"]
    top = F.min(F.struct("_block", "_row", "_line")).alias("_top")
    heads = lines.groupBy("_file").agg(top).select(
        "_file", F.col("_top._row").alias("_head"), csv_cells(F.col("_top._line")).alias("_names")
    )
    placed = lookup_join(lines, heads, ["_file"], row_id=place).filter("_row <> _head")
    numbered = group_positions(placed, [run], place, "row_idx")
    cells = numbered.withColumn("_cells", csv_cells(F.col("_line")))
    return cells.select(
        run, "row_idx", F.posexplode("_names").alias("_pos", "variable"), "_cells"
    ).select(run, "row_idx", "variable", F.get("_cells", F.col("_pos")).alias("text"))


def write_run_results(wide: DataFrame, path: str, order: str, run: str = "run_id") -> None:
    """Add wide results as CSV, one folder per run, rows in ``order``."""
    (
        wide.repartitionByRange(run, order)
        .sortWithinPartitions(run, order)
        .drop(order)
        .write.mode("append")
        .partitionBy(run)
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )


def read_snapshot(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A saved JSON table; empty if there is none yet."""
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Save as JSON into a new folder; an existing one is never written over."""
    df.write.mode("errorifexists").json(path)
