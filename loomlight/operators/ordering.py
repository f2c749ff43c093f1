"""Order-dependent helpers that never hold one whole group in one task.

A window over a hot key is one task. Here the rows of a key are split in ranges of
``order`` instead, so a hot key spreads over many tasks; each range is scanned on
its own and what it must know of the ranges before it arrives as one small row per
(key, range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from loomlight.session import cut

RANGE = "_range"
KEY = "_key"


def range_split(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Number ranges of ``order`` for the rows of each key: ``_range``, and ``_key`` with the keys as one struct.

    Where the first order column is a number or a time, ranges lie between its quantiles over
    all rows, and the range is an expression of the row: nothing is written, and windows by
    key and range are the one shuffle of the rows. Otherwise the rows are range partitioned by
    keys and order and the result is cut, as such bounds are sampled and must not be drawn
    twice. ``order`` should end in a unique column so that ties cannot pile up in one range.
    ``_key`` is never null itself, so windows and joins on it see null keys as equal.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    value = _quantity(df, order[0])
    if value is not None:
        return df.withColumn(KEY, key).withColumn(RANGE, _between(value, _bounds(df, value, ranges)))
    split = df.repartitionByRange(ranges, *[F.col(c) for c in [*keys, *order]])
    return cut(split.withColumn(KEY, key).withColumn(RANGE, F.spark_partition_id()))


def _quantity(df: DataFrame, column: str) -> Column | None:
    """A number in the order of the column, if it is a number or a time."""
    kind = df.schema[column].dataType
    if isinstance(kind, NumericType):
        return F.col(column)
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return None


def _bounds(df: DataFrame, value: Column, ranges: int) -> list:
    """At most ``ranges - 1`` quantiles of the value, without repeats."""
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(value, shares, 50 * ranges)).first()[0]
    return sorted(set(found or []))


def _between(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are below the value, by bisection; 0 where it is null."""

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(bounds[middle]), half(low, middle)).otherwise(half(middle + 1, high))

    return F.when(value.isNull(), 0).otherwise(half(0, len(bounds)))


def within(order: Sequence[str], last: int = W.currentRow):
    """Window inside one range of one key, from its start to the current row."""
    return W.partitionBy(KEY, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, last)


def before():
    """Window over the ranges of a key before this one; at most one row per range."""
    return W.partitionBy(KEY).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)


def with_carry(split: DataFrame, carried: DataFrame) -> DataFrame:
    """Attach the one-row-per-(key, range) values to the rows of that range."""
    return split.join(carried, [KEY, RANGE], "left")


def group_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    ranges: int | None = None,
) -> DataFrame:
    """Number the rows of each group from 0 in ``order``; no keys means one global numbering."""
    split = range_split(df, keys, order, ranges)
    counts = split.groupBy(KEY, RANGE).agg(F.count(F.lit(1)).alias("_n"))
    base = F.coalesce(F.sum("_n").over(before()), F.lit(0)).alias("_base")
    local = F.row_number().over(W.partitionBy(KEY, RANGE).orderBy(*order))
    numbered = with_carry(split.withColumn("_local", local), counts.select(KEY, RANGE, base))
    return numbered.withColumn(name, F.col("_base") + F.col("_local") - 1).select(*df.columns, name)


def ordered_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    size: int,
    ranges: int | None = None,
) -> DataFrame:
    """Each group as consecutive array blocks of at most ``size`` values.

    The whole list is the blocks in ``block`` order, so a group of any length
    stays whole while no task ever holds more than ``size`` of its values.
    """
    placed = group_positions(df.withColumn("_value", value), keys, order, "_pos", ranges)
    return blocks_by_index(placed, keys, F.col("_pos"), F.col("_value"), name, size)


def blocks_by_index(
    df: DataFrame, keys: Sequence[str], index: Column, value: Column, name: str, size: int
) -> DataFrame:
    """As :func:`ordered_blocks`, for rows that already carry their index in the group."""
    entries = F.array_sort(F.collect_list(F.struct(index.alias("i"), value.alias("v"))))
    return (
        df.groupBy(*keys, F.floor(index / size).cast("bigint").alias("block"))
        .agg(entries.alias("_entries"))
        .select(*keys, "block", F.transform("_entries", lambda e: e["v"]).alias(name))
    )


def key_counts(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))


def asked_keys(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """The distinct keys of ``rows``.

    Written as the counts that :func:`lookup_join` takes of the same rows, so that
    Spark works both out in one shuffle.
    """
    return key_counts(rows, on).filter(F.col("_n") > 0).select(*on)


def row_hash(rows: DataFrame, row_id: Sequence[str] | None) -> Column:
    """A hash that tells rows apart: of ``row_id``, else of all columns that can be hashed."""
    names = row_id or [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*names)


def partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_parts(rows: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Keys with more rows than a shuffle partition has on average, and into how many such shares they go.

    There are fewer of them than shuffle partitions, whatever the number of rows is.
    """
    counts = key_counts(rows, on)
    total = counts.agg(F.sum("_n")).scalar()
    shares = counts.withColumn("_share", F.col("_n") * partitions(rows) / total)
    return shares.filter("_share > 1").select(*on, F.ceil("_share").alias(name))


def _parted(rows: DataFrame, on: Sequence[str], row_id: Sequence[str] | None, parts: Column) -> Column:
    """The part of each row. Rows with a null key meet nothing, so they may go anywhere."""
    missing = F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))
    return F.pmod(row_hash(rows, row_id), F.when(missing, F.lit(partitions(rows)).cast("bigint")).otherwise(parts))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``rows`` with a ``table`` that has at most one row per key.

    A key with more than a fair share of the rows is spread by a hash of ``row_id`` over
    as many parts as it has shares, and its one table row is repeated as often.
    """
    hot = F.broadcast(hot_parts(rows, on, "_parts"))
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    spread = rows.join(hot, [*on], "left").withColumn("_salt", _parted(rows, on, row_id, parts)).drop("_parts")
    repeated = (
        table.join(hot, [*on], "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        .drop("_parts")
    )
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")


def split_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    row_id: Sequence[str] | None = None,
    table_id: Sequence[str] | None = None,
) -> DataFrame:
    """Join two tables that may both have very many rows of one key.

    Both sides are counted. A key that is hot on one side goes into parts there, by a hash
    of the row's id, and its rows on the other side are repeated as often as there are
    parts. Other keys are neither split nor copied. A part depends on the row alone, so a
    task that is run again sends each row to the same place.
    """
    one = F.lit(1).cast("bigint")
    both = hot_parts(rows, on, "_a").join(hot_parts(table, on, "_b"), [*on], "full")
    hot = F.broadcast(both.select(*on, F.coalesce("_a", one).alias("_na"), F.coalesce("_b", one).alias("_nb")))

    def placed(side: DataFrame, ids: Sequence[str] | None, own: str, other: str) -> DataFrame:
        parts = [F.coalesce(f"_n{x}", one) for x in (own, other)]
        return (
            side.join(hot, [*on], "left")
            .withColumn(f"_{own}", _parted(side, on, ids, parts[0]))
            .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), parts[1] - 1)))
            .drop("_na", "_nb")
        )

    met = placed(rows, row_id, "a", "b").join(placed(table, table_id, "b", "a"), [*on, "_a", "_b"])
    return met.drop("_a", "_b")
