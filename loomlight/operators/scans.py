"""States that run from row to row, without a task for each whole file.

What a row does to the state is a function, and functions compose. Rows are folded in
blocks of bounded size, the blocks in blocks of blocks, until one block holds a whole file;
on the way back each block hands its rows the state they begin in. So a file of n rows
takes log n rounds, each of them spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.session import stored

#: Rows, or blocks, that one block holds.
SIZE = 256


def block_scan(
    rows: DataFrame,
    key: str,
    at: str,
    prepare: Callable[[DataFrame], DataFrame],
    identity: Column,
    compose: Callable[[Column, Column], Column],
    start: Column,
    apply: Callable[[Column, Column], Column],
    name: str = "state",
    size: int = SIZE,
) -> DataFrame:
    """``rows`` with the state ``name`` in which each begins, in the order of ``at`` for each ``key``.

    ``prepare`` adds ``_step``, what a row does, and maybe other columns; it runs on rows that
    are spread by key and block already. ``compose(f, g)`` is f and then g, ``apply(state, f)``
    the state after f. ``at`` is a whole number from 0 that should not leave large gaps; rows
    of one ``at`` stand in the order of their other columns. Null keys are one key.
    """
    size = max(2, size)

    def in_blocks(below: DataFrame) -> DataFrame:
        return below.withColumn("_block", F.floor(F.col("_at") / size).cast("bigint"))

    def grouped(below: DataFrame) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("_at", "_row", "_step")))
        return below.groupBy("_key", "_block").agg(items.alias("_items"))

    def begun(blocks: DataFrame) -> DataFrame:
        """Each item of each block with its state; ``_state`` is the block's own."""
        none = F.array_compact(F.array(F.when(F.lit(False), start)))
        states = F.aggregate(
            "_items",
            F.struct(F.col("_state").alias("now"), none.alias("out")),
            lambda acc, x: F.struct(
                apply(acc["now"], x["_step"]).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")
            ),
            lambda acc: acc["out"],
        )
        placed = F.arrays_zip("_items", states.alias("_begin"))
        return blocks.select("_key", F.inline(placed)).select("_key", "_items.*", F.col("_begin").alias("_state"))

    spread = in_blocks(rows.select("*", F.struct(key).alias("_key"), F.col(at).cast("bigint").alias("_at")))
    first = prepare(spread.repartition("_key", "_block"))
    kept = [c for c in first.columns if c not in ("_key", "_at", "_block", "_step")]
    first = first.select("_key", "_block", "_at", F.struct(*kept).alias("_row"), "_step")
    levels = [stored(grouped(first), "scan")]
    while not levels[-1].filter("_block > 0").isEmpty():
        folded = F.aggregate("_items", identity, lambda acc, x: compose(acc, x["_step"]))
        above = levels[-1].select(
            "_key", F.col("_block").alias("_at"), F.lit(None).cast("int").alias("_row"), folded.alias("_step")
        )
        levels.append(stored(grouped(in_blocks(above)), "scan"))
    top = levels[-1].withColumn("_state", start)
    for level in reversed(levels[:-1]):
        states = begun(top).select("_key", F.col("_at").alias("_block"), "_state")
        top = level.join(states, ["_key", "_block"])
    return begun(top).select("_row.*", F.col("_state").alias(name))
