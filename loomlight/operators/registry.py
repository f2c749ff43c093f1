"""Registrations, client counts and recency.

A connect adds one client to its key, a disconnect takes one away and does
nothing at zero. With S the plain running sum of these steps, the count is
``S - least(0, lowest S so far)``. Both parts combine over ranges, so a key with
very many calls is scanned range by range and never as one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import paths as P
from loomlight.operators.ordering import (
    KEY,
    RANGE,
    before,
    group_positions,
    lookup_join,
    range_split,
    with_carry,
    within,
)
from loomlight.session import cut

ORDER = ("ts", "event_id")


def step(op: Column) -> Column:
    return F.when(op == "connect", 1).when(op == "disconnect", -1).otherwise(0).cast("bigint")


def count_scan(
    calls: DataFrame,
    key: str = "key",
    order: Sequence[str] = ORDER,
    initial: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Calls with the client count of their key before and after: ``clients_before``, ``clients``.

    ``initial`` (key, clients) is what was counted before these calls. Events that neither
    connect nor disconnect are no calls.
    """
    calls = calls.filter(F.col("op").isin("connect", "disconnect"))
    split = range_split(calls.withColumn("_step", step(F.col("op"))), [key], order, ranges)
    local = split.withColumn("_sum", F.sum("_step").over(within(order)))
    # The lowest running sum so far, with and without the current call.
    local = local.withColumn("_low", F.min("_sum").over(within(order))).withColumn(
        "_low_before", F.min("_sum").over(within(order, -1))
    )
    ends = local.groupBy(KEY, RANGE).agg(
        F.sum("_step").alias("_total"), F.min("_sum").alias("_lowest")
    )
    start = F.lit(0).cast("bigint")
    if initial is not None:
        known = initial.select(F.struct(key).alias(KEY), F.col("clients").alias("_start"))
        ends = ends.join(known, KEY, "left")
        start = F.coalesce(F.col("_start"), start)
    based = ends.withColumn(
        "_base", start + F.coalesce(F.sum("_total").over(before()), F.lit(0))
    )
    carried = based.select(
        KEY,
        RANGE,
        "_base",
        F.least(F.lit(0), F.min(F.col("_base") + F.col("_lowest")).over(before())).alias("_floor"),
    )
    joined = with_carry(local, carried)

    def count(total: Column, low: Column) -> Column:
        return total - F.least(F.lit(0), F.col("_floor"), F.col("_base") + low)

    total = F.col("_base") + F.col("_sum")
    return joined.select(
        *calls.columns,
        count(total - F.col("_step"), F.col("_low_before")).alias("clients_before"),
        count(total, F.col("_low")).alias("clients"),
    )


def registry_refcount(
    calls: DataFrame,
    key: str = "key",
    order: Sequence[str] = ORDER,
    initial: DataFrame | None = None,
    clients_before: int = 0,
    ranges: int | None = None,
) -> DataFrame:
    """Clients of the key and of all keys after each call."""
    counted = cut(count_scan(calls, key, order, initial, ranges))
    return with_total(counted, order, clients_before, ranges)


def with_total(
    counted: DataFrame, order: Sequence[str], clients_before: int = 0, ranges: int | None = None
) -> DataFrame:
    """Add ``total_clients``, the running number of clients over all keys."""
    change = counted.withColumn("_change", F.col("clients") - F.col("clients_before"))
    split = range_split(change, [], order, ranges)
    local = split.withColumn("_sum", F.sum("_change").over(within(order)))
    ends = split.groupBy(KEY, RANGE).agg(F.sum("_change").alias("_total"))
    base = F.coalesce(F.sum("_total").over(before()), F.lit(0)).alias("_base")
    total = F.lit(clients_before) + F.col("_base") + F.col("_sum")
    return with_carry(local, ends.select(KEY, RANGE, base)).select(
        *counted.columns, total.alias("total_clients")
    )


def registry_ids(
    counted: DataFrame,
    key: str = "key",
    order: Sequence[str] = ORDER,
    first_id: int = 0,
    ranges: int | None = None,
) -> DataFrame:
    """One row per registration, a stretch of time with clients: (key, project_id, ...).

    Ids count up in the order registrations begin; a key that comes back gets a new one.
    """
    begins = counted.filter((F.col("clients_before") == 0) & (F.col("clients") == 1))
    placed = group_positions(begins, [], list(order), "_pos", ranges)
    return placed.select(
        key, (F.col("_pos") + first_id).alias("project_id"), *[F.col(c) for c in order]
    )


def final_counts(
    calls: DataFrame,
    key: str = "key",
    order: Sequence[str] = ORDER,
    ranges: int | None = None,
) -> DataFrame:
    """Clients per key after the last call."""
    split = range_split(calls.withColumn("_step", step(F.col("op"))), [key], order, ranges)
    local = split.withColumn("_sum", F.sum("_step").over(within(order)))
    ends = local.groupBy(KEY, RANGE).agg(
        F.sum("_step").alias("_total"), F.min("_sum").alias("_lowest")
    )
    based = ends.withColumn("_base", F.coalesce(F.sum("_total").over(before()), F.lit(0)))
    floor = F.least(F.lit(0), F.min(F.col("_base") + F.col("_lowest")))
    finals = based.groupBy(KEY).agg((F.sum("_total") - floor).alias("clients"))
    return finals.select(f"{KEY}.{key}", "clients")


def registry_counts(finals: DataFrame) -> DataFrame:
    """Number of keys with clients, and of all clients."""
    return finals.agg(
        F.count_if(F.col("clients") > 0).alias("projects"),
        F.coalesce(F.sum("clients"), F.lit(0)).alias("clients"),
    )


def hits(events: DataFrame, item: str) -> DataFrame:
    return events.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("hits"))


def recent_topk(counts: DataFrame, k: int) -> DataFrame:
    """The k items with most hits, ties by name; each task keeps k rows only."""
    return counts.orderBy(F.desc("hits"), F.asc("item")).limit(k)


def merge_hits(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.select("item", "hits").unionByName(new.select("item", "hits"))
    return both.groupBy("item").agg(F.sum("hits").alias("hits"))


def validate_projects(projects: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add ``errors``, the rules a project (path, output_dir, build_script) breaks.

    ``inventory`` is a node table (path, is_leaf). The script is looked up below the project.
    """
    node = P.plain(F.col("path"))
    known = inventory.filter(node != "").select(node.alias("_node"), F.col("is_leaf").alias("_is_file"))
    scripts = inventory.filter("is_leaf").select(node.alias("_script"), F.lit(True).alias("_has_script"))
    script = P.canonical(F.col("build_script"))
    wanted = projects.withColumn("_node", node).withColumn(
        "_script",
        F.when(script.rlike("^(/|[A-Za-z]:/)"), script).otherwise(F.concat(F.col("_node"), F.lit("/"), script)),
    )
    placed = lookup_join(wanted, known, ["_node"], "left")
    # the root of all is a directory, whether or not the inventory lists it
    placed = placed.withColumn("_is_file", F.when(F.col("_node") == "", F.lit(False)).otherwise(F.col("_is_file")))
    joined = placed.join(scripts, "_script", "left")
    # The texts of the rules.
    quoted = F.concat(F.lit("`"), "path", F.lit("`"))
    place = F.when(
        F.col("_is_file").isNull(), F.concat(quoted, F.lit(" doesn't exist"))
    ).when(F.col("_is_file"), F.concat(quoted, F.lit(" isn't a directory")))
    good_script = F.coalesce(F.col("_has_script"), F.lit(False)) & F.endswith(
        P.file_name(F.col("_script")), F.lit(".mos")
    )
    script = F.when(
        F.col("build_script").isNotNull() & ~good_script,
        F.concat(F.col("_script"), F.lit(" isn't a regular *.mos file!")),
    )
    return joined.select(*projects.columns, F.array_compact(F.array(place, script)).alias("errors"))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0)


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") > 0)
