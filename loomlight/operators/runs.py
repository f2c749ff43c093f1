"""Run options, reports, results and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import text as T
from loomlight.operators.ordering import (
    KEY,
    RANGE,
    before,
    blocks_by_index,
    range_split,
    with_carry,
    within,
)

# Fields of a run report and the texts of a failed run.
RESULT_FILE = r"resultFile\s+=\s+\"([\w\\/.\-+\s]+)\""
MESSAGES = r"messages\s+=\s+\"\s+(.*)\","
FAILED_WITH = "simulating failed with: "
NO_RESULT_FILE = "the result string didn't contain a 'resultFile' property"
FORCED_FORMAT = 'outputFormat="csv"'


def run_outcome(reports: DataFrame, error: str = "error", result: str = "result") -> DataFrame:
    """Run reports to (status, result_file, failure, warning).

    Only an error field that starts with ``Error`` fails a run; one that starts with
    ``Warning`` is kept beside the result.
    """
    failed = F.startswith(error, F.lit("Error"))
    read = reports.withColumn("_file", T.matched(F.col(result), RESULT_FILE, 1))
    failed = F.coalesce(failed, F.lit(False))
    bad = failed | F.col("_file").isNull()
    reason = F.when(failed, F.concat(F.lit(FAILED_WITH), F.col(error))).otherwise(
        F.coalesce(T.matched(F.col(result), MESSAGES, 1), F.lit(NO_RESULT_FILE))
    )
    kept = [c for c in reports.columns if c not in {error, result}]
    return read.select(
        *kept,
        F.when(bad, "failed").otherwise("finished").alias("status"),
        F.when(~bad, F.col("_file")).alias("result_file"),
        F.when(bad, reason).alias("failure"),
        F.when(~bad & F.startswith(error, F.lit("Warning")), F.col(error)).alias("warning"),
    )


def run_results_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cell: (keys, variable, value). Values are strings or doubles in ``wide``."""
    measured = [c for c in wide.columns if c not in keys]
    texts = wide.select(*keys, *[F.col(c).cast("string").alias(c) for c in measured])
    return cell_values(texts.unpivot(list(keys), measured, "variable", "text"))


def cell_values(cells: DataFrame, text: str = "text") -> DataFrame:
    """Cells with their text as a number, ``value``; null where it is none."""
    kept = [c for c in cells.columns if c != text]
    return cells.select(*kept, F.col(text).try_cast("double").alias("value"))


def failed_runs(long: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs with a cell that is no number."""
    return long.filter("value is null").select(run).distinct()


def run_series(
    long: DataFrame, keys: Sequence[str], index: str = "row_idx", size: int = 1024
) -> DataFrame:
    """Series in row order, in blocks of at most ``size`` values: (keys, block, values).

    A series of any length stays whole as its blocks in order.
    """
    return blocks_by_index(long, keys, F.col(index), F.col("value"), "values", size)


def variables_map(series: DataFrame, run: str = "run_id") -> DataFrame:
    """Blocks of all variables of a run as one map variable -> values, per block.

    The number of variables is the width of the run's file.
    """
    entries = F.collect_list(F.struct("variable", "values"))
    return series.groupBy(run, "block").agg(F.map_from_entries(entries).alias("variables"))


def request_options(requests: DataFrame, options: str = "options") -> DataFrame:
    """JSON options to sorted ``key=value`` arguments.

    Numbers keep their value (1.50 is shown as 1.5) and strings are quoted; any other
    value, or text that is no object, rejects the request. The output format is always csv.
    """
    raw = F.from_json(F.col(options), "map<string,string>")
    typed = F.from_json(F.col(options), "map<string,variant>")
    parsed = requests.withColumn("_raw", raw).withColumn("_typed", typed)
    keys = F.filter(F.map_keys("_raw"), lambda k: k != "outputFormat")

    def kind(key: Column) -> Column:
        return F.schema_of_variant(F.try_element_at(F.col("_typed"), key))

    def is_number(key: Column) -> Column:
        return kind(key).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")

    def is_text(key: Column) -> Column:
        return kind(key) == "STRING"

    def argument(key: Column) -> Column:
        value = F.try_element_at(F.col("_raw"), key)
        shown = F.when(is_text(key), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
        return F.concat(key, F.lit("="), shown)

    readable = F.col("_raw").isNotNull() & F.forall(
        F.map_keys("_raw"), lambda k: F.coalesce(is_number(k) | is_text(k), F.lit(False))
    )
    arguments = F.array_sort(F.concat(F.transform(keys, argument), F.array(F.lit(FORCED_FORMAT))))
    return parsed.select(
        *requests.columns,
        readable.alias("accepted"),
        F.when(readable, arguments).alias("arguments"),
    )


def run_status_asof(
    events: DataFrame,
    run: str = "run_id",
    order: Sequence[str] = ("ts", "event_id"),
    initial: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Status of its run at each poll.

    ``op`` is submit, finish, fail or poll. A poll sees the last other event of its
    run before it; a run with none is unknown. ``initial`` (run, status) is what was
    known before these events.
    """
    return polls_with_status(status_scan(events, run, order, ranges), run, order, initial)


def status_scan(
    events: DataFrame, run: str, order: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Range split of the events with the status each one sets; other events than those of runs are left out."""
    events = events.filter(F.col("op").isin("submit", "finish", "fail", "poll"))
    status = (
        F.when(F.col("op") == "submit", "running")
        .when(F.col("op") == "finish", "finished")
        .when(F.col("op") == "fail", "failed")
    )
    return range_split(events.withColumn("_status", status), [run], order, ranges)


def last_status(scan: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest status set per key; combines on the map side."""
    last = F.max(F.when(F.col("_status").isNotNull(), F.struct(*order, "_status")))
    return scan.groupBy(*keys).agg(last.alias("_last")).select(
        *keys, F.col("_last._status").alias("_status")
    )


def polls_with_status(
    scan: DataFrame, run: str, order: Sequence[str], initial: DataFrame | None = None
) -> DataFrame:
    local = F.last("_status", ignorenulls=True).over(within(order))
    carried = last_status(scan, [KEY, RANGE], order).select(
        KEY, RANGE, F.last("_status", ignorenulls=True).over(before()).alias("_carried")
    )
    seen = with_carry(scan.withColumn("_local", local), carried).filter(F.col("op") == "poll")
    known = [F.col("_local"), F.col("_carried")]
    if initial is not None:
        seen = seen.join(initial.select(run, F.col("status").alias("_initial")), run, "left")
        known.append(F.col("_initial"))
    return seen.withColumn("status", F.coalesce(*known, F.lit("unknown"))).drop(
        KEY, RANGE, "_status", "_local", "_carried", "_initial"
    )
