"""Operators on endless event streams; each one equals its batch twin on the same events.

Inside a batch, events are put in order by (ts, event_id). From batch to batch they may come
out of order by as much as a stream's ``delay``.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlight.operators import registry, runs
from loomlight.session import cut
from loomlight.streaming.holdback import due_rows, late_rows
from loomlight.streaming.state import KeyedState


def file_index_stream(changes: DataFrame) -> DataFrame:
    """Latest create or delete per path; modifications are ignored. Live files have op create."""
    lasting = changes.filter(F.col("op").isin("create", "delete"))
    last = F.max(F.struct("ts", "event_id", "op")).alias("_last")
    return lasting.groupBy("path").agg(last).select("path", "_last.op", "_last.ts")


def recent_stream(events: DataFrame, item: str) -> DataFrame:
    """Number of hits per item so far."""
    return registry.hits(events, item)


def _start(stream: DataFrame, apply, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(apply).start()


class Live:
    """A stream whose batches are worked on one after the other, each in event-time order.

    With a ``delay``, events may come that much later than later ones: they are held back
    until the watermark has passed them, so the answers are those of the batch operator
    whatever the order of arrival. What comes later still is kept in ``late_events``.
    Without a delay, each batch must begin where the last one ended.
    """

    def __init__(self, table: str, delay: timedelta | None = None):
        self.table, self.delay, self.schema, self.batch = table, delay, None, -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.schema, self.batch = batch.schema, batch_id
        self.work(batch, batch_id, False)

    def work(self, batch: DataFrame, batch_id: int, last: bool) -> None:
        if self.delay is None:
            self.apply(batch, batch_id, None)
        else:
            rows, watermark = due_rows(batch, f"{self.table}/held", batch_id, self.delay, last=last)
            self.apply(rows, batch_id, watermark)

    def apply(self, rows: DataFrame, batch_id: int, watermark: int | None) -> None:
        raise NotImplementedError

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        return _start(stream, self, checkpoint, available_now)

    def finish(self, spark: SparkSession) -> None:
        """The stream has ended: what is held back is worked on, as one batch more. It cannot go on afterwards."""
        if self.delay is not None and self.batch >= 0:
            self.batch += 1
            self.work(spark.createDataFrame([], self.schema), self.batch, True)

    def late_events(self, spark: SparkSession) -> DataFrame:
        """Events that came too late or without a time, with the batch they came in; none of them was worked on."""
        return late_rows(spark, f"{self.table}/held", self.schema)


class Registry(Live):
    """Client counts and project ids, live.

    Writes ``table/calls`` (each call with the clients left of its key and of all)
    and ``table/projects`` (registrations with their ids). Clients per key are state by
    key; two totals are one row for each batch. A batch is scanned by ranges like the
    batch operator, so a hot key is no single task.
    """

    def apply(self, rows: DataFrame, batch_id: int, watermark: int | None) -> None:
        spark, table = rows.sparkSession, self.table
        state = KeyedState(spark, f"{table}/state", "key", "clients bigint")
        rows = cut(rows)
        known = state.look_up(batch_id, rows).select("key", "clients")
        total, next_id = 0, 0
        if batch_id > 0:
            totals = spark.read.parquet(f"{table}/totals/batch={batch_id - 1}").first()
            total, next_id = totals["clients"], totals["next_id"]
        counted = cut(registry.count_scan(rows, initial=known))
        answered = registry.with_total(counted, registry.ORDER, total)
        answered.write.mode("overwrite").parquet(f"{table}/calls/batch={batch_id}")
        ids = registry.registry_ids(counted, first_id=next_id)
        ids.write.mode("overwrite").parquet(f"{table}/projects/batch={batch_id}")

        last = F.max(F.struct(*registry.ORDER, "clients")).alias("_last")
        after = counted.groupBy("key").agg(last).select("key", "_last.clients")
        never = F.lit(None).cast("bigint").alias("expires")
        state.update(batch_id, after.select("key", "clients", never, (F.col("clients") == 0).alias("gone")))
        change = counted.agg(
            F.coalesce(F.sum(F.col("clients") - F.col("clients_before")), F.lit(0)).alias("clients"),
            F.count_if((F.col("clients_before") == 0) & (F.col("clients") == 1)).alias("next_id"),
        )
        change.select(
            (F.col("clients") + total).alias("clients"), (F.col("next_id") + next_id).alias("next_id")
        ).write.mode("overwrite").parquet(f"{table}/totals/batch={batch_id}")


class RunStatus(Live):
    """Polls answered from the state of their run.

    Writes ``table/polls``, each poll with the status of its run. With ``keep``, a run that
    has finished or failed is unknown from that long after its end, in event time, and its
    state goes once the watermark is there.
    """

    ORDER = ("ts", "event_id")

    def __init__(self, table: str, delay: timedelta | None = None, keep: timedelta | None = None):
        super().__init__(table, delay)
        self.keep = keep

    def apply(self, rows: DataFrame, batch_id: int, watermark: int | None) -> None:
        state = KeyedState(rows.sparkSession, f"{self.table}/state", "run_id", "status string")
        # a status goes with the time it was set at
        scan = runs.status_scan(rows, "run_id", self.ORDER)
        scan = scan.withColumn("_status", F.concat("_status", F.lit("@"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string")))
        known = cut(state.look_up(batch_id, scan).select("run_id", "status"))
        polls = runs.polls_with_status(scan, "run_id", self.ORDER, known)
        status = F.substring_index("status", "@", 1)
        set_at = F.substring_index("status", "@", -1).try_cast("bigint")
        expires = F.lit(None).cast("bigint")
        if self.keep is not None:
            expires = F.when(status != "running", set_at + int(self.keep / timedelta(microseconds=1)))
        over = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) >= expires, F.lit(False))
        answers = polls.withColumn("status", F.when(over, "unknown").otherwise(status))
        answers.write.mode("overwrite").parquet(f"{self.table}/polls/batch={batch_id}")
        after = runs.last_status(scan, ["run_id"], self.ORDER).dropna().withColumnRenamed("_status", "status")
        state.update(batch_id, after.select("run_id", "status", expires.alias("expires"), F.lit(False).alias("gone")), watermark)


class FileIndex(Live):
    """The live files: the last create or delete of each path by event time; modifications are ignored.

    Without a ``delay``, events may come in any order, and a deleted path keeps its time for
    ever. With one, no earlier event can follow, so a deleted path leaves nothing.
    """

    VALUES = "op string, ts timestamp, event_id bigint"

    def apply(self, rows: DataFrame, batch_id: int, watermark: int | None) -> None:
        state = KeyedState(rows.sparkSession, f"{self.table}/state", "path", self.VALUES)
        own = F.struct("ts", "event_id", "op")
        lasting = rows.filter(F.col("op").isin("create", "delete"))
        changed = cut(lasting.groupBy("path").agg(F.max(own).alias("_last")).select("path", "_last.*"))
        known = state.look_up(batch_id, changed).select("path", own.alias("_known"))
        after = changed.join(known, "path", "left").filter(F.col("_known").isNull() | (own > F.col("_known")))
        never = F.lit(None).cast("bigint").alias("expires")
        gone = (F.col("op") == "delete") & F.lit(self.delay is not None)
        state.update(batch_id, after.select("path", "op", "ts", "event_id", never, gone.alias("gone")), watermark)

    def files(self, spark: SparkSession) -> DataFrame:
        """(path, ts) of the files that are there after the last batch."""
        found = KeyedState(spark, f"{self.table}/state", "path", self.VALUES).all(self.batch)
        return found.filter("op = 'create'").select("path", "ts")


def registry_stream(
    calls: DataFrame, table: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """:class:`Registry` for calls that come in time order."""
    return Registry(table).start(calls, checkpoint, available_now)


def run_status_stream(
    events: DataFrame, table: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """:class:`RunStatus` for events that come in time order."""
    return RunStatus(table).start(events, checkpoint, available_now)
