"""Tables kept by a stream: one folder per micro-batch, the newest row per key counts.

A batch that is run again after a failure overwrites its own folder, so every
change is applied once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep_changes(
    changes: DataFrame, table: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write the changed rows of a streaming aggregation below ``table/batch=n``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(save).start()


def compact(spark: SparkSession, table: str, keys: Sequence[str], target: str) -> None:
    """Write the newest rows into a new table, as its first batch."""
    newest(spark, table, keys).write.mode("errorifexists").parquet(f"{target}/batch=-1")


def newest(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """The last written row of each key."""
    changes = spark.read.parquet(table)
    rest = [c for c in changes.columns if c not in {*keys, "batch"}]
    last = F.max_by(F.struct(*rest), F.col("batch")).alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[f"_last.{c}" for c in rest])
