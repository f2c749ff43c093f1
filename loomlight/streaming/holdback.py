"""Events held back until no earlier one can come.

A batch is written once, in time order. What lies before the watermark (the latest time seen
less a delay) is due; later rows stay in the folder of their batch, which is read again only
when the watermark reaches it. Rows that come behind the watermark are kept as late and counted,
as are rows without a time. Each batch writes what the next has to know: the watermark and the
folders that still hold rows. A batch that is run again sees the same and writes the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = "kind string, batch bigint, low bigint, high bigint"


def emptied(spark: SparkSession, folder: str, schema) -> None:
    """Rows of a folder that nobody reads any more go."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(folder)


@dataclass
class Marks:
    """What a batch leaves to the next: microseconds of the watermark, and (batch, low, high) of folders with rows."""

    watermark: int | None = None
    pieces: list[tuple[int, int, int]] = field(default_factory=list)
    done: list[int] = field(default_factory=list)

    def write(self, spark: SparkSession, folder: str) -> None:
        rows = [("piece", *p) for p in self.pieces] + [("done", b, None, None) for b in self.done]
        if self.watermark is not None:
            rows.append(("watermark", None, self.watermark, None))
        spark.createDataFrame(rows, MARKS).coalesce(1).write.mode("overwrite").parquet(folder)


def read_marks(spark: SparkSession, folder: str) -> Marks:
    rows = spark.read.schema(MARKS).parquet(folder).collect()  # a row for each batch that is within the delay
    out = Marks()
    for r in rows:
        if r.kind == "watermark":
            out.watermark = r.low
        elif r.kind == "piece":
            out.pieces.append((r.batch, r.low, r.high))
        else:
            out.done.append(r.batch)
    return out


def due_rows(
    batch: DataFrame, path: str, batch_id: int, delay: timedelta, time: str = "ts", last: bool = False
) -> tuple[DataFrame, int | None]:
    """(rows that are due, watermark): those of this batch and of earlier ones that no earlier row can precede.

    ``last`` ends the stream: all that is held back is due.
    """
    spark = batch.sparkSession
    own = f"{path}/arrived/batch={batch_id}"
    batch.sortWithinPartitions(time).write.mode("overwrite").parquet(own)
    arrived = spark.read.schema(batch.schema).parquet(own)
    before = read_marks(spark, f"{path}/marks/batch={batch_id - 1}") if batch_id > 0 else Marks()
    at = F.unix_micros(F.col(time).cast("timestamp"))
    begin = before.watermark
    is_late = at.isNull() if begin is None else (at.isNull() | (at < begin))
    seen = arrived.agg(F.min(F.when(~is_late, at)).alias("low"), F.max(at).alias("high"), F.count_if(is_late).alias("late")).first()
    if seen.late:
        arrived.filter(is_late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
    marks = [m for m in (begin, None if seen.high is None else seen.high - int(delay / timedelta(microseconds=1))) if m is not None]
    watermark = max(marks, default=None)
    held = [*before.pieces, *([(batch_id, seen.low, seen.high)] if seen.low is not None else [])]
    reached = [p for p in held if last or p[1] < watermark]
    folders = [f"{path}/arrived/batch={b}" for b, _, _ in reached]
    rows = spark.read.schema(batch.schema).parquet(*folders) if folders else arrived.limit(0)
    if begin is not None:
        rows = rows.filter(at >= begin)
    if not last:
        rows = rows.filter(at < watermark) if watermark is not None else rows.limit(0)
    rows = rows.filter(at.isNotNull())
    left = [] if last else [p for p in held if p[2] >= watermark]
    for b in before.done:  # read by the batch before at the latest, which is over
        emptied(spark, f"{path}/arrived/batch={b}", batch.schema)
    kept = {b for b, _, _ in left}
    done = [b for b in {batch_id, *(b for b, _, _ in before.pieces)} if b not in kept]
    Marks(watermark, left, done).write(spark, f"{path}/marks/batch={batch_id}")
    return rows, watermark


def late_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows that came behind the watermark or without a time, with the ``batch`` they came in."""
    try:
        return spark.read.option("basePath", f"{path}/late").parquet(f"{path}/late/batch=*")
    except Exception as error:  # no batch had any
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
