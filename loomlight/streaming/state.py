"""State by key for streams, so that a batch costs what its own keys cost.

A batch writes the new values of its keys as one run, cut in hash buckets, and reads only
the buckets in which it has keys. When a level has FANOUT runs they become one run of the
next level, with the newest value of each key. So a value is written once for each level,
and there are few runs to look into, however long the stream runs. A key that is gone leaves
a mark until the oldest run is merged; a value with a time to expire goes with the first
merge behind that time, and is not seen from that time on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.streaming.holdback import emptied

BUCKETS = 16
FANOUT = 4
RUNS = "run string, level int, live boolean"


@dataclass
class KeyedState:
    """Values by ``key`` below ``path``; ``values`` are the columns' names and types."""

    spark: SparkSession
    path: str
    key: str
    values: str
    buckets: int = BUCKETS
    fanout: int = FANOUT

    @property
    def schema(self) -> str:
        return f"{self.key} string, {self.values}, expires bigint, gone boolean, seq bigint"

    def runs(self, batch_id: int) -> list[tuple[str, int, bool]]:
        """(run, level, live) after a batch, the oldest run first; there are few for each level."""
        if batch_id < 0:
            return []
        found = self.spark.read.schema(RUNS).parquet(f"{self.path}/runs/batch={batch_id}").collect()
        order = lambda r: (-r.level, int(r.run.split("-")[0]))
        return [tuple(r) for r in sorted(found, key=order)]

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, names: list[str]) -> DataFrame:
        root = f"{self.path}/data"
        rows = self.spark.read.schema(f"{self.schema}, run string, bucket int").option("basePath", root)
        return rows.parquet(*[f"{root}/run={n}" for n in names]).drop("run")

    def newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, "bucket")]
        last = F.max_by(F.struct(*rest), "seq").alias("_last")
        return rows.groupBy(self.key).agg(last).select(self.key, "_last.*")

    def live(self, rows: DataFrame, now: int | None) -> DataFrame:
        kept = ~F.col("gone")
        if now is not None:
            kept &= F.col("expires").isNull() | (F.col("expires") > now)
        return rows.filter(kept)

    def look_up(self, batch_id: int, keys: DataFrame, now: int | None = None) -> DataFrame:
        """The values before batch ``batch_id`` of the keys that have one."""
        names = [run for run, _, live in self.runs(batch_id - 1) if live]
        empty = self.spark.createDataFrame([], self.schema)
        if not names:
            return empty
        asked = keys.select(self.key).distinct()
        touched = [r[0] for r in asked.select(self.bucket()).distinct().collect()]  # at most ``buckets``
        rows = self.read(names).filter(F.col("bucket").isin(touched)).join(asked, self.key, "left_semi")
        return self.live(self.newest(rows), now)

    def all(self, batch_id: int, now: int | None = None) -> DataFrame:
        """All values after a batch."""
        names = [run for run, _, live in self.runs(batch_id) if live]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.live(self.newest(self.read(names)), now)

    def write(self, rows: DataFrame, run: str) -> None:
        parted = rows.withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket")
        parted.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/run={run}")

    def update(self, batch_id: int, changed: DataFrame, now: int | None = None) -> None:
        """The values that a batch sets, one row for each key: key, values, expires, gone."""
        before = self.runs(batch_id - 1)
        for run, _, live in before:
            if not live:  # merged by the batch before, which is over
                emptied(self.spark, f"{self.path}/data/run={run}", self.schema)
        names = [x.split()[0] for x in self.schema.split(", ")]
        own = f"{batch_id}-0"
        self.write(changed.withColumn("seq", F.lit(batch_id).cast("bigint")).select(*names), own)
        runs, merged = [(run, level) for run, level, live in before if live] + [(own, 0)], []
        level = 0
        while len(full := [run for run, at in runs if at == level]) >= self.fanout:
            rows = self.newest(self.read(full))
            if full[0] == runs[0][0]:  # nothing older that a mark would have to hide
                rows = self.live(rows, now)
            run = f"{batch_id}-{level + 1}"
            self.write(rows, run)
            merged += full
            above = [r for r in runs if r[1] > level]
            runs = [*above, (run, level + 1)]
            level += 1
        listed = [(run, at, True) for run, at in runs] + [(run, 0, False) for run in merged]
        self.spark.createDataFrame(listed, RUNS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/runs/batch={batch_id}")
