"""Column handling, Arrow mapping and small relational helpers that the operators share.

Inputs may have extra columns, also ones whose names clash with results or differ
from a needed name in case only. :func:`pick` therefore takes columns by exact name
and position, and :func:`packed` keeps a whole input row in one struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlight.session import stored

#: The struct column that holds a whole input row.
ROW = "_row"

#: Bytes of text that a task works on at once; one longer text is taken alone.
PIECE = 2 << 20


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns ``new=type`` of ``df`` by exact name; one that is missing is null."""
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    out = []
    for name, kind in wanted.items():
        value = F.col(f"_c{df.columns.index(name)}") if name in df.columns else F.lit(None)
        out.append(value.cast(kind).alias(name))
    return plain.select(*out)


def packed(df: DataFrame, **wanted: str) -> DataFrame:
    """As :func:`pick`, with the whole input row in the struct ``_row``."""
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    row = F.struct(*[F.col(f"_c{i}") for i in range(len(df.columns))]).alias(ROW)
    out = [row]
    for name, kind in wanted.items():
        value = F.col(f"_c{df.columns.index(name)}") if name in df.columns else F.lit(None)
        out.append(value.cast(kind).alias(name))
    return plain.select(*out)


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows that :func:`packed` kept, under ``columns``, with some values replaced."""
    out = [
        changed[name].alias(f"_c{i}") if name in changed else F.col(ROW)[f"_c{i}"].alias(f"_c{i}")
        for i, name in enumerate(columns)
    ]
    return df.select(*out).toDF(*columns)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of texts and where each begins; null has no bytes."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        width = np.int64
    else:
        width = np.int32
    n = len(texts)
    _, where, data = texts.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(where, width, n + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE):
    """Slices of ``batch`` with at most ``limit`` bytes of text, or one longer text."""
    texts = batch.column(batch.schema.get_field_index(column))
    _, bounds = text_buffer(texts)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, column: str, carry: list[str], fields: list[T.StructField], make) -> DataFrame:
    """Add columns that depend on the text alone, in one pass over Arrow batches.

    ``make()`` gives, once for each task, a function from an array of texts to the
    list of new arrays. The columns ``carry`` stay; rows are neither lost nor added.
    """
    schema = T.StructType([*[df.schema[c] for c in carry], *fields])

    def run(batches):
        work = make()
        for batch in batches:
            for piece in pieces(batch, column):
                kept = [piece.column(piece.schema.get_field_index(c)) for c in carry]
                new = work(piece.column(piece.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def text_rows(df: DataFrame, column: str, fields: list[T.StructField], make) -> DataFrame:
    """Rows made from the texts of each task: ``make()`` gives an object with two methods.

    ``take(batch)`` yields rows for a batch, ``rest()`` those at the end of the task;
    rows are lists of arrays in the order of ``fields``.
    """
    schema = T.StructType(fields)
    names = [f.name for f in fields]

    def run(batches):
        work = make()
        for batch in batches:
            for piece in pieces(batch, column):
                for arrays in work.take(piece):
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
        for arrays in work.rest():
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


#: Bits of the filter that :func:`maybe_in` broadcasts: 8,388,608, so 1 MB whatever the keys are.
FILTER_BITS = 1 << 23


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose long ``key`` may be among those of ``keys``: none of these is lost.

    Rows that pass by chance must be dropped by the join that follows.
    """
    return may_be_in(df, key, keys).filter("may_be").drop("may_be")


def may_be_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``may_be``: false only where the long ``key`` is not among those of ``keys``.

    The keys set bits of one bitmap of fixed size, 256 rows of 4 kB, which is all that
    is broadcast. A null key may be none of them.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bits = keys.select(place.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket"))
    bitmap = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    marked = df.withColumn("_at", place).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    is_set = F.expr("getbit(cast(_byte AS bigint), cast(_bit % 8 AS int))") == 1
    joined = marked.join(F.broadcast(bitmap), "_bucket", "left").withColumns({"_byte": byte, "_bit": bit})
    return joined.select(*df.columns, F.coalesce(is_set, F.lit(False)).alias("may_be"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) is connected with.

    Least labels spread over the links, and each label is then replaced by the label of
    the node it names, so that long chains need few rounds. A node with very many links
    is summed up before the shuffle, and its join is one that Spark can split.
    """
    both = stored(
        links.select(F.col("a"), F.col("b")).union(links.select(F.col("b"), F.col("a"))).distinct(), "links"
    )
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")),
        "labels",
    )
    while True:
        at_b = labels.select(F.col("node").alias("b"), F.col("root").alias("other"))
        near = both.join(at_b, "b").groupBy("a").agg(F.min("other").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", "root", F.least("root", "near").alias("next")
        )
        spread = stored(spread, "labels")
        named = spread.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jumped = spread.join(named, "next", "left").select(
            "node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")
        )
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return labels
