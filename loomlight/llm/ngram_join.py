"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

Shingles are ordered by how frequent their bucket of a count sketch is in the corpus,
rare ones first, then by hash. Two sets that reach the similarity share a shingle among
the first ``n - ceil(t n) + 1`` of each, whatever the order is; the sketch only makes
shared candidates rare. Equal sets are one node. Nodes with the same prefix and size
are one group, and only groups meet in the join on prefix shingles.

Pairs come in two rounds, so that a large class of near copies does not give all its
pairs. First each shingle has a lead: the group with it whose prefix is shared most, which
for a family of copies is the text they were made from. Each group is compared with the
nearest lead of its shingles. Links found make classes. Then all pairs of groups that share a prefix shingle, pass the
length and positional bounds and are not of one class yet are compared. A bitmap of each
set, whose bits say whether the number of shingles with that hash is odd, bounds how many
shingles two sets differ in and stops most pairs before they are made. Each pair that is
left is verified on the full sets, made again from the texts.

A shingle is told apart by 64 bits of hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlight.llm.frames import (
    PIECE, components, field, map_texts, maybe_in, packed, pick, pieces, text_buffer, text_rows, unpacked,
)
from loomlight.llm.wordhash import SPACED, Words, mix, runs, signed
from loomlight.session import stored

#: log2 of the counters of the sketch; its counts, one byte each, are what is broadcast: 4 MB.
SKETCH_BITS = 22
#: Counters that travel in one row.
SLICE = 1 << 14


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a shorter text is one shingle."""
    data, bounds = text_buffer(texts)
    words = Words(data, bounds, SPACED)
    h = words.hashes()
    full = runs(h, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        else:
            out.append(runs(h[a:b], b - a)[:1] if b > a else full[:0])
    return out


#: Longs of the bitmap of a set.
PARITY = 8


def parities(own: np.ndarray) -> np.ndarray:
    """A bitmap of the set: each bit says whether an odd number of its hashes fall there."""
    bits = np.bincount((own & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


class _Sketch:
    """Counters of a task, sent in slices at its end."""

    def __init__(self, size: int):
        self.size = size
        self.n = np.zeros(1 << SKETCH_BITS, np.int64)

    def take(self, batch):
        sets = shingle_sets(batch.column(0), self.size)
        if sets:
            at, n = np.unique(bucket(np.concatenate(sets)), return_counts=True)
            self.n[at] += n
        return []

    def rest(self):
        if self.n.any():
            # planes of bytes, of which the high ones are mostly 0
            cut = self.n.view(np.uint8).reshape(-1, SLICE, 8).transpose(0, 2, 1)
            for i in range(0, len(cut), 32):
                part = cut[i : i + 32]
                yield [
                    pa.array(np.arange(i, i + len(part), dtype=np.int32)),
                    pa.array([zlib.compress(row.tobytes(), 1) for row in part], pa.binary()),
                ]


def _added(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of one slice summed over all tasks, batch by batch."""
    total = np.zeros(SLICE, np.int64)
    for batch in rows:
        for value in batch.column(1):
            planes = np.frombuffer(zlib.decompress(value.as_py()), np.uint8).reshape(8, SLICE)
            total += np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)
    level = np.ceil(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "n"]
    )


def commonness(texts: DataFrame, size: int) -> np.ndarray:
    """One byte for each counter: twice the binary logarithm of its count over all texts."""
    parts = text_rows(texts, "text", [field("slice", "int"), field("n", "binary")], lambda: _Sketch(size))
    summed = parts.groupBy("slice").applyInArrow(_added, "slice int, n binary").collect()
    out = np.zeros((1 << SKETCH_BITS) // SLICE * SLICE, np.uint8).reshape(-1, SLICE)
    for row in summed:
        out[row["slice"]] = np.frombuffer(row["n"], np.uint8)
    return out.reshape(-1)


def required(n: np.ndarray | Column, t: int):
    """Least size of a partner, and so of the shared part, for a set of n: ceil(t n / 100)."""
    if isinstance(n, Column):
        return F.ceil(n * t / 100).cast("int")
    return (t * n + 99) // 100


def signatures(docs: DataFrame, carry: list[str], size: int, t: int) -> DataFrame:
    """For each row: n, key of the set (null if empty), key of the prefix, and the prefix shingles.

    A prefix shingle is a long whose order is the order of the join.
    """
    levels = docs.sparkSession.sparkContext.broadcast(commonness(docs.select("text"), size))
    fields = [
        field("n", "int"), field("set_key", "binary"), field("prefix_key", "binary"), field("prefix", "array<bigint>"),
        field("bits", "array<bigint>"),
    ]

    def make():
        level = levels.value

        def work(texts):
            n, keys, heads, prefixes, bits = [], [], [], [], []
            for own in shingle_sets(texts, size):
                k = len(own)
                n.append(k)
                if not k:
                    keys.append(None), heads.append(None), prefixes.append(None), bits.append(None)
                    continue
                order = (level[bucket(own)].astype(np.uint64) << np.uint64(55)) | (mix(own) >> np.uint64(9))
                length = k - required(k, t) + 1
                if length < k:
                    order = np.partition(order, length - 1)[:length]
                prefix = np.sort(order)
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                heads.append(hashlib.blake2b(prefix.tobytes(), digest_size=16).digest())
                prefixes.append(signed(prefix))
                bits.append(parities(own))
            return [
                pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(heads, pa.binary()),
                pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
            ]

        return work

    return map_texts(docs, "text", carry, fields, make)


def _shared(batches):
    """Rows, sorted by shingle, whose shingle is in several groups, with how many the batch has of them.

    Rows at the ends of a batch stay too, as others with their shingle may be in the next one.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(at, len(token)))
        several = size > 1
        several[[0, -1]] = True
        keep = pa.array(np.repeat(several, size))
        here = pa.array(np.repeat(size, size))
        columns = [c.filter(keep) for c in (*batch.columns, here)]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "n", "pos", "grp", "here"])


def reachable(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, shared: Column, t: int) -> Column:
    """Whether sets that share ``shared`` prefix shingles, the last at these positions, can be similar."""
    most = shared + F.least(n_a - pos_a, n_b - pos_b) - 1
    return most * (100 + t) >= (n_a + n_b) * t


def leading(n: Column, t: int) -> Column:
    """Prefix shingles of the smaller set of a pair that suffice: n - ceil(2 t n / (100 + t)) + 1."""
    return n - F.ceil(n * (2 * t) / (100 + t)) + 1


def differing(a: str, b: str) -> Column:
    """At least so many shingles are in one of the sets with these bitmaps only."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, PARITY)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def close(a: str, b: str, n_a: Column, n_b: Column, t: int) -> Column:
    """False if the bitmaps show that the sets cannot be similar; true where a bitmap is missing."""
    return F.coalesce(differing(a, b) * (100 + t) <= (n_a + n_b) * (100 - t), F.lit(True))


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, text) of the documents among ``rows``, and of few others, each row once."""
    return maybe_in(docs, "row", rows).dropDuplicates(["row"])


def _links(pairs: DataFrame, docs: DataFrame, size: int, t: int) -> DataFrame:
    """The pairs (a, b) of nodes, with the rows of a text of each, whose sets reach the similarity.

    Many pairs share their ``a``, as members of a family meet its lead, so the texts of that
    side are few; they are stored, and Spark can split the join on a lead with very many pairs.
    The text of a ``b`` moves to its pairs, and with them to the ``a``.
    """
    right = _texts(docs, pairs.select(F.col("row_b").alias("row")))
    left = stored(_texts(docs, pairs.select(F.col("row_a").alias("row"))), "texts")
    right = right.select(F.col("row").alias("row_b"), F.col("text").alias("text_b"))
    left = left.select(F.col("row").alias("row_a"), F.col("text").alias("text_a"))
    both = pairs.join(right, "row_b").join(left, "row_a").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for first in pieces(batch, "text_a"):
                for piece in pieces(first, "text_b"):
                    a = shingle_sets(piece.column(2), size)
                    b = shingle_sets(piece.column(3), size)
                    shared = np.array(
                        [len(x) + len(y) - len(np.unique(np.concatenate([x, y]))) for x, y in zip(a, b)], np.int64
                    )
                    total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64) - shared
                    ok = pa.array((100 * shared >= t * total) & (total > 0))
                    yield piece.select(["a", "b"]).filter(ok)

    return both.mapInArrow(run, "a bigint, b bigint")


def jaccard_classes(docs: DataFrame, carry: list[str], size: int = 4, percent: int = 85) -> DataFrame:
    """For each row of ``docs`` (doc_id, text and ``carry``): n_shingles, component_id.

    Two rows are linked if 100 * |shared shingles| >= percent * |all shingles|;
    ``component_id`` is the smallest doc_id that links lead to, the own included. Null
    and empty texts have no shingles and no links. A null doc_id counts for no minimum;
    repeated rows, and rows with one doc_id and several texts, each follow their own text.
    """
    keyed = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    base = list(dict.fromkeys(["doc_id", *carry]))
    sigs = stored(signatures(keyed, [*base, "row"], size, percent), "signatures")
    # groups keep the prefix, nodes only which group they are in
    groups = stored(
        sigs.filter("n > 0")
        .groupBy("prefix_key", "n")
        .agg(F.first("prefix").alias("prefix"))
        .withColumn("grp", F.monotonically_increasing_id()),
        "groups",
    )
    nodes = stored(
        sigs.filter("n > 0")
        .groupBy("set_key", "prefix_key", "n")
        .agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("bits").alias("bits"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    member = stored(
        nodes.join(groups.drop("prefix"), ["prefix_key", "n"]).select("grp", "node", "row", "n", "bits"), "members"
    )
    # first round: groups against a neighbour, members against the first of their group
    keyed_bits = F.min(F.struct("node", "row", "bits")).alias("head")
    tokens = groups.select(F.posexplode("prefix").alias("pos", "token"), "n", "grp")
    tokens = tokens.select("token", "n", "pos", "grp")
    heads = stored(member.groupBy("grp", "n").agg(keyed_bits), "heads")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, "token", "grp").sortWithinPartitions("token", "grp")
    schema = "token bigint, n int, pos int, grp bigint, here bigint"
    shared = stored(ordered.mapInArrow(_shared, schema), "shared")
    # the middle of a family shares most: what its members changed stands in them alone
    ranked = shared.groupBy("grp").agg(F.sum("here").alias("score"))
    best = F.max(F.struct("score", "grp", "n", "pos"))
    leads = shared.join(ranked, "grp").groupBy("token").agg(best.alias("lead"))
    leads = leads.select("token", F.col("lead.grp").alias("grp0"), F.col("lead.n").alias("n0"), F.col("lead.pos").alias("pos0"))
    near = (
        shared.join(leads, "token")
        .filter("grp <> grp0")
        .filter(required(F.greatest("n", "n0"), percent) <= F.least("n", "n0"))
        .filter(reachable(F.col("n"), F.col("pos"), F.col("n0"), F.col("pos0"), F.least("pos", "pos0") + 1, percent))
        .select(F.col("grp0").alias("grp_a"), F.col("grp").alias("grp_b"))
        .distinct()
    )
    sides = [
        heads.select(
            F.col("grp").alias(f"grp_{c}"), F.col("n").alias(f"n_{c}"), F.col("head.node").alias(c),
            F.col("head.row").alias(f"row_{c}"), F.col("head.bits").alias(f"bits_{c}"),
        )
        for c in "ab"
    ]
    may = close("bits_a", "bits_b", F.col("n_a"), F.col("n_b"), percent)
    outer = near.join(sides[0], "grp_a").join(sides[1], "grp_b").filter(may)
    nearest = F.min(F.struct(differing("bits_a", "bits_b").alias("d"), "a", "b", "row_a", "row_b")).alias("p")
    outer = outer.groupBy("grp_b").agg(nearest).select("p.a", "p.b", "p.row_a", "p.row_b")  # a is the lead's
    inner = (
        member.select("grp", F.col("node").alias("b"), F.col("row").alias("row_b"), F.col("bits").alias("bits_b"), F.col("n").alias("n_b"))
        .join(sides[0].withColumnRenamed("grp_a", "grp"), "grp")
        .filter((F.col("a") != F.col("b")) & may)
        .select("a", "b", "row_a", "row_b")
    )
    pairs = stored(outer.union(inner), "pairs")
    texts = keyed.select("row", "text")
    links = stored(_links(pairs, texts, size, percent), "links")
    roots = components(links)
    # second round: groups that share a shingle and are not of one class yet
    classed = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classed = stored(classed, "classed")
    single = F.when(F.count(F.lit(1)) == 1, F.first("bits"))
    spans = classed.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), single.alias("bits"))
    spans = stored(spans, "spans")
    known = shared.select("token", "n", "pos", "grp").join(spans.drop("bits"), "grp")
    mixed = known.groupBy("token").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).filter("x < y")
    open_rows = known.join(mixed.select("token"), "token").join(spans.select("grp", "bits"), "grp")
    open_rows = stored(open_rows, "open")
    names = ("n", "pos", "grp", "lo", "hi", "bits")
    one, two = (open_rows.select("token", *[F.col(x).alias(f"{x}_{c}") for x in names]) for c in "ab")
    n_a, n_b, pos_a, pos_b = (F.col(c) for c in ("n_a", "n_b", "pos_a", "pos_b"))
    met = (
        one.join(two, "token")
        .filter("(n_a < n_b OR (n_a = n_b AND grp_a < grp_b)) AND NOT (lo_a = hi_a AND lo_b = hi_b AND lo_a = lo_b)")
        .filter(
            (required(n_b, percent) <= n_a) & (pos_a < leading(n_a, percent))
            & reachable(n_a, pos_a, n_b, pos_b, F.least("pos_a", "pos_b") + 1, percent)
            & close("bits_a", "bits_b", n_a, n_b, percent)
        )
        .select("grp_a", "grp_b")
        .distinct()
    )
    split = spans.filter("lo < hi").select(F.col("grp").alias("grp_a"), F.col("grp").alias("grp_b"))
    names = ("grp", "node", "row", "root", "n", "bits")
    sides = [classed.select(*[F.col(x).alias(f"{x}_{c}") for x in names]) for c in "ab"]
    rest = (
        met.union(split)
        .join(sides[0], "grp_a")
        .join(sides[1], "grp_b")
        .filter("root_a <> root_b AND (grp_a <> grp_b OR node_a < node_b)")
        .filter(close("bits_a", "bits_b", n_a, n_b, percent))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "row_a", "row_b")
    )
    rest = stored(rest, "pairs")
    if not rest.isEmpty():
        more = _links(rest, texts, size, percent)
        roots = components(stored(links.union(more), "links"))
    # each class with its smallest doc_id, back to the rows
    placed = nodes.select("set_key", "node", "least").join(roots, "node", "left")
    placed = placed.select("set_key", "least", F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(ids, "root").select("set_key", "component_id", "root")
    return (
        sigs.join(classes, "set_key", "left")
        .withColumn("component_id", F.least("doc_id", "component_id"))
        .select(*base, F.col("n").cast("bigint").alias("n_shingles"), "component_id", "root", "row")
    )


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class of near copies: the row with the class's smallest doc_id.

    Documents without shingles are kept. Of rows that share this doc_id, and of rows
    whose class has no doc_id at all, one is kept (the first by a hash of id and text).
    """
    whole = packed(docs, doc_id="bigint", text="string")
    classes = jaccard_classes(whole.select("doc_id", "text"), ["doc_id"], size, percent)
    # a row without shingles is a class of its own
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    own = F.when(F.col("root").isNull(), F.col("row"))
    kept = classes.groupBy("root", own.alias("own")).agg(first.alias("_key")).select("_key")
    keyed = whole.withColumn("_key", F.xxhash64("doc_id", "text"))
    return unpacked(keyed.join(kept, "_key").dropDuplicates(["_key"]), docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id with four-word shingles and a similarity of 85 of 100."""
    found = jaccard_classes(pick(docs, doc_id="bigint", text="string"), ["doc_id"])
    return found.select("doc_id", "n_shingles", "component_id")
