"""The tree of all beginnings that conversations share.

Turns become numbers through a dictionary of their digests, so texts never move. The
number lists are range partitioned in their own order, with the conversation's id as the
last part, so a conversation with very many copies spreads over many shards. A shard puts
its distinct lists in a ternary search tree, the median first and then the medians of both
halves, which keeps the tree balanced; one pass from the last made node back to the root
adds up members, leaves and savings.

Only the beginnings of a shard's first and last list can stand in other shards, too. Their
parts of the sums come together in one stream in shard order, which holds one path at a
time. It has two paths for each shard, whatever the number of conversations is.

Of a conversation longer than HEAD turns only that many go into the tree; no other has the
same ones, or else HEAD doubles for those that share them. Behind it each turn is a node of
this conversation alone, written down row by row. So a list is as long as a beginning that
two conversations share, but no task holds a whole conversation for its length only.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.frames import pick
from loomlight.operators.ordering import group_positions, lookup_join
from loomlight.session import stored

#: Ids below one hundred share the beginning of one conversation, of at most SHARED - 1 turns.
HUNDRED = 100
SHARED = 6
#: Turns of a conversation that go into the tree at first.
HEAD = 1024
#: Ids of members in one row on the way to the digest of a node that several shards hold.
LISTED = 4096

EMPTY = hashlib.sha256(b"").hexdigest()
TURN = "struct<pos:bigint,id:bigint,chars:bigint>"
PARTS = (
    "kind int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, key binary, parent_key binary, chars bigint, "
    "is_open boolean, shard bigint, path int, listed string"
)
NAMES = [x.split()[0] for x in PARTS.split(", ")]
RESULT = NAMES[1:9]
INNER, EDGE, ENDS = 0, 1, 2
ROWS = 10_000


def turns(conversations: DataFrame) -> DataFrame:
    """c, turn, tie, digest and chars of each turn; null roles and texts are empty ones.

    Rows without a conversation id are left out. Turns of one number come in the order of
    ``tie``, a hash of role and text.
    """
    rows = pick(conversations, conv_id="bigint", turn="bigint", role="string", text="string")
    said = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return said.select(
        "c", "turn", F.xxhash64("role", "text").alias("tie"), F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.length("text").cast("bigint").alias("chars"),
    )


def numbered(said: DataFrame) -> DataFrame:
    """``said`` with the dictionary number of each turn in place of its digest, and its place in the conversation."""
    words = said.select("digest").distinct().withColumn("id", F.monotonically_increasing_id())
    words = stored(words, "turns")  # the numbers are fixed from here on
    known = stored(lookup_join(said, words, ["digest"], row_id=["c", "turn", "tie"]).drop("digest"), "numbered")
    return stored(group_positions(known, ["c"], ["turn", "tie"], "pos"), "placed")


def taken() -> F.Column:
    """h: how many turns a conversation takes from the first one of its hundred."""
    return (F.crc32(F.col("c").cast("string").cast("binary")) % SHARED).cast("int")


def gathered(placed: DataFrame, head: int) -> DataFrame:
    """For each conversation: its length, its first turns, and ``head`` turns of its own after the first h."""
    turn = F.struct("pos", "id", "chars")
    first = F.when(F.col("pos") < SHARED - 1, turn)
    own = F.when((F.col("pos") >= taken()) & (F.col("pos") < taken() + head), turn)
    return placed.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(first)).alias("first"),
        F.array_sort(F.collect_list(own)).alias("own"),
    )


def rebuilt(placed: DataFrame, donors: DataFrame, head: int) -> DataFrame:
    """c, the first ``head`` turns of each rebuilt conversation as ids and chars, and how many it has and took."""
    none = F.array().cast(f"array<{TURN}>")
    all_of = gathered(placed, head).withColumn("donor", F.col("c") - F.col("c") % HUNDRED)
    met = all_of.drop("first").join(donors, "donor", "left")
    began = F.slice(F.coalesce("first", none), 1, taken())
    met = met.withColumn("whole", F.slice(F.concat(began, "own"), 1, head)).withColumn("took", F.size(began).cast("bigint"))
    total = F.col("took") + F.greatest(F.col("n") - taken(), F.lit(0).cast("bigint"))
    return met.select(
        "c", F.transform("whole", lambda x: x["id"]).alias("ids"),
        F.transform("whole", lambda x: x["chars"]).alias("chars"), "took", total.alias("total"),
        (total > head).alias("is_open"),
    )


def sequences(placed: DataFrame, head: int = HEAD) -> DataFrame:
    """Every rebuilt conversation, as far as another may share it: those that are open go on alone."""
    first = F.struct("pos", "id", "chars")
    donors = placed.filter((F.col("pos") < SHARED - 1) & (F.col("c") % HUNDRED == 0)).groupBy(F.col("c").alias("donor"))
    donors = stored(donors.agg(F.array_sort(F.collect_list(first)).alias("first")), "donors")
    found = stored(rebuilt(placed, donors, head), "sequences")
    while not found.filter(F.col("is_open") & (F.size("ids") == head)).isEmpty():
        full = found.filter(F.size("ids") == head)
        common = full.groupBy("ids").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ids")
        again = stored(full.filter("is_open").join(common, "ids", "left_semi").select("c"), "longer")
        if again.isEmpty():
            break
        head *= 2
        longer = rebuilt(lookup_join(placed, again, ["c"], row_id=["c", "pos"]), donors, head)
        found = stored(found.join(again, "c", "left_anti").unionByName(longer), "sequences")
    return found


class Tree:
    """A ternary search tree over number lists; each of its nodes is a beginning of some list."""

    def __init__(self):
        self.key, self.low, self.high, self.same = [0], [-1], [-1], [-1]
        self.parent, self.depth, self.chars = [-1], [0], [0]

    def made(self, number: int, chars: int, parent: int) -> int:
        for column, value in (
            (self.key, number), (self.low, -1), (self.high, -1), (self.same, -1), (self.parent, parent),
            (self.depth, self.depth[parent] + 1), (self.chars, chars),
        ):
            column.append(value)
        return len(self.key) - 1

    def insert(self, numbers: list[int], chars: list[int]) -> int:
        """The node of the whole list, made with all nodes on the way where there are none."""
        node = 0
        for number, size in zip(numbers, chars):
            at, link, of = self.same[node], self.same, node
            while at >= 0 and self.key[at] != number:
                link, of = (self.low if number < self.key[at] else self.high), at
                at = link[of]
            if at < 0:
                at = self.made(number, size, node)
                link[of] = at
            node = at
        return node

    def path(self, node: int) -> list[int]:
        """From the root to ``node``."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def medians(n: int):
    """0 to n - 1, the median first, then those of both halves, and so on."""
    spans = [(0, n)]
    for a, b in spans:
        if a < b:
            yield (a + b) // 2
            spans += [(a, (a + b) // 2), ((a + b) // 2 + 1, b)]


def batches_of(rows):
    """Arrow batches of rows given as dicts of PARTS."""
    schema, held = pa.schema(
        [
            (name, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind])
            for name, kind in (x.split() for x in PARTS.split(", "))
        ]
    ), []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def distinct_lists(batches):
    """(ids, chars, is_open, member ids) of each distinct list of a sorted shard."""
    now = None
    for batch in batches:
        ids, chars, members, is_open = (batch.column(i) for i in range(4))
        bounds, numbers, sizes = ids.offsets.to_numpy(), ids.values.to_numpy(), chars.values.to_numpy()
        begins = chars.offsets.to_numpy()
        for i, (member, cut) in enumerate(zip(members.to_pylist(), is_open.to_pylist())):
            own = numbers[bounds[i] : bounds[i + 1]]
            raw = (own.tobytes(), cut)
            if raw != now:
                if now is not None:
                    yield held
                now = raw
                held = (own.tolist(), sizes[begins[i] : begins[i + 1]].tolist(), cut, array("q"))
            held[3].append(member)
    if now is not None:
        yield held


def _shard(batches):
    """Nodes that only this shard holds, whole; parts of those on its first and last path; ids that end there."""
    lists = list(distinct_lists(batches))
    if lists:
        yield from batches_of(_shard_rows(lists, TaskContext.get().partitionId()))


def _shard_rows(lists: list[tuple], shard: int):
    tree, node_of = Tree(), [0] * len(lists)
    for i in medians(len(lists)):
        node_of[i] = tree.insert(lists[i][0], lists[i][1])
    n = len(tree.key)
    members, least, opened = [0] * n, [None] * n, [False] * n
    ends: dict[int, array] = {}
    for node, (_, _, cut, own) in zip(node_of, lists):
        members[node] += len(own)
        least[node] = own[0] if least[node] is None else min(own[0], least[node])
        if cut:
            opened[node] = True
        else:
            ends[node] = own
    paths = [tree.path(node_of[0])]
    if len(lists) > 1:
        paths.append(tree.path(node_of[-1]))
    edge = set().union(*paths)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):  # a node is made after the one it hangs on
        up, inner = tree.parent[i], i not in edge
        if inner:
            leaves[i] += not children[i]
            saved[i] += (members[i] - 1) * tree.chars[i]
            children[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
        members[up] += members[i]
        least[up] = least[i] if least[up] is None else min(least[up], least[i])

    key_of: dict[int, bytes] = {}
    for path in paths:
        digest = hashlib.sha256()
        for node in path:
            if node:
                digest.update(tree.key[node].to_bytes(8, "little", signed=True))
            key_of[node] = digest.copy().digest()
    for i in range(n):
        if i in edge:
            continue
        up = tree.parent[i]
        yield {
            "kind": INNER, "conv_id": least[i], "depth": tree.depth[i],
            "parent_conv_id": None if up in edge else least[up], "parent_key": key_of.get(up),
            "n_convs": members[i], "n_children": children[i] + opened[i], "n_leaves": leaves[i],
            "saved_tokens": saved[i],
            "ends_sha256": hashlib.sha256(",".join(map(str, ends[i])).encode()).hexdigest() if i in ends else EMPTY,
        }
    told = set()
    for at, path in enumerate(paths):
        for node in path:
            new = node not in told
            told.add(node)
            yield {
                "kind": EDGE, "shard": shard, "path": at, "depth": tree.depth[node], "key": key_of[node],
                "chars": tree.chars[node], "is_open": opened[node], "conv_id": least[node],
                "n_convs": members[node] if new else 0, "n_children": children[node] if new else 0,
                "n_leaves": leaves[node] if new else 0, "saved_tokens": saved[node] if new else 0,
            }
            if new and node in ends:
                own = ends[node]
                for i in range(0, len(own), LISTED):
                    yield {
                        "kind": ENDS, "key": key_of[node], "conv_id": own[i],
                        "listed": ",".join(map(str, own[i : i + LISTED])),
                    }


def _merged(batches):
    """Whole nodes from the parts of all shards, which come path by path in the order of the lists."""
    yield from batches_of(_merged_rows(row for batch in batches for row in batch.to_pylist()))


def _merged_rows(rows):
    stack: list[dict] = []

    def done():
        node = stack.pop()
        node["n_leaves"] += not node["n_children"]
        node["saved_tokens"] += (node["n_convs"] - 1) * node["chars"]
        if stack:
            up = stack[-1]
            node["parent_key"] = up["key"]
            for name, value in (("n_children", 1), ("n_leaves", node["n_leaves"]), ("saved_tokens", node["saved_tokens"])):
                up[name] += value
        return node | {"n_children": node["n_children"] + node["is_open"], "kind": EDGE}

    for row in rows:
        depth = row["depth"]
        if depth < len(stack) and stack[depth]["key"] == row["key"]:
            node = stack[depth]
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
            node["is_open"] |= row["is_open"]
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[name] += row[name]
            continue
        while len(stack) > depth:
            yield done()
        stack.append(row)
    while stack:
        yield done()


def _digests(batches):
    """The digest of each key's lists, one after the other as they come: the rows are sorted."""
    now, digest = None, None

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends"]
        )

    for batch in batches:
        for key, listed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != now:
                if now is not None:
                    yield out()
                now, digest = key, hashlib.sha256(listed.encode())
            else:
                digest.update(b"," + listed.encode())
    if now is not None:
        yield out()


def trie(lists: DataFrame) -> DataFrame:
    """The nodes of the tree over ``lists`` (c, ids, chars, is_open): the columns of RESULT.

    Open lists go on behind their end, where they are alone: their last node has one child
    that is not given here. Equal lists are members of the same nodes. No rows, no nodes.
    """
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = lists.select("ids", "chars", "c", "is_open").repartitionByRange(parts, "ids", "c")
    made = stored(order.sortWithinPartitions("ids", "c").mapInArrow(_shard, PARTS), "nodes")
    edges = made.filter(F.col("kind") == EDGE).repartition(1).sortWithinPartitions("shard", "path", "depth")
    edges = stored(edges.mapInArrow(_merged, PARTS), "edges")
    listed = made.filter(F.col("kind") == ENDS).select("key", "conv_id", "listed")
    listed = listed.repartition(parts, "key").sortWithinPartitions("key", "conv_id")
    digests = listed.mapInArrow(_digests, "key binary, ends string")
    parents = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    whole_edges = (
        edges.drop("parent_conv_id", "ends_sha256").join(digests, "key", "left").join(parents, "parent_key", "left")
        .withColumns({"parent_conv_id": F.col("above"), "ends_sha256": F.coalesce("ends", F.lit(EMPTY))})
    )
    inner = made.filter(F.col("kind") == INNER)
    below = inner.filter("parent_key IS NOT NULL").select(*RESULT, "parent_key")
    below = lookup_join(below, parents, ["parent_key"], row_id=["conv_id", "depth"])
    below = below.withColumn("parent_conv_id", F.col("above"))
    return (
        inner.filter("parent_key IS NULL").select(*RESULT).unionByName(below.select(*RESULT))
        .unionByName(whole_edges.select(*RESULT))
    )


def tails(placed: DataFrame, lists: DataFrame) -> DataFrame:
    """The nodes behind the end of open lists: each has the one conversation alone."""
    alone = lists.filter("is_open").select("c", "took", "total", F.size("ids").alias("cut"))
    rows = lookup_join(placed.select("c", "pos"), alone, ["c"], row_id=["c", "pos"])
    depth = F.col("pos") - taken() + F.col("took") + 1
    last = depth == F.col("total")
    name = F.col("c").cast("string").cast("binary")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return rows.filter((F.col("pos") >= taken()) & (depth > F.col("cut"))).select(
        F.col("c").alias("conv_id"), depth.alias("depth"), F.col("c").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(last, F.sha2(name, 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def report(conversations: DataFrame, head: int = HEAD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    Null roles and texts are empty, null turns come first, and turns of the same number (a
    tie, or a repeated row) stand in the order of a hash of role and text. Rows without a
    conv_id are left out; without any conversation there is no node. The hundred of a
    negative id is that of SQL's remainder: -1 belongs to conversation 0. Texts of any length
    count by their code points; extra columns do no harm.
    """
    placed = numbered(turns(conversations))
    lists = sequences(placed, head)
    nodes = trie(lists)
    if lists.filter("is_open").isEmpty():
        return nodes
    return nodes.unionByName(tails(placed, lists))
