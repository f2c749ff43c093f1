"""Repeated passages, by a sparse suffix array that sampled splitters range-partition.

Every window of ``size`` bytes has an anchor: the run of KEY bytes in it with the least
hash. Equal windows have equal anchors at the same offset, so only suffixes that begin
at an anchor need to meet. First their leading tokens (the anchor, as 40 bits of hash)
are range-partitioned by sampled splitters and sorted; anchors that stand in one place
only are dropped, and those at the ends of a bucket are kept as they may go on across
the boundary. Then the stretches of text around the anchors that are left meet by
anchor. Each bucket sorts its windows by multikey quicksort, eight bytes at a time,
splitting only groups that are still equal, and marks each window that stands in a
document with a smaller id. Windows are compared by all their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlight.llm.frames import field, pick, pieces, text_buffer
from loomlight.llm.wordhash import mix, powers, prefix_sums
from loomlight.session import stored

SIZE = 50
#: Bytes of an anchor. Longer ones repeat less by chance, shorter ones are fewer.
KEY = 24
#: Low bits of a key that hold a place in a piece of texts while anchors are found.
PLACE = 24
#: Stretches that a bucket sorts at once; a group with more goes on with its distinct windows.
BLOCK = 20_000


def anchors(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For each stretch of windows with one anchor: text, first window, number of windows, anchor (40 bits)."""
    n = len(data) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    sums = prefix_sums(data)
    m = len(data) - KEY + 1
    h = mix((sums[KEY : KEY + m] - sums[:m]) * powers(len(data))[1][:m])
    low = np.uint64((1 << PLACE) - 1)
    key = (h & ~low) | (np.arange(m, dtype=np.uint64) & low)
    width = size - KEY + 1
    least, span = key, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        rest = width - span
        least = np.minimum(least[:-rest], least[rest:])
    inside = np.ones(n, bool)  # windows that do not go on into the next text
    for edge in bounds[1:-1]:
        inside[max(0, edge - size + 1) : min(edge, n)] = False
    fresh = inside.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(fresh)
    ends = inside.copy()
    ends[:-1] &= (least[1:] != least[:-1]) | ~inside[1:]
    count = np.flatnonzero(ends) + 1 - first
    text = np.searchsorted(bounds, first, "right") - 1
    return text, first - bounds[text], count, (least[first] >> np.uint64(PLACE)).astype(np.int64)


def _texts(batch):
    """Pieces small enough for places to fit; a longer text is cut into overlapping parts."""
    for piece in pieces(batch, "text"):
        at = piece.schema.get_field_index
        data, bounds = text_buffer(piece.column(at("text")))
        yield piece, data, bounds


def _found(data, bounds, size):
    limit = (1 << PLACE) - (1 << 10)
    if len(data) <= limit:
        yield anchors(data, bounds, size)
        return
    for begin in range(0, len(data) - size + 1, limit - size):  # one very long text
        part = data[begin : begin + limit]
        text, first, count, key = anchors(part, np.array([0, len(part)]), size)
        yield text, first + begin, count, key


def _suffixes(size: int):
    """(lead, doc): anchors of each text; lead holds the anchor above 24 bits that tell texts apart."""

    def run(batches):
        for batch in batches:
            for piece, data, bounds in _texts(batch):
                docs = piece.column(0).to_numpy()
                tags = piece.column(1).to_numpy()
                for text, _, _, key in _found(data, bounds, size):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((key << 24) | tags[text]), pa.array(docs[text])], names=["lead", "doc"]
                    )

    return run


def _repeated(batches):
    """Rows of sorted anchors that stand in several documents, and those at the ends of a batch."""
    for batch in batches:
        lead, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(lead):
            continue
        key = (lead >> 24) & ((1 << 40) - 1)  # the upper half of the anchors has the sign bit set
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        several[[0, -1]] = True
        keep = np.repeat(several, np.diff(np.append(at, len(key))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[keep]), pa.array(lead[keep] & 0xFFFFFF), pa.array(key[keep])], names=["doc", "tag", "key"]
        )


def _stretches(size: int):
    """(key, doc, tag, first, bytes): the stretches of each text around its repeated anchors."""

    def run(batches):
        for batch in batches:
            for piece, data, bounds in _texts(batch):
                at = piece.schema.get_field_index
                docs, tags = piece.column(at("doc")).to_numpy(), piece.column(at("tag")).to_numpy()
                wanted = piece.column(at("keys"))
                asked = [np.unique(x.values.to_numpy()) for x in wanted]
                raw = data.tobytes()
                for text, first, count, key in _found(data, bounds, size):
                    edges = np.searchsorted(text, np.arange(len(asked) + 1))
                    keep = np.zeros(len(key), bool)
                    for i, own in enumerate(asked):
                        a, b = edges[i], edges[i + 1]
                        place = np.minimum(np.searchsorted(own, key[a:b]), len(own) - 1)
                        keep[a:b] = own[place] == key[a:b]
                    text, first, count, key = text[keep], first[keep], count[keep], key[keep]
                    begin = bounds[text] + first
                    parts = [raw[a : a + n + size - 1] for a, n in zip(begin.tolist(), count.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(docs[text]), pa.array(tags[text]), pa.array(first), pa.array(parts, pa.binary())],
                        names=["key", "doc", "tag", "first", "part"],
                    )

    return run


def multikey_order(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows of 8-byte words) in order, ties by document, and the number of each one's class.

    A multikey quicksort: rows are ordered by one word at a time, and only classes that
    are still of several rows go on to the next word.
    """
    n = len(doc)
    order = np.arange(n)
    cls = np.zeros(n, np.int64)  # class of the row at each rank
    for k in range(words.shape[1]):
        shared = np.append(cls[1:] == cls[:-1], False)
        shared[1:] |= shared[:-1]
        open_ = np.flatnonzero(shared)
        if not len(open_):
            break
        rows = order[open_]
        sub = np.lexsort((words[rows, k], cls[open_]))
        order[open_] = rows[sub]
        value = words[order, k]
        cls = np.cumsum(np.append(True, (cls[1:] != cls[:-1]) | ((value[1:] != value[:-1]) & shared[1:]))) - 1
    final = np.lexsort((doc[order], cls))
    return order[final], cls


def _windows(part: np.ndarray, begin: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """All windows of stretches that lie one after the other, as rows of big-endian words."""
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    width = -(-size // 8) * 8
    rows = np.zeros((len(at), width), np.uint8)
    rows[:, :size] = np.lib.stride_tricks.sliding_window_view(part, size)[at]
    return rows.view(">u8").astype(np.uint64)


def _covered(size: int):
    """(doc, tag, start, stop): bytes of each text whose windows stand in a document with a smaller id.

    Rows come sorted by anchor and document; an anchor's rows are worked off in blocks,
    between which the distinct windows with their smallest document stay.
    """

    def judged(key, docs, parts, old):
        """How many windows each stretch has, whether each is covered, and the distinct windows.

        Equal stretches are one, with their smallest document. Only where an anchor has
        several distinct stretches are their windows sorted.
        """
        coded = parts.dictionary_encode()
        code = coded.indices.to_numpy()
        data, bounds = text_buffer(coded.dictionary)
        windows = np.diff(bounds) - size + 1
        n = len(windows)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, code, docs)
        anchor = np.empty(n, np.int64)
        anchor[code] = key
        _, group, alone = np.unique(anchor, return_inverse=True, return_counts=True)
        several = (alone[group] > 1) | (old is not None)
        first = np.cumsum(windows) - windows
        of_window = np.repeat(least, windows)
        seen = old
        some = np.flatnonzero(several)
        if len(some):
            words = _windows(data, bounds[some], windows[some], size)
            doc = np.repeat(least[some], windows[some])
            skip = 0
            if old is not None:
                words, doc, skip = np.concatenate([old[0], words]), np.concatenate([old[1], doc]), len(old[1])
            order, cls = multikey_order(words, doc)
            head = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
            found = np.empty(len(doc), np.int64)
            found[order] = doc[order][head][cls]
            of_window[np.repeat(several, windows)] = found[skip:]
            seen = (words[order][head], doc[order][head])
        count = windows[code]
        at = np.repeat(first[code] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return count, of_window[at] < np.repeat(docs, count), seen

    def rows(docs, tags, first, count, covered):
        at = np.repeat(np.arange(len(docs)), count)
        offset = np.arange(len(covered)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        begin = covered.copy()
        begin[1:] &= ~covered[:-1] | (at[1:] != at[:-1])
        end = covered.copy()
        end[:-1] &= ~covered[1:] | (at[1:] != at[:-1])
        a, b = np.flatnonzero(begin), np.flatnonzero(end)
        text = at[a]
        return pa.RecordBatch.from_arrays(
            [pa.array(docs[text]), pa.array(tags[text]), pa.array(first[text] + offset[a]), pa.array(first[text] + offset[b] + size)],
            names=["doc", "tag", "start", "stop"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        n, old = 0, None

        for batch in batches:
            at, total = 0, batch.num_rows
            while at < total:
                take = min(total - at, BLOCK - n)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n < BLOCK:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from complete(table.slice(0, cut), key[:cut], old)
                    old, rest = None, table.slice(cut)
                    held, n = rest.to_batches(), rest.num_rows
                else:  # all of one anchor, which may go on
                    out, seen = work(table, old[1] if old and old[0] == key[0] else None, True)
                    old, held, n = (key[0], seen), [], 0
                    yield out
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from complete(table, table.column(0).to_numpy(), old)

    def complete(table, key, old):
        """Rows whose anchors end here; the first anchor may have begun in earlier blocks."""
        same = int(np.searchsorted(key, key[0], "right")) if old and old[0] == key[0] else 0
        if same:
            yield work(table.slice(0, same), old[1])[0]
        if same < table.num_rows:
            yield work(table.slice(same), None)[0]

    def work(table, old, going_on=False):
        table = table.combine_chunks()
        key, docs, tags, first = (table.column(i).to_numpy() for i in (0, 1, 2, 3))
        parts = table.column(4).combine_chunks()
        parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
        count, covered, seen = judged(key, docs, parts, old)
        if going_on and seen is None:  # one stretch so far; more may follow
            data, bounds = text_buffer(parts.slice(0, 1))
            seen = (_windows(data, bounds[:1], np.diff(bounds) - size + 1, size), np.full(int(bounds[1]) - size + 1, docs[0]))
        return rows(docs, tags, first, count, covered), seen

    return run


def _cut(texts, spans) -> tuple[list[bytes], list[list[dict]]]:
    data, bounds = text_buffer(texts)
    raw = data.tobytes()
    kept, removed = [], []
    for a, b, own in zip(bounds[:-1].tolist(), bounds[1:].tolist(), spans):
        runs: list[list[int]] = []
        for x in sorted((x["start"], x["stop"]) for x in own or []):
            if runs and x[0] <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], x[1])
            else:
                runs.append(list(x))
        parts, at = [], a
        for start, stop in runs:
            parts.append(raw[at : a + start])
            at = a + stop
        parts.append(raw[at:b])
        kept.append(b"".join(parts))
        removed.append([{"start": x, "stop": y} for x, y in runs])
    return kept, removed


def without_repeats(docs: DataFrame, carry: list[str], size: int = SIZE) -> DataFrame:
    """For each row of ``docs`` (doc_id, text and ``carry``): n_bytes, removed, kept.

    ``removed`` are the maximal runs of bytes (start, stop) covered by windows of ``size``
    bytes that also begin in a document with a smaller doc_id, ``kept`` the other bytes in
    their order. Null texts are empty. Rows with one doc_id are one document, so repeated
    rows do not cover each other. A row without a doc_id stays whole and covers nothing.
    """
    tag = F.xxhash64("text").bitwiseAND(0xFFFFFF)
    own = list(dict.fromkeys(["doc_id", *carry]))
    keyed = docs.select(
        *own, F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc"),
        F.when(F.col("doc_id").isNull(), tag + (1 << 24)).otherwise(tag).alias("tag"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = keyed.filter(F.col("tag") < 1 << 24).select("doc", "tag", "text")
    # a whole copy of a text in a smaller document is covered as it is
    texts = named.select("doc", "tag", F.md5("text").alias("md5"), F.octet_length("text").cast("bigint").alias("n"))
    firsts = texts.groupBy("md5").agg(F.min("doc").alias("least"))
    copies = texts.join(firsts, "md5").filter((F.col("doc") > F.col("least")) & (F.col("n") >= size))
    copies = stored(copies.select("doc", "tag", "n").distinct(), "copies")
    suffixes = named.mapInArrow(_suffixes(size), "lead bigint, doc bigint")
    ordered = suffixes.repartitionByRange(parts, "lead").sortWithinPartitions("lead")
    repeated = ordered.mapInArrow(_repeated, "doc bigint, tag bigint, key bigint")
    asked = repeated.groupBy("doc", "tag").agg(F.collect_list("key").alias("keys"))
    asked = stored(asked.join(copies, ["doc", "tag"], "left_anti"), "anchors")
    # the same columns as in the last join, so that texts are shuffled once for both
    near = keyed.join(asked, ["doc", "tag"]).select(*own, "doc", "tag", "text", "keys")
    schema = "key bigint, doc bigint, tag bigint, first bigint, part binary"
    stretches = near.mapInArrow(_stretches(size), schema).repartition(parts, "key").sortWithinPartitions("key", "doc")
    covered = stretches.mapInArrow(_covered(size), "doc bigint, tag bigint, start bigint, stop bigint")
    spans = covered.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n").alias("stop"))).alias("spans")
    spans = spans.unionByName(copies.select("doc", "tag", whole))
    both = keyed.join(spans, ["doc", "tag"], "left").select(*own, "text", "spans")
    schema = T.StructType([
        *[both.schema[c] for c in own], field("n_bytes", "bigint"),
        field("removed", "array<struct<start:bigint,stop:bigint>>"), field("kept", "binary"),
    ])
    runs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                at = piece.schema.get_field_index
                texts = piece.column(at("text"))
                kept, removed = _cut(texts, piece.column(at("spans")).to_pylist())
                new = [pa.array(np.diff(text_buffer(texts)[1])), pa.array(removed, runs), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*[piece.column(at(c)) for c in own], *new], names=schema.names)

    return both.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = without_repeats(pick(docs, doc_id="bigint", text="string"), ["doc_id"])
    total = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", total.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
