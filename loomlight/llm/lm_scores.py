"""Stupid-backoff scores from n-gram counts of the whole corpus.

Texts are gathered in chunks of some million words. Each chunk sums its n-grams up before
anything moves, so an n-gram moves once for each chunk however often it stands there. The
counts are partitioned by the hash of the n-gram: a part is a range of hashes, and joins
what all chunks have there to the total over the corpus. The totals go back to the chunks,
which score their texts: the relative count of the longest n-gram that is frequent enough,
times the backoff for each step down. The n-grams of a chunk and part move as one sorted
list, and their totals as another in the same order.

N-grams are told apart by 64 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlight.llm.frames import field, pick, pieces, text_buffer
from loomlight.llm.packing import packed, packed_keys, unpacked, unpacked_keys
from loomlight.llm.wordhash import ALNUM, Words, runs
from loomlight.session import stored

ORDER = 2
BACKOFF = 0.4
#: Count from which an n-gram of two or more words is in the table.
CUTOFF = 2
CHUNK_WORDS = 3_000_000


def _chunked(carry: list[str], schema: T.StructType):
    """One row for each chunk: its rows' carried columns, words of each, word places and word hashes."""

    def run(batches):
        serial = TaskContext.get().partitionId() << 24
        held, sizes, hashes, total = [], [], [], 0

        def chunk():
            known, place, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            rank = np.empty(len(n), np.int64)
            order = np.argsort(-n, kind="stable")  # frequent words get small places, which compress
            rank[order] = np.arange(len(n))
            rows = pa.Table.from_batches(held).combine_chunks()
            parts = [rows.column(i).chunk(0) for i in range(rows.num_columns)]
            carried = pa.StructArray.from_arrays(parts, names=carry)
            one = pa.array([0, len(carried)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([serial], pa.int64()),
                    pa.ListArray.from_arrays(one, carried),
                    pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                    pa.array([packed(rank[place])], pa.binary()),
                    pa.array([known[order].tobytes()], pa.binary()),
                ],
                names=[f.name for f in schema],
            )

        for batch in batches:
            for piece in pieces(batch, "text"):
                at = piece.schema.get_field_index
                data, bounds = text_buffer(piece.column(at("text")))
                words = Words(data, bounds, ALNUM)
                held.append(piece.select(carry))
                sizes.append(words.counts())
                hashes.append(words.hashes())
                total += len(hashes[-1])
                if total >= CHUNK_WORDS:
                    yield chunk()
                    serial, held, sizes, hashes, total = serial + 1, [], [], [], 0
        if held:
            yield chunk()

    return run


def _inside(sizes: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether the n words up to it are of one text."""
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return at >= n - 1


def _words(sizes, words, known) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text of a chunk, and the hashes of all its words in order."""
    h = np.frombuffer(known.as_py(), np.uint64)
    return np.asarray(sizes.values, np.int64), h[unpacked(words.as_py())]


def _counted(h: np.ndarray, sizes: np.ndarray, n: int, parts: int):
    """The distinct n-grams of a chunk, sorted, with their counts, and where each part ends."""
    own = runs(h, n)[_inside(sizes, n)[n - 1 :]]
    key, count = np.unique(own, return_counts=True)
    ends = np.searchsorted(key, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64))
    return key, count, np.concatenate([[0], ends, [len(key)]])


def _grams(order: int, parts: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, h = _words(*(batch.column(k)[i] for k in (1, 2, 3)))
                for n in range(1, order + 1):
                    key, count, bounds = _counted(h, sizes, n, parts)
                    some = np.flatnonzero(np.diff(bounds))
                    pairs = [(bounds[k], bounds[k + 1]) for k in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, pa.int32()), pa.array(np.full(len(some), n), pa.int32()),
                            pa.array(np.full(len(some), batch.column(0)[i].as_py()), pa.int64()),
                            pa.array([packed_keys(key[a:b]) for a, b in pairs], pa.binary()),
                            pa.array([packed(count[a:b]) for a, b in pairs], pa.binary()),
                        ],
                        names=["part", "n", "chunk", "keys", "counts"],
                    )

    return run


def _totals(rows: pa.Table) -> pa.Table:
    """For each chunk's n-grams in one part, their counts over all chunks."""
    keys = [unpacked_keys(x) for x in rows["keys"].to_pylist()]
    counts = [unpacked(x) for x in rows["counts"].to_pylist()]
    size = np.array([len(k) for k in keys])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts)).astype(np.int64)[place]
    ends = np.cumsum(size)
    # more than 2 to the 32 of one n-gram are told as that many
    packs = [packed(np.minimum(total[b - n : b], (1 << 32) - 1)) for n, b in zip(size, ends)]
    return pa.table(
        [rows["chunk"], rows["n"], rows["part"], pa.array(packs, pa.binary())], names=["chunk", "n", "part", "totals"]
    )


def _scored(order: int, total: int, parts: int, carry: list[str], schema: T.StructType):
    def run(chunks: pa.Table, counts: pa.Table) -> pa.Table:
        told = sorted(zip(counts["n"].to_pylist(), counts["part"].to_pylist(), counts["totals"].to_pylist()))
        out = []
        for i in range(chunks.num_rows):
            rows = chunks["rows"][i].values
            sizes, h = _words(*(chunks[c][i] for c in ("sizes", "words", "list")))
            counted = {}
            for n in range(1, order + 1):
                key = _counted(h, sizes, n, parts)[0]
                values = np.concatenate([np.zeros(0, np.uint32), *(unpacked(x) for k, _, x in told if k == n)])
                found = np.zeros(len(h), np.int64)
                grams = runs(h, n)
                if len(key) and len(grams):
                    at = np.minimum(np.searchsorted(key, grams), len(key) - 1)
                    found[n - 1 :] = values[at]
                counted[n] = np.where(_inside(sizes, n), found, 0)
            score = counted[1] / max(total, 1)
            longest = np.minimum(_depth(sizes), order)
            value = np.log(np.maximum(score, 1e-300)) + np.log(BACKOFF) * (longest - 1)
            for k in range(2, order + 1):
                base = np.zeros(len(h), np.int64)
                base[1:] = counted[k - 1][:-1]
                ok = (counted[k] >= CUTOFF) & (base > 0)
                taken = np.log(np.where(ok, counted[k], 1) / np.where(ok, base, 1)) + np.log(BACKOFF) * (longest - k)
                value = np.where(ok, taken, value)
            ends = np.cumsum(sizes)
            total_log = np.array([value[a:b].sum() for a, b in zip(ends - sizes, ends)])
            mean = np.where(sizes > 0, total_log / np.maximum(sizes, 1), np.nan)
            columns = [rows.field(c) for c in carry]
            out.append(
                pa.Table.from_arrays(
                    [*columns, pa.array(sizes), pa.array(mean, mask=np.isnan(mean))], names=[f.name for f in schema]
                )
            )
        return pa.concat_tables(out)

    return run


def _depth(sizes: np.ndarray) -> np.ndarray:
    """For each word, how many words of its text there are up to it."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def scores(docs: DataFrame, carry: list[str], order: int = ORDER) -> DataFrame:
    """For each row of ``docs`` (text and ``carry``): n_words and the mean log score of its words.

    Words are lower-case runs of letters and digits. Counts cover all rows, the scored one
    included, so every word is known. Null and empty texts have no words and a null score;
    repeated rows count as often as they stand there.
    """
    schema = T.StructType([
        field("chunk", "bigint"),
        T.StructField("rows", T.ArrayType(T.StructType([docs.schema[c] for c in carry]))),
        field("sizes", "array<bigint>"), field("words", "binary"), field("list", "binary"),
    ])
    chunks = stored(docs.select(*carry, "text").mapInArrow(_chunked(carry, schema), schema), "chunks")
    bare = chunks.select("chunk", "sizes", "words", "list")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = bare.mapInArrow(_grams(order, parts), "part int, n int, chunk bigint, keys binary, counts binary")
    schema = "chunk bigint, n int, part int, totals binary"
    counts = grams.groupBy("part", "n").applyInArrow(_totals, schema)
    words = chunks.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0
    out = T.StructType([*[docs.schema[c] for c in carry], field("n_words", "bigint"), field("score", "double")])
    both = chunks.groupBy("chunk").cogroup(counts.groupBy("chunk"))
    return both.applyInArrow(_scored(order, words, parts, carry, out), out)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, score."""
    return scores(pick(docs, doc_id="bigint", text="string"), ["doc_id"])
