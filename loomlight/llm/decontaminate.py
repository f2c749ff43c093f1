"""Benchmark decontamination: a prefix-filtered set join of windows of benchmark items with texts.

A window of an item is a set of shingles. It occurs in a text only if all its shingles
do, so one of them is a sufficient prefix; the one that is rarest in the corpus is
taken. Texts are searched for these prefix shingles only. Where one stands, its offset
in the window says where the window must begin (positional bound), the text must be
long enough from there (length bound), and the words are then compared one by one.

The benchmark is worked off in blocks of a fixed number of windows, each broadcast and
searched in one more pass over the texts, so what a task holds has a bound however
large the benchmark is. No text is shuffled and no pair of text and item is made before
it is verified, so passages that many documents share make no hot key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlight.llm.frames import ROW, field, packed, pick, pieces, text_buffer, text_rows, unpacked
from loomlight.llm.wordhash import ALNUM, Words, runs, signed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows of the benchmark that one pass searches for; about 100 bytes each in a task.
BLOCK = 200_000


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """(window, items): the distinct windows, words joined by spaces, with the ids of their items.

    A window is ``window`` consecutive words; an item with fewer words, but not none, is
    one window. Null texts have no window; a null id is listed as the word null.
    """
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), 0)
    split = pick(items, item_id="string", text="string").select(
        F.coalesce("item_id", F.lit("null")).alias("item_id"), words.alias("w")
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    placed = split.filter(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("at"))
    cut = placed.select("item_id", F.array_join(F.slice("w", F.col("at"), F.lit(window)), " ").alias("window"))
    return cut.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


class Block:
    """Some windows of the benchmark with their shingles, as small arrays."""

    def __init__(self, rows, shingle: int):
        self.text = [r["window"].encode() for r in rows]
        self.items = [list(r["items"]) for r in rows]
        data = np.frombuffer(b"\0".join(self.text) or b"", np.uint8)
        sizes = np.array([len(t) + 1 for t in self.text], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        bounds[-1] = len(data)
        words = Words(data, bounds, ALNUM)
        self.n_words = words.counts()
        self.first = words.first
        h = words.hashes()
        self.size = np.minimum(self.n_words, shingle)
        by_size = {k: runs(h, int(k)) for k in np.unique(self.size)}
        self.shingles = [
            by_size[k][a : b - k + 1] for k, a, b in zip(self.size, words.first[:-1], words.first[1:])
        ]
        self.sizes = [int(k) for k in np.unique(self.size)]
        self.known = {
            k: np.unique(np.concatenate([s for s, own in zip(self.shingles, self.size) if own == k]))
            for k in self.sizes
        }

    def prefixes(self, counts: dict[int, int]) -> dict:
        """For each size of shingle: sorted prefix shingles and, aligned, window and offset."""
        chosen: dict[int, list] = {k: [] for k in self.sizes}
        for i, (k, own) in enumerate(zip(self.size, self.shingles)):
            n = [counts.get(x, 0) for x in signed(own).tolist()]
            at = min(range(len(n)), key=lambda j: (n[j], own[j]))
            chosen[int(k)].append((int(own[at]), i, at))
        out = {}
        for k, rows in chosen.items():
            rows.sort()
            out[k] = tuple(
                np.array([r[j] for r in rows], np.uint64 if j == 0 else np.int64) for j in range(3)
            )
        return out


class _Counter:
    """Occurrences, in the texts of a task, of the shingles that a block knows."""

    def __init__(self, known: dict[int, np.ndarray]):
        self.known = known
        self.n = {k: np.zeros(len(v), np.int64) for k, v in known.items()}

    def take(self, batch):
        data, bounds = text_buffer(batch.column(0))
        words = Words(data, bounds, ALNUM)
        h = words.hashes()
        for k, known in self.known.items():
            found = runs(h, k)
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            self.n[k] += np.bincount(at[known[at] == found], minlength=len(known))
        return []

    def rest(self):
        for k, known in self.known.items():
            yield [pa.array(signed(known)), pa.array(self.n[k])]


class _Search:
    """Verified windows of a block in a piece of texts: (text, first word, end word, window)."""

    def __init__(self, text: list[bytes], items: list[list[str]], n_words: np.ndarray, prefixes: dict):
        self.text, self.items, self.n_words, self.prefixes = text, items, n_words, prefixes

    def __call__(self, words: Words) -> list[tuple[int, int, int, int]]:
        h = words.hashes()
        found, mapped = [], None
        for k, (keys, window, offset) in self.prefixes.items():
            here = runs(h, k)
            if not len(here) or not len(keys):
                continue
            lo = np.searchsorted(keys, here, "left")
            hit = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == here))
            for at in hit:
                end = np.searchsorted(keys, here[at], "right")
                doc = int(np.searchsorted(words.first, at, "right")) - 1
                for j in range(lo[at], end):
                    w = int(window[j])
                    begin = int(at - offset[j])
                    stop = begin + int(self.n_words[w])
                    if begin < words.first[doc] or stop > words.first[doc + 1]:
                        continue
                    mapped = mapped or words.mapped.tobytes()
                    mine = b" ".join(
                        mapped[a:b] for a, b in zip(words.start[begin:stop], words.end[begin:stop])
                    )
                    if mine == self.text[w]:
                        found.append((doc, begin - int(words.first[doc]), stop - int(words.first[doc]), w))
        return found


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def contamination(
    docs: DataFrame, items: DataFrame, carry: list[str], window: int = 10, shingle: int = 3, block: int = BLOCK
) -> DataFrame:
    """For each row of ``docs`` (``text`` and ``carry``): n_words, hits, items.

    ``hits`` are the maximal runs of words (start, end) inside occurrences of windows,
    ``items`` the sorted ids, as strings, of the items whose windows occur. Null and
    empty texts have no words and no hits; repeated rows each get their own result; an
    empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    windows = item_windows(items, window).withColumn("_h", F.xxhash64("window")).cache()
    try:
        blocks = max(1, math.ceil(windows.count() / block))
        out = docs.select(
            *carry, "text", F.lit(None).cast("bigint").alias("n_words"),
            F.array().cast("array<struct<start:bigint,end:bigint>>").alias("hits"),
            F.array().cast("array<string>").alias("items"),
        )
        for i in range(blocks):
            rows = windows.filter(F.pmod("_h", F.lit(blocks)) == i).orderBy("window").collect()
            own = Block(rows, shingle)
            known = spark.sparkContext.broadcast(own.known)
            fields = [field("h", "bigint"), field("n", "bigint")]
            counted = text_rows(docs.select("text"), "text", fields, lambda b=known: _Counter(b.value))
            counts = {r["h"]: r["n"] for r in counted.groupBy("h").agg(F.sum("n").alias("n")).collect()}
            shared = spark.sparkContext.broadcast((own.text, own.items, own.n_words, own.prefixes(counts)))
            out = _searched(out, carry, shared, ["text"] if i + 1 < blocks else [])
        return out
    finally:
        windows.unpersist()


def _searched(docs: DataFrame, carry: list[str], shared, more: list[str]) -> DataFrame:
    fields = [
        field("n_words", "bigint"), field("hits", "array<struct<start:bigint,end:bigint>>"),
        field("items", "array<string>"),
    ]
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
    old = F.struct("hits", "items").alias("_old")
    both = docs.select(*carry, "text", old)

    def make():
        search = _Search(*shared.value)

        def work(texts, before):
            data, bounds = text_buffer(texts)
            words = Words(data, bounds, ALNUM)
            spans: dict[int, list] = {}
            ids: dict[int, set] = {}
            for doc, begin, stop, w in search(words):
                spans.setdefault(doc, []).append((begin, stop))
                ids.setdefault(doc, set()).update(search.items[w])
            hits, items = [], []
            for i, past in enumerate(before):
                mine = spans.get(i, [])
                hits.append(_merge([*mine, *((x["start"], x["end"]) for x in past["hits"])]))
                items.append(sorted(ids.get(i, set()) | set(past["items"])))
            pairs = [[{"start": a, "end": b} for a, b in row] for row in hits]
            return [pa.array(words.counts(), kinds[0]), pa.array(pairs, kinds[1]), pa.array(items, kinds[2])]

        return work

    schema = T.StructType([*[both.schema[c] for c in [*carry, *more]], *fields])

    def run(batches):
        work = make()
        for batch in batches:
            for piece in pieces(batch, "text"):
                at = piece.schema.get_field_index
                kept = [piece.column(at(c)) for c in [*carry, *more]]
                new = work(piece.column(at("text")), piece.column(at("_old")).to_pylist())
                yield pa.RecordBatch.from_arrays([*kept, *new], names=schema.names)

    return both.mapInArrow(run, schema)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window of a benchmark item occurs, all columns as they were."""
    whole = packed(docs, text="string")
    return unpacked(contamination(whole, items, [ROW]).filter(F.size("items") == 0), docs.columns)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hits themselves."""
    found = contamination(pick(docs, doc_id="bigint", text="string"), items, ["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
