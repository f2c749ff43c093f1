"""Byte pair encoding through a table of distinct words, and decoding through the table of pieces.

Texts are split into words in chunks of some million words. A chunk keeps, for each text,
the places of its words in the chunk's own word list, frequent words first. The word
lists, cut by a hash of the word, meet so that each distinct word of the corpus is encoded
once; the ids go back to the chunks that asked, and are put in by position. A frequent
word moves once for each chunk, however often it stands there. Lists move deflated.

The tokenizer file is read once on the driver and sent along; its size does not depend
on the data. It must split by a pattern and encode each word alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlight.llm.frames import field, pick, pieces
from loomlight.llm.packing import packed, unpacked
from loomlight.session import stored

#: Words of a chunk after which a new one begins.
CHUNK_WORDS = 3_000_000
#: Texts of a chunk whose ids and decoded text are made at once.
SLICE = 256


def load(path: str) -> dict:
    """What the steps need of a tokenizers file: pattern, special tokens, model, pieces by id."""
    with open(path, encoding="utf-8") as file:
        full = json.load(file)
    steps = full["pre_tokenizer"]["pretokenizers"]
    split = next(s for s in steps if s["type"] == "Split")
    level = next(s for s in steps if s["type"] == "ByteLevel")
    special = {t["content"]: t["id"] for t in full["added_tokens"]}
    vocab = full["model"]["vocab"] | special
    by_id = [""] * (max(vocab.values()) + 1)
    for piece, at in vocab.items():
        by_id[at] = piece
    bare = full | {"normalizer": None, "pre_tokenizer": level, "added_tokens": []}
    return {"pattern": split["pattern"]["Regex"], "special": special, "model": json.dumps(bare), "pieces": by_id}


class Splitter:
    """Splits a text as the tokenizer does before its merges: NFC, lower case, pattern."""

    def __init__(self, pattern: str, special: dict[str, int]):
        import regex

        self.words = regex.compile(pattern).findall
        # the same for texts of ASCII only, where letters and digits are few
        plain = pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
        self.ascii_words = self.words if r"\p" in plain else re.compile(plain, re.ASCII).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.special is None or "<" not in text:
            return self.plain(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(part)
            else:
                out.extend(self.plain(part))
        return out

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words(text.lower())
        return self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


class Places(dict):
    """Words with the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def _chunks(shared, carry: list[str], schema: T.StructType, parts: int):
    """Rows of a chunk: its texts as places of words, then its word list cut into ``parts``."""

    def run(batches):
        splitter = Splitter(shared.value["pattern"], shared.value["special"])
        serial = TaskContext.get().partitionId() << 24
        names = [f.name for f in schema]
        known, kept, places, seen = Places(), [], [], 0

        def chunk():
            asked = np.concatenate(places) if places else np.zeros(0, np.uint32)
            count = np.bincount(asked, minlength=len(known))
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            i = 0
            for rows in kept:
                n = rows.num_rows
                raw = [packed(rank[x]) for x in places[i : i + n]]
                i += n
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns, pa.array([serial] * n, pa.int64()), pa.array(raw, pa.binary()),
                        pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                    ],
                    names=names,
                )
            words = list(known)
            part = np.array([zlib.crc32(w.encode()) % parts for w in words], np.int64)
            for k in range(parts):
                own = np.sort(rank[part == k])
                if not len(own):
                    continue
                steps = packed(np.diff(own, prepend=np.uint32(0)))
                listed = zlib.compress("\n".join([words[j] for j in order[own].tolist()]).encode(), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.nulls(1, c.type) for c in kept[0].columns], pa.array([serial], pa.int64()),
                        pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([steps], pa.binary()),
                        pa.array([listed], pa.binary()),
                    ],
                    names=names,
                )

        for batch in batches:
            for piece in pieces(batch, "text"):
                kept.append(piece.select(carry))
                for text in piece.column(piece.schema.get_field_index("text")).to_pylist():
                    words = splitter(text or "")
                    seen += len(words)
                    places.append(np.array(list(map(known.__getitem__, words)), np.uint32))
                if seen >= CHUNK_WORDS:
                    yield from chunk()
                    pa.default_memory_pool().release_unused()
                    serial, known, kept, places, seen = serial + 1, Places(), [], [], 0
        if kept:
            yield from chunk()

    return run


def _encode(shared):
    """The ids of each chunk's words of one part. Parts come one after the other; a word is encoded once."""

    def run(batches):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(shared.value["model"])
        special = shared.value["special"]
        now, ids = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                if part != now:
                    now, ids = part, {w: [at] for w, at in special.items()}
                words = zlib.decompress(batch.column(3)[i].as_py()).decode().split("\n")  # no word has a line break
                fresh = [w for w in words if w not in ids]
                for w, e in zip(fresh, coder.encode_batch(fresh, add_special_tokens=False)):
                    ids[w] = e.ids
                lists = [ids[w] for w in words]
                sizes = np.array([len(x) for x in lists], np.uint32)
                flat = np.array([x for own in lists for x in own], np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(i, 1), batch.column(2).slice(i, 1),
                        pa.array([packed(sizes)], pa.binary()), pa.array([packed(flat)], pa.binary()),
                    ],
                    names=["chunk", "steps", "sizes", "ids"],
                )

    return run


def _placed(shared, carry: list[str], schema: T.StructType):
    """Puts the ids of a chunk's words in by position, and decodes them by the table of pieces."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        by_id = np.array(shared.value["pieces"], object)
        columns = [[unpacked(x) for x in words[c].to_pylist()] for c in ("steps", "sizes", "ids")]
        none = [np.zeros(0, np.uint32)]
        order = np.argsort(np.concatenate([np.cumsum(x) for x in columns[0]] or none))
        sizes = np.concatenate(columns[1] or none).astype(np.int64)
        flat = np.concatenate(columns[2] or none).astype(np.int32)
        begins = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        shown = [" ".join(by_id[flat[b : b + n]]) for b, n in zip(begins.tolist(), sizes.tolist())]
        out = []
        for rows in texts.to_batches(max_chunksize=SLICE):
            ids, decoded = [np.zeros(0, np.int32)], []
            for raw in rows.column(rows.schema.get_field_index("words")).to_pylist():
                at = unpacked(raw)
                n = sizes[at]
                place = np.repeat(begins[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                ids.append(flat[place])
                decoded.append(" ".join([shown[i] for i in at.tolist()]))
            ends = np.cumsum([len(x) for x in ids])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
            kept = [rows.column(rows.schema.get_field_index(c)) for c in carry]
            new = [*kept, listed, pa.array(decoded, pa.string())]
            out.append(pa.RecordBatch.from_arrays(new, names=[f.name for f in schema]))
        done = pa.Table.from_batches(out)
        pa.default_memory_pool().release_unused()
        return done

    return run


def encoded(docs: DataFrame, path: str, carry: list[str]) -> DataFrame:
    """``carry``, ids and decoded text for each row of ``docs`` (text and ``carry``).

    As the tokenizers library encodes the whole text without added special tokens, and
    decodes the ids with special tokens shown. Null and empty texts have no ids and the
    empty text; repeated rows each get theirs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    kept = [T.StructField(f.name, f.dataType, True) for f in (docs.schema[c] for c in carry)]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([
        *kept, field("chunk", "bigint"), field("words", "binary"), field("part", "int"), field("steps", "binary"),
        field("list", "binary"),
    ])
    split = stored(docs.select(*carry, "text").mapInArrow(_chunks(shared, carry, schema, parts), schema), "words")
    texts = split.filter("words IS NOT NULL").select(*carry, "chunk", "words")
    asked = split.filter("list IS NOT NULL").select("part", "chunk", "steps", "list")
    by_word = asked.repartition(parts, "part").sortWithinPartitions("part")
    answers = by_word.mapInArrow(_encode(shared), "chunk bigint, steps binary, sizes binary, ids binary")
    out = T.StructType([*kept, field("ids", "array<int>"), field("decoded", "string")])
    both = texts.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(_placed(shared, carry, out), out)


def decode(ids: DataFrame, path: str, carry: list[str]) -> DataFrame:
    """``carry`` and the text of each row's ``ids``, by a join with the table of pieces.

    The table has one row for each id of the vocabulary, so its size has a bound. A null
    or empty list is the empty text; ``carry`` must tell the rows apart.
    """
    pieces_by_id = load(path)["pieces"]
    spark = ids.sparkSession
    table = spark.createDataFrame(list(enumerate(pieces_by_id)), "id int, piece string")
    placed = ids.select(*carry, F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(table), "id", "left")
    listed = placed.groupBy(*carry).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return listed.select(*carry, F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("decoded"))


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    found = encoded(pick(docs, doc_id="bigint", text="string"), path, ["doc_id"])
    shown = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(shown.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
