"""Token counts of byte-level BPE, without merging the words that are one token anyway.

Before the job, each string of the vocabulary is encoded alone. Those that come out as
their own single id are proven whole: wherever such a string stands as a pre-token, it
counts 1, as merges never cross pre-tokens. The proven strings are a table with one entry
for each id at most, whatever the corpus holds. A task splits its texts into pre-tokens,
counts the proven ones by look-up, and merges each distinct other one once.

Nothing is shuffled. What a task remembers of merged pre-tokens is bounded by MEMORY
characters, and long texts are split in stretches of STRETCH characters that end before
a space, where a pre-token ends in any case.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.frames import field, map_texts, pick

LIMIT = 1024
#: Characters of merged pre-tokens after which a task forgets them.
MEMORY = 16_000_000
STRETCH = 1_000_000

#: The pre-tokens of byte-level BPE, and the characters that stand for its bytes.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_of() -> dict[str, int]:
    """The byte for which each character of a vocabulary string stands."""
    others = [b for b in range(256) if b not in PLAIN_BYTES]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}


def merges_of(model: str):
    """A coder that merges one pre-token, as it stands."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores of an executor are Spark's
    return Tokenizer.from_str(model)


def load(path: str) -> dict:
    """Special strings, the model alone, and the proven strings of a byte-level tokenizers file."""
    with open(path, encoding="utf-8") as file:
        full = json.load(file)
    split = full["pre_tokenizer"] or {}
    if full["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or full["normalizer"]:
        raise ValueError(f"{path}: no byte-level BPE without normalizer")
    if split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError(f"{path}: other pre-tokens than those of byte-level BPE")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in full["added_tokens"]):
        raise ValueError(f"{path}: special strings that take in what stands beside them")
    bare = full | {"pre_tokenizer": split | {"use_regex": False}, "added_tokens": [], "post_processor": None}
    model = json.dumps(bare)
    return {
        "special": [t["content"] for t in full["added_tokens"]],
        "model": model,
        "whole": proven(model, full["model"]["vocab"]),
    }


def proven(model: str, vocab: dict[str, int]) -> list[str]:
    """The strings of ``vocab``, as text, that the merges alone make into their own id."""
    known, texts = byte_of(), []
    for piece, at in vocab.items():
        if all(c in known for c in piece):
            try:
                texts.append((bytes(known[c] for c in piece).decode(), at))
            except UnicodeDecodeError:  # a part of a character is never a pre-token
                continue
    found = merges_of(model).encode_batch([t for t, _ in texts], add_special_tokens=False)
    return [t for (t, at), e in zip(texts, found) if e.ids == [at]]


class Counts:
    """Counts the tokens of one text after another."""

    def __init__(self, shared: dict):
        import regex
        from tokenizers import pre_tokenizers

        self.words = regex.compile(PRE_TOKEN).findall
        ascii_only = PRE_TOKEN.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
        # a class of its own where the letters or digits stood outside one
        ascii_only = ascii_only.replace(" ?a-zA-Z+", " ?[a-zA-Z]+").replace(" ?0-9+", " ?[0-9]+")
        self.ascii_words = re.compile(ascii_only, re.ASCII).findall
        self.settled: set[str] = set()  # characters with a category
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.cut = re.compile(r"(?<=[A-Za-z0-9]) ").search
        by_length = sorted(shared["special"], key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, by_length))) if by_length else None
        self.coder = merges_of(shared["model"])
        self.whole = dict.fromkeys(shared["whole"], 1)
        self.cost, self.held = dict(self.whole), 0

    def stretches(self, text: str):
        at = 0
        while len(text) - at > STRETCH:
            found = self.cut(text, at + STRETCH)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words(text)
        new = set(text) - self.settled
        if any(unicodedata.category(c) == "Cn" for c in new):  # versions of Unicode differ in these alone
            return [text[a:b] for _, (a, b) in self.library(text)]
        self.settled |= new
        return self.words(text)

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def plain(self, text: str) -> int:
        total = 0
        for stretch in self.stretches(text):
            words = self.split(stretch)
            try:
                total += sum(map(self.cost.__getitem__, words))
            except KeyError:
                self.merge({w for w in words if w not in self.cost})
                total += sum(map(self.cost.__getitem__, words))
                if self.held > MEMORY:
                    self.cost, self.held = dict(self.whole), 0
        return total

    def merge(self, rest: set[str]) -> None:
        fresh = list(rest)
        for word, found in zip(fresh, self.coder.encode_batch(fresh, add_special_tokens=False)):
            self.cost[word] = len(found.ids)
            self.held += len(word)


def _work(shared):
    def make():
        count = Counts(shared.value)
        return lambda texts: [pa.array([count(t or "") for t in texts.to_pylist()], pa.int64())]

    return make


def counted(docs: DataFrame, path: str, carry: list[str]) -> DataFrame:
    """``carry`` and n_tokens for each row of ``docs`` (text and ``carry``).

    As the tokenizers library counts the whole text without added special tokens; special
    strings inside a text are one token each. Null and empty texts have none, repeated rows
    each get theirs, and a text of any length is counted whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # one entry for each id at most
    return map_texts(docs.select(*carry, "text"), "text", carry, [field("n_tokens", "bigint")], _work(shared))


def report(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: more than ``limit`` tokens.

    Null and empty texts have no bytes and no tokens. Extra columns, also ones with these
    names, do no harm; an empty table gives no rows; there are no ties.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    sized = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    found = counted(sized, path, ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
