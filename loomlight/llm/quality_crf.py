"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. How likely, depends on features of the line and of the lines
before and after it, and on the label of the line before. The label of a training document
is taken for each of its lines. Marginals by forward and backward passes, weighted by the
length of the lines, give the quality of a document; a logistic curve fitted on the same
sample makes it a probability.

The model is fitted on a sample of at most SAMPLE labelled documents: those with the
smallest hash of doc_id among the rows that may be learnt from. Scoring is one pass over
all texts without a shuffle. Labels, language, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.frames import ROW, field, map_texts, packed, pick, text_buffer
from loomlight.llm.wordhash import SPACED, Words, mix, powers, prefix_sums, runs

#: Most labelled documents that a model is fitted on.
SAMPLE = 4000
STEPS, RATE, DECAY = 120, 0.08, 1e-4
HALF = 0.3

_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "symbol": b"#*$%&|<>", "bar": b"|", "bang": b"!",
    "wide": bytes(range(0x80, 0xC0)), "space": b" \t\r\x0b\x0c",
}
_FLAGS = {}
for _i, (_name, _members) in enumerate(_CLASSES.items()):
    _FLAGS[_name] = np.zeros(256, np.uint8)
    _FLAGS[_name][list(_members)] = 1

#: Number of features of a line on its own.
WIDTH = 18


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, the first line of each text, and the bytes of each line.

    A text without such a line has one line without words.
    """
    words = Words(data, bounds, SPACED)
    h = words.hashes()
    breaks = np.flatnonzero(data == 10)
    # lines begin at the begin of a text and behind each break
    begin = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    begin = begin[begin <= (bounds[-1] if len(bounds) else 0)]
    stop = np.append(begin[1:], len(data))
    first = np.searchsorted(words.start, begin)
    n = np.searchsorted(words.start, stop) - first
    empty = np.flatnonzero(np.diff(words.first) == 0)
    full = n > 0
    begin, stop, first, n = begin[full], stop[full], first[full], n[full]
    text = np.searchsorted(words.first, first, "right") - 1
    size = len(begin)
    count = {}
    for name, flags in _FLAGS.items():
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags[data], out=sums[1:])
        count[name] = (sums[stop] - sums[begin]).astype(float)
    chars = np.maximum(stop - begin - count["wide"], 1)
    # words equal to the word before, and words in runs of four that stand elsewhere in the text
    of_text = np.repeat(np.arange(len(bounds) - 1), np.diff(words.first)).astype(np.uint64)
    same = np.zeros(len(h) + 1, np.int64)
    if len(h):
        same[2:] = np.cumsum((h[1:] == h[:-1]) & (of_text[1:] == of_text[:-1]))
    again = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 4:
        four = runs(h, 4) + mix(of_text[: len(h) - 3] + np.uint64(1))
        order = np.argsort(four)
        twin = np.zeros(len(four), bool)
        equal = four[order][1:] == four[order][:-1]
        twin[order[1:]] |= equal
        twin[order[:-1]] |= equal
        again[1 : len(four) + 1] = np.cumsum(twin)
        again[len(four) + 1 :] = again[len(four)]
    sums = prefix_sums(words.mapped)
    line_hash = (sums[stop] - sums[begin]) * powers(len(data))[1][begin] if size else np.zeros(0, np.uint64)
    key = mix(line_hash + mix(text.astype(np.uint64) + np.uint64(7)))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[inverse] > 1 if size else np.zeros(0, bool)
    end = first + n
    stutter = (same[end] - same[np.minimum(first + 1, end)]) / n
    repeat = (again[end] - again[first]) / n
    last = data[np.maximum(words.end[end - 1] - 1, 0)] if size else np.zeros(0, np.uint8)
    f = np.zeros((size, WIDTH))
    f[:, 0] = 1
    f[:, 1] = np.log1p(n) / 5
    f[:, 2] = np.minimum((chars - count["space"]) / n / 5, 4)
    f[:, 3] = np.minimum(count["symbol"] / n, 3)
    f[:, 4] = count["upper"] / chars
    f[:, 5] = count["digit"] / chars
    f[:, 6] = np.minimum(count["bar"] / n, 1)
    f[:, 7] = np.minimum(count["bang"] / n, 2)
    f[:, 8] = stutter
    f[:, 9] = repeat
    f[:, 10] = twice
    f[:, 11] = last == 46
    f[:, 12] = count["wide"] / chars
    f[:, 13] = f[:, 3] > 0.25
    f[:, 14] = f[:, 4] > 0.3
    f[:, 15] = stutter > 0.2
    f[:, 16] = repeat > 0.3
    f[:, 17] = n < 5
    if len(empty):
        place = np.searchsorted(text, empty)
        bare = np.zeros(WIDTH)
        bare[[0, 17]] = 1
        f = np.insert(f, place, bare, axis=0)
        text = np.insert(text, place, empty)
        size_bytes = np.insert(stop - begin, place, 1)
    else:
        size_bytes = stop - begin
    return f, np.searchsorted(text, np.arange(len(bounds))), size_bytes.astype(float)


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and of the line after, 0 at the ends of a text."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([f, before, after])


def chain(score: np.ndarray, first: np.ndarray, stay: np.ndarray):
    """Marginals of good at each line, and of good-good and bad-bad at each line but the first of a text.

    ``score`` is what good has over bad at a line; ``stay`` is what two good, and two bad,
    lines in a row have over a change. All texts go forward together, the longest first.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    start, sizes = first[:-1][order], sizes[order]
    good, bad = float(stay[0]), float(stay[1])
    ahead = np.zeros((len(score), 2))  # logs of forward sums: bad, good
    behind = np.zeros((len(score), 2))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    ahead[start, 1] = score[start]
    for t in range(1, longest):
        at = start[: active[t]] + t
        b, g = ahead[at - 1, 0], ahead[at - 1, 1]
        ahead[at, 0] = np.logaddexp(b + bad, g)
        ahead[at, 1] = np.logaddexp(b, g + good) + score[at]
        top = np.maximum(ahead[at, 0], ahead[at, 1])
        ahead[at] -= top[:, None]
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        b = behind[at + 1, 0]
        g = behind[at + 1, 1] + score[at + 1]
        behind[at, 0] = np.logaddexp(b + bad, g)
        behind[at, 1] = np.logaddexp(b, g + good)
        top = np.maximum(behind[at, 0], behind[at, 1])
        behind[at] -= top[:, None]
    total = ahead + behind
    marginal = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700)))
    inner = np.ones(len(score), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    b, g = ahead[at - 1, 0], ahead[at - 1, 1]
    to_b, to_g = behind[at, 0], behind[at, 1] + score[at]
    parts = np.stack([g + good + to_g, b + bad + to_b, b + to_g, g + to_b])
    parts = np.exp(parts - parts.max(0)) if len(at) else parts
    parts = parts / parts.sum(0) if len(at) else parts
    return marginal, parts[0], parts[1], at


def fit(f: np.ndarray, first: np.ndarray, size: np.ndarray, label: np.ndarray) -> dict:
    """Weights, transitions and the final curve, by gradient steps of fixed number and size."""
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.5
        odds = float(np.log((share + 0.01) / (1.01 - share)))
        return {"w": np.zeros(3 * WIDTH), "stay": np.zeros(2), "curve": (0.0, odds)}
    x = with_neighbours(f, first)
    y = np.repeat(label, np.diff(first)).astype(float)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    want = np.array([(y * inner).sum(), ((1 - y) * inner).sum()])
    theta = np.zeros(x.shape[1] + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        p, gg, bb, _ = chain(x @ theta[:-2], first, theta[-2:])
        slope = np.concatenate([x.T @ (y - p), want - [gg.sum(), bb.sum()]]) / len(y) - DECAY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = {"w": theta[:-2], "stay": theta[-2:], "curve": (1.0, 0.0)}
    z = weighted(f, first, size, model)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a little damping
        q = 1 / (1 + np.exp(-(a * z + b)))
        r = q * (1 - q) + 1e-9
        slope = np.array([((label - q) * z).sum() - 0.01 * (a - 1), (label - q).sum()])
        bend = np.array([[(r * z * z).sum() + 0.01, (r * z).sum()], [(r * z).sum(), r.sum() + 0.01]])
        move = np.clip(np.linalg.solve(bend, slope), -1, 1)
        a, b = a + move[0], b + move[1]
    return model | {"curve": (float(a), float(b))}


def weighted(f: np.ndarray, first: np.ndarray, size: np.ndarray, model: dict) -> np.ndarray:
    """Log odds of the length-weighted mean of the lines' marginals, for each text."""
    p = chain(with_neighbours(f, first) @ model["w"], first, model["stay"])[0]
    total = np.add.reduceat(p * size, first[:-1]) if len(first) > 1 else np.zeros(0)
    weight = np.add.reduceat(size, first[:-1]) if len(first) > 1 else np.ones(0)
    mean = np.clip(total / weight, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    own = pick(labels, doc_id="bigint", quality="int").filter("quality IN (0, 1) AND doc_id IS NOT NULL")
    own = own.filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = pick(docs, doc_id="bigint", text="string").join(F.broadcast(chosen), "doc_id")
    fields = [field("features", "array<float>"), field("sizes", "array<float>")]

    def make():
        def work(texts):
            data, bounds = text_buffer(texts)
            f, first, size = line_features(data, bounds)
            at = pa.array(first, pa.int32())
            flat = pa.array(f.reshape(-1), pa.float32())
            wide = pa.ListArray.from_arrays(pa.array(first * WIDTH, pa.int32()), flat)
            return [wide, pa.ListArray.from_arrays(at, pa.array(size, pa.float32()))]

        return work

    rows = map_texts(joined, "text", ["doc_id", "quality"], fields, make).orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, WIDTH)), np.zeros(1, np.int64), np.zeros(0), np.zeros(0))
    features = rows["features"].combine_chunks()
    sizes = rows["sizes"].combine_chunks()
    n = sizes.value_lengths().to_numpy(zero_copy_only=False)
    f = features.flatten().to_numpy().astype(float).reshape(-1, WIDTH)
    first = np.concatenate([[0], np.cumsum(n)])
    return fit(f, first, sizes.flatten().to_numpy().astype(float), rows["quality"].to_numpy().astype(float))


def scored(docs: DataFrame, carry: list[str], model: dict) -> DataFrame:
    """``carry`` and score (0 to 1) of each row of ``docs`` (text and ``carry``).

    Null and empty texts count as one line without words; repeated rows get the same.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        a, b = own["curve"]

        def work(texts):
            z = weighted(*line_features(*text_buffer(texts)), own)
            return [pa.array(1 / (1 + np.exp(-np.clip(a * z + b, -700, 700))))]

        return work

    return map_texts(docs, "text", carry, [field("score", "double")], make)


def with_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` as a struct ``document`` beside their score, by a model learnt from ``labels``."""
    found = scored(packed(docs, text="string"), [ROW], learn(docs, labels))
    names = F.struct(*[F.col(ROW)[f"_c{i}"].alias(c) for i, c in enumerate(docs.columns)])
    return found.select(names.alias("document"), "score")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = scored(pick(docs, doc_id="bigint", text="string"), ["doc_id"], learn(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= HALF).cast("int").alias("predicted"))
