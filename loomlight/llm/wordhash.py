"""Words of many texts at once: their places in the bytes, and 64-bit hashes of runs of words."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = np.uint64(0xBF58476D1CE4E5B9)
_HIGH = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(separators: bytes) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32  # A-Z become a-z, which leaves the code of A free for the byte 0
    table[0] = 65
    table[list(separators)] = 0
    return table


#: Letters, digits and everything beyond ASCII are words.
ALNUM = _table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Everything but ASCII white space is words.
SPACED = _table(b" \t\n\x0b\x0c\r")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 to the 64, up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 21)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _LOW
    h = (h ^ (h >> np.uint64(27))) * _HIGH
    return h ^ (h >> np.uint64(31))


def prefix_sums(mapped: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run of bytes follows by one subtraction."""
    sums = np.zeros(len(mapped) + 1, np.uint64)
    np.cumsum((mapped.astype(np.uint64) + np.uint64(1)) * powers(len(mapped))[0][: len(mapped)], out=sums[1:])
    return sums


class Words:
    """The words of a piece of texts.

    ``start`` and ``end`` are places in ``mapped``, the bytes in lower case with 0 for
    separators; the words of text i are those from ``first[i]`` up to ``first[i + 1]``.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        self.mapped = table[data]
        inside = self.mapped != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = bounds[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self) -> np.ndarray:
        sums = prefix_sums(self.mapped)
        h = (sums[self.end] - sums[self.start]) * powers(len(self.mapped))[1][self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * _STEP)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at each word, ends of texts ignored."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (size * int(_HIGH)) % (1 << 64), np.uint64)
    for i in range(size):
        out = (out + h[i : i + n]) * _STEP
        out ^= out >> np.uint64(29)
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sha_rows(values) -> list[str]:
    import hashlib

    return [hashlib.sha256(v).hexdigest() for v in values]
