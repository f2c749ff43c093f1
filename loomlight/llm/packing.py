"""Lists of numbers in few bytes, for rows that move between executors."""

from __future__ import annotations

import zlib

import numpy as np


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2 to the 32, small ones in few bytes of seven bits each, deflated."""
    v = values.astype(np.uint32)
    size = 1 + sum((v >> (7 * k) > 0).astype(np.int64) for k in range(1, 5)) if len(v) else np.zeros(0, np.int64)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[at[own] + k] = ((v[own] >> (7 * k)) & 127) | np.where(size[own] > k + 1, 128, 0)
    return zlib.compress(out.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(zlib.decompress(raw), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint32)
    start = np.flatnonzero(np.append(True, b[:-1] < 128))
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start).astype(np.uint32)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys: the first one, then the steps in as many bytes as the largest needs."""
    steps = np.diff(keys)
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(planes).tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    steps = np.zeros(((len(raw) - 9) // width if width else 0, 8), np.uint8)
    if width:
        steps[:, :width] = np.frombuffer(raw, np.uint8, offset=9).reshape(width, -1).T
    out = np.concatenate([np.frombuffer(raw, np.uint64, 1, 1), steps.reshape(-1).view(np.uint64)])
    return np.cumsum(out, dtype=np.uint64)
