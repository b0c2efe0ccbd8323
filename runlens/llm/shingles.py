"""Hashed word shingles of whole Arrow batches of texts, without a Python step per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64

_WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_RNG = np.random.default_rng(20240101)
_BYTE_CODE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _STEP)]))
    return _POWERS


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text index and 64-bit hash of each word: runs of ASCII letters and digits and non-ASCII characters, lower-cased."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = len(low)
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + n + 1]
    data = low.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    bounds = offsets - offsets[0]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = _WORD_BYTE[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, ~inside[:-1]
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    head = np.flatnonzero(first[at])
    size = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, size)
    with np.errstate(over="ignore"):
        value = _BYTE_CODE[data[at]] * _powers(int(size.max()) + 1)[place]
        hashed = mix64(np.add.reduceat(value, head) + size.astype(np.uint64))
    return np.searchsorted(bounds, at[head], "right") - 1, hashed


def sequence_digest(doc: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence (0 for texts without words)."""
    out = np.zeros((2, n), np.uint64)
    if len(doc):
        head = np.flatnonzero(np.diff(doc, prepend=-1))
        place = (np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc))))).astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(2):
                out[k, doc[head]] = mix64(np.add.reduceat(mix64(word + (place + np.uint64(1)) * np.uint64(0xA24BAED4963EE407 + 2 * k)), head) + np.uint64(k + 1))
    return out[0], out[1]


def shingles(doc: np.ndarray, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash (its upper 44 bits count) and count of each text's distinct shingles, sorted; a shorter text is one
    shingle of all its words."""
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    head = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(np.append(head, len(doc)))
    left = np.repeat(size, size) - (np.arange(len(doc)) - np.repeat(head, size))
    start = np.flatnonzero((left >= width) | ((left == np.repeat(size, size)) & (left < width)))
    with np.errstate(over="ignore"):
        h = np.zeros(len(start), np.uint64)
        for k in range(width):
            there = left[start] > k
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(there, word[np.minimum(start + k, len(word) - 1)], np.uint64(0))
        h = mix64(h)
    # 44 bits of a hash behind 20 of the text's index make one integer to sort; texts beyond come a part at a time
    parts = []
    who = doc[start]
    for lo in range(0, int(who[-1]) + 1, 1 << 20):
        a, b = np.searchsorted(who, (lo, lo + (1 << 20)))
        both = np.sort(((who[a:b] - lo).astype(np.uint64) << np.uint64(44)) | (h[a:b] >> np.uint64(20)))
        new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, np.int64)
        parts.append(((both[new] >> np.uint64(44)).astype(np.int64) + lo, both[new] << np.uint64(20), np.diff(np.append(new, len(both)))))
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))
