"""Sharded, blocked Bloom filters of a bounded size: built by Spark's bitmap aggregates, probed in numpy.

A key is a well mixed 64-bit hash. Its upper 28 bits choose a block of 512 bits among those of its shard, its lower 36 bits
four bits of that block. The number of blocks is bounded, so a filter can be broadcast whatever it was built from: with too
many keys it answers "perhaps" more often and never "no" wrongly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS, _PROBES = 512, 4
_PIECE = 8 * 4096  # bits of a bitmap of bitmap_construct_agg


class Bloom:
    """``first`` and ``size``: first block and number of blocks of each shard."""

    def __init__(self, first: np.ndarray, size: np.ndarray, bytes_: np.ndarray):
        self.first, self.size, self.bytes = first, size, bytes_

    def has(self, h: np.ndarray, shard: int = 0) -> np.ndarray:
        """Which of the hashes (uint64) may be keys of ``shard``."""
        out = np.zeros(len(h), bool)
        if not self.size[shard]:
            return out
        left = np.arange(len(h))
        block = (self.first[shard] + ((h >> np.uint64(36)) % np.uint64(self.size[shard])).astype(np.int64)) * (_BITS // 8)
        for k in range(_PROBES):
            bit = (h >> np.uint64(9 * k)) & np.uint64(_BITS - 1)
            hit = (self.bytes[block + (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
            left, block, h = left[hit], block[hit], h[hit]
        out[left] = True
        return out


def shards(counts: dict[int, int], n_shards: int, bits_per_key: int, limit_mb: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each shard, with at most ``limit_mb`` MB and a block a shard in all."""
    n = np.array([counts.get(k, 0) for k in range(n_shards)], np.float64)
    blocks = n * bits_per_key / _BITS
    most = limit_mb * (1 << 23) // _BITS
    if blocks.sum() > most:
        blocks *= most / blocks.sum()
    size = np.where(n > 0, np.maximum(1, np.floor(blocks)), 0).astype(np.int64)
    return np.cumsum(size) - size, size


def build(keys: DataFrame, first: np.ndarray, size: np.ndarray, h: str = "h", shard: Column | None = None) -> Bloom:
    """The filter of the hashes ``h`` (long). Bits are set and merged by Spark; the driver gets its bytes, which ``size``
    bounds."""
    shard = F.lit(0) if shard is None else shard
    at = lambda x: F.get(F.array(*[F.lit(int(v)) for v in x]), shard)
    block = at(first) + F.shiftrightunsigned(F.col(h), 36) % at(size)
    bits = F.array(*[block * _BITS + F.shiftrightunsigned(F.col(h), 9 * k).bitwiseAND(_BITS - 1) + 1 for k in range(_PROBES)])
    placed = keys.select(F.explode(bits).alias("bit"))
    pieces = placed.groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    total = -(-int(size.sum()) * _BITS // _PIECE) * (_PIECE // 8)
    out = np.zeros(max(total, 1), np.uint8)
    for r in pieces:
        out[(r.piece - 1) * (_PIECE // 8) :][: _PIECE // 8] = np.frombuffer(r.bits, np.uint8)
    return Bloom(first, size, out)
