"""Lattices of a fixed public SentencePiece vocabulary: which pieces can end at each place of a text.

A text is cut into units at places that no piece crosses: before a space that follows another character, and around
characters that stand in no piece. So a text's segmentations are the products of its units', and a unit's lattice is
built once for all its occurrences. A space stands for the vocabulary's word mark; a literal U+2581 of a text is no
piece and falls back to bytes, as any other character without a piece, so decoding is lossless.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
NONE = -2
_SLOT_BITS = 20
_TOP, _MID, _LOW = np.uint64(64 - _SLOT_BITS), np.uint64(20), np.uint64((1 << _SLOT_BITS) - 1)


def piece_bytes(model: bytes) -> list[bytes]:
    """What each piece decodes to; empty for control pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = lambda i: not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() if plain(i) else b"" for i in range(sp.vocab_size())]


class Vocabulary:
    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.vocab_size()
        self.byte_ids = [0] * 256
        #: Text of a piece -> id; -1 for what only starts a longer piece.
        self.table: dict[str, int] = {}
        self.scores = np.full(self.size, -np.inf)
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace(MARK, " ")
                self.table[text], self.scores[i] = i, sp.get_score(i)
        crossing = [p for p in self.table if " " in p[1:] and p.strip(" ")]
        if crossing:
            raise ValueError(f"pieces cross word starts: {crossing[:3]}")
        self.longest = max(map(len, self.table))
        #: Bytes of characters that stand in no piece and are units by themselves.
        self.alone = np.zeros(256, bool)
        self.alone[[ord(c) for c in "\n\t\r" if not any(c in p for p in self.table)]] = True
        for p in [*self.table]:
            for n in range(1, len(p)):
                self.table.setdefault(p[:n], -1)
        self._index()
        rank = np.argsort(np.argsort(-self.scores, kind="stable"), kind="stable")
        #: Log probabilities by Zipf's law on the rank of the vocabulary's own scores.
        normal = np.isfinite(self.scores)
        weight = np.where(normal, 1.0 / (rank + 2.0), 0.0)
        weight[[*self.byte_ids]] = 1.0 / (self.size + 2.0)
        with np.errstate(divide="ignore"):
            self.log_p = np.log(weight / weight.sum())

    def _index(self) -> None:
        """``table`` by hash: two direct-address tables, the second for what the first has no room for."""
        texts = [*self.table]
        ids = np.fromiter(self.table.values(), np.int64, len(texts))
        for seed in range(1, 100):
            self.seed = np.uint64(2 * seed + 1) * np.uint64(0x9E3779B97F4A7C15 % (1 << 63)) | np.uint64(1)
            keys = np.array([self._hash(t) for t in texts], np.uint64)
            self.first, self.second = np.zeros(1 << _SLOT_BITS, np.int32), np.zeros(1 << _SLOT_BITS, np.int32)
            rows = np.arange(1, len(texts) + 1, dtype=np.int32)  # row 0 is no entry
            self.first[keys >> _TOP] = rows
            left = np.flatnonzero(self.first[keys >> _TOP] != rows)
            self.second[(keys[left] >> _MID) & _LOW] = rows[left]
            if (self.second[(keys[left] >> _MID) & _LOW] == rows[left]).all() and len(np.unique(keys)) == len(keys):
                self.keys, self.ids = np.concatenate([np.zeros(1, np.uint64), keys]), np.concatenate([[NONE], ids])
                return
        raise ValueError("no seed parts the pieces' hashes")

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = ((h + ord(c) + 1) * int(self.seed)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes: -1 for what only starts a piece, ``NONE`` for what doesn't."""
        row = self.first[(h >> _TOP).view(np.int64)]
        miss = np.flatnonzero(self.keys[row] != h)
        other = self.second[((h[miss] >> _MID) & _LOW).view(np.int64)]
        row[miss] = np.where(self.keys[other] == h[miss], other, 0)
        return self.ids[row]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of texts (large strings, none null), each behind one leading space (the dummy prefix), one after the other, and
        how many each text has; none for an empty text."""
        count = np.zeros(len(texts), np.int64)
        some = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        if not len(some):
            return texts.slice(0, 0), count
        nothing, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        full = pc.binary_join_element_wise(nothing, texts.take(pa.array(some)), space)
        ends = np.frombuffer(full.buffers()[1], np.int64, len(some) + 1, full.offset * 8)
        data = np.frombuffer(full.buffers()[2], np.uint8, int(ends[-1]))  # places are bytes: all characters looked for are ASCII
        blank, starts = data == 32, self.alone[data]
        starts[1:] |= starts[:-1] | (blank[1:] & ~blank[:-1])
        starts[ends[:-1]] = True
        at = np.append(np.flatnonzero(starts), len(data))
        count[some] = np.diff(np.searchsorted(at, ends))
        return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), full.buffers()[2]]), count


_VOCABULARIES: dict[bytes, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """One for each worker process, as it takes half a second to build."""
    key = hashlib.sha256(model).digest()
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(model)
    return _VOCABULARIES[key]


class Edges:
    """Edges of the lattices of some units, sorted by level (code points before the edge's end) and end node.

    Node ``first[k] + j`` is place j + 1 of unit k; ``source`` -1 is a unit's start. ``piece`` is an id, or
    -1 - code point for a character that falls back to bytes.
    """

    def __init__(self, v: Vocabulary, units: list[str]):
        size = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.nodes, self.first = len(codes), np.cumsum(size) - size
        self.last = self.first + size - 1
        start = np.repeat(self.first, size)
        stop = start + np.repeat(size, size)
        at, h = np.arange(self.nodes), np.zeros(self.nodes, np.uint64)  # substrings that still start a piece
        froms, ends, pieces = [], [], []
        for n in range(1, v.longest + 1):
            with np.errstate(over="ignore"):
                h = (h + codes[at + n - 1]) * v.seed
            h ^= h >> np.uint64(29)
            found = v.look_up(h)
            if n == 1:
                c = codes.astype(np.int64) - 1
                alone = np.where(c < 128, np.array(v.byte_ids)[np.minimum(c, 127)], -1 - c)
                froms.append(at), ends.append(at), pieces.append(np.where(found >= 0, found, alone))
            else:
                hit = np.flatnonzero(found >= 0)
                froms.append(at[hit]), ends.append(at[hit] + n - 1), pieces.append(found[hit])
            go = np.flatnonzero((found != NONE) & (at + n < stop[at]))
            at, h = at[go], h[go]
            if not len(at):
                break
        begin, target = np.concatenate(froms), np.concatenate(ends)
        order = np.argsort(target, kind="stable")
        level = target[order] - start[begin[order]]
        narrow = level.astype(np.int16) if len(level) and level.max() < 32_000 else level  # 16 bits sort by radix
        order = order[np.argsort(narrow, kind="stable")]
        begin, self.target, self.piece = begin[order], target[order], np.concatenate(pieces)[order]
        self.level = self.target - start[begin]
        self.source = np.where(begin == start[begin], -1, begin - 1)

    def log_weights(self, log_p: np.ndarray, log_byte: np.ndarray) -> np.ndarray:
        """Row of ``log_p`` (pieces x measures) for each edge; a byte fallback counts ``log_byte`` for each UTF-8 byte."""
        points = -1 - self.piece
        n_bytes = 2 + (points >= 0x800) + (points >= 0x10000)
        return np.where((self.piece >= 0)[:, None], log_p[np.maximum(self.piece, 0)], n_bytes[:, None] * log_byte)

    def forward(self, w: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all segmentations up to each node (nodes + 1 rows; the last is the start, 0)."""
        a = np.full((self.nodes + 1, w.shape[1]), -np.inf)
        a[-1] = 0.0
        cuts = np.flatnonzero(np.diff(self.level, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(self.level)], strict=True):
            into = self.target[lo:hi]
            heads = np.flatnonzero(np.diff(into, prepend=-1))
            a[into[heads]] = np.logaddexp.reduceat(a[self.source[lo:hi]] + w[lo:hi], heads, axis=0)
        return a
