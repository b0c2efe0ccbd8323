"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A segmentation of a text is drawn with probability proportional to the product of its pieces' probabilities to the
power ``alpha``. Forward sums are taken once for each distinct unit; then all units of a batch are walked backwards
together, a piece a step. The random number of a step is a hash of (seed, row key, unit's place, step), so a row's
segmentation depends on its key and text only, not on partitions, batches or lost executors.

Edge cases: null and empty texts give no pieces and decode to the empty text; a null key counts as 0; repeated rows get
equal segmentations; an empty table gives an empty result. Texts are taken whole; a unit without spaces of any length
is one lattice, walked a piece a step: a million characters without a space take about a minute and 300 MB. Extra columns
are ignored, or pass where rows keep them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, mix64, read_bytes, slices, with_results
from .pieces import Edges, piece_bytes, vocabulary

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
_CACHE_UNITS, _CACHE_EDGES, _SLICE, _LEARN = 60_000, 1_500_000, 1 << 20, 8_000


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) of 53 bits."""
    return (mix64(h) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Sampler:
    """Lattices of units, kept between batches up to a bound; beyond it the units met most often stay.

    A node goes by its first edge's place in ``cdf``, ``source`` and ``piece``. ``cdf`` sums the shares of a node's edges, so
    nothing of an edge depends on the units learnt with it.
    """

    def __init__(self, model: bytes, alpha: float):
        self.v, self.alpha = vocabulary(model), alpha
        self.log_p = (self.v.log_p * alpha)[:, None]
        self.log_byte = self.log_p[self.v.byte_ids[0]]
        self.known: dict[str, int] = {}  # unit -> its row in ``begin``, ``last`` and ``uses``
        self.begin, self.last, self.uses = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.cdf, self.source, self.piece = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32)

    def _lattices(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """``cdf``, ``source`` and ``piece`` of the edges of some units, and each unit's first edge and last node."""
        e = Edges(self.v, units)
        w = e.log_weights(self.log_p, self.log_byte)
        a = e.forward(w)
        p = np.exp(a[e.source] + w - a[e.target])[:, 0]
        order = np.argsort(e.target, kind="stable")
        cdf, source = p[order], e.source[order]
        size = np.bincount(e.target)  # every node has an edge, that of its single character
        heads = np.cumsum(size) - size
        for k in range(1, size.max()):
            at = heads[size > k] + k
            cdf[at] += cdf[at - 1]
        cdf = np.minimum(cdf, 1.0)
        cdf[heads + size - 1] = 1.0  # the last edge of a node takes what rounding leaves
        return cdf, np.where(source < 0, -1, heads[source]), e.piece[order], heads[e.first], heads[e.last]

    def learn(self, units: list[str]) -> None:
        found, base = [], len(self.cdf)
        for i in range(0, len(units), _LEARN):  # bounds the lattices in memory
            cdf, source, piece, begin, last = self._lattices(units[i : i + _LEARN])
            found.append((cdf, np.where(source < 0, -1, source + base).astype(np.int32), piece.astype(np.int32), begin + base, last + base))
            base += len(cdf)
        if found:
            held = self.cdf, self.source, self.piece, self.begin, self.last
            self.cdf, self.source, self.piece, self.begin, self.last = (np.concatenate([h, *f]) for h, f in zip(held, zip(*found, strict=True), strict=True))
            self.uses = np.concatenate([self.uses, np.zeros(len(units), np.int64)])
            self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))

    def forget(self) -> None:
        """Keeps the units met most often, up to half the bounds; their uses count half from then on."""
        size = np.diff(np.append(self.begin, len(self.cdf)))
        order = np.argsort(-self.uses, kind="stable")[: _CACHE_UNITS // 2]
        keep = np.zeros(len(size), bool)
        keep[order[np.cumsum(size[order]) <= _CACHE_EDGES // 2]] = True
        edges = np.flatnonzero(np.repeat(keep, size)) + self.begin[0]
        size = size[keep]
        moved = self.begin[keep] - (np.cumsum(size) - size)
        source = self.source[edges]
        self.cdf, self.piece = self.cdf[edges], self.piece[edges]
        self.source = np.where(source < 0, -1, source - np.repeat(moved, size)).astype(np.int32)
        self.begin, self.last, self.uses = self.begin[keep] - moved, self.last[keep] - moved, self.uses[keep] // 2
        self.known = {u: k for k, u in enumerate(compress(self.known, keep))}

    def encode(self, texts: pa.Array | list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after the other, and how many each has."""
        flat, count = self.v.cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        coded = flat.dictionary_encode()
        units, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self.learn([u for u in units if u not in self.known])
        row = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        self.uses[row] += np.bincount(index, minlength=len(row))
        owner = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            base = mix64(mix64(keys.astype(np.uint64) + np.uint64(seed))[owner] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        unit, edge, ids, steps = np.arange(len(flat)), self.last[row][index], [], np.zeros(len(flat), np.int64)
        occurrence = []
        step = 0
        while len(unit):
            with np.errstate(over="ignore"):
                u = _uniform(base + np.uint64(step + 1) * np.uint64(0xD1B54A32D192ED03))
            later = np.flatnonzero(u >= self.cdf[edge])
            while len(later):  # at most as often as a node has edges
                edge[later] += 1
                later = later[u[later] >= self.cdf[edge[later]]]
            ids.append(self.piece[edge])
            occurrence.append(unit)
            steps[unit] += 1
            edge = self.source[edge].astype(np.int64)
            go = np.flatnonzero(edge >= 0)
            unit, edge, base = unit[go], edge[go], base[go]
            step += 1
        out = np.empty(int(steps.sum()), np.int64)
        end = np.cumsum(steps)
        for k, (u, i) in enumerate(zip(occurrence, ids, strict=True)):
            out[end[u] - 1 - k] = i
        per_unit = np.repeat(owner, steps)
        if len(self.known) > _CACHE_UNITS or len(self.cdf) > _CACHE_EDGES:
            self.forget()
        return self._bytes(out, per_unit, len(count))

    def _bytes(self, ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Puts byte pieces for characters without a piece."""
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            raw = [chr(-1 - i).encode() for i in ids[odd].tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(r) for r in raw]
            start = (np.cumsum(times) - times)[odd]
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            at = np.concatenate([np.arange(s, s + len(r)) for s, r in zip(start.tolist(), raw, strict=True)])
            ids[at] = np.array(self.v.byte_ids)[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, np.bincount(owner, minlength=n)


_SAMPLERS: dict[tuple[bytes, float], Sampler] = {}


def _sampler(model: bytes, alpha: float) -> Sampler:
    """One for each worker process."""
    key = (hashlib.sha256(model).digest(), alpha)
    if key not in _SAMPLERS:
        _SAMPLERS[key] = Sampler(model, alpha)
    return _SAMPLERS[key]


class Decoder:
    """Bytes of all pieces one after the other."""

    def __init__(self, model: bytes):
        held = piece_bytes(model)
        self.flat = np.frombuffer(b"".join(held), np.uint8)
        self.length = np.fromiter(map(len, held), np.int64, len(held))
        self.start = np.cumsum(self.length) - self.length

    def texts(self, pieces: pa.ListArray) -> pa.Array:
        return _texts(pieces, self.flat, self.start, self.length)


def _encoded(s: Sampler, batch: pa.RecordBatch, seed: int) -> tuple[pa.Array, pa.ListArray]:
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    keys = pc.fill_null(batch.column("doc_id").cast(pa.int64(), safe=False), 0).to_numpy()
    ids, count = s.encode(texts, keys, seed)
    return texts, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _encoder(model: bytes, alpha: float, seed: int, names: list[str], result: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _sampler(model, alpha)
        for batch in slices(batches, "text", _SLICE):
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), _encoded(s, batch, seed)[1]], [*names, result])

    return run


def _decoder(model: bytes, pieces: str, names: list[str], result: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), d.texts(part.column(pieces))], [*names, result])

    return run


def _texts(pieces: pa.ListArray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Texts of piece rows: the pieces' bytes in order, without the space in front; a null row is an empty text."""
    count = np.nan_to_num(pa.compute.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    ids = pieces.flatten().to_numpy(zero_copy_only=False)
    at, n = start[ids], length[ids]
    heads = (np.cumsum(count) - count)[count > 0]
    at[heads] += 1
    n[heads] -= 1
    data = flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
    return pa.Array.from_buffers(pa.large_string(), len(count), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


def encode(docs: DataFrame, model_path: str = MODEL, alpha: float = 0.5, seed: int = 17, name: str = "pieces") -> DataFrame:
    """Adds ``name``, a sampled segmentation of each whole text, to rows with doc_id and text; a column of that name (in any
    case) is replaced."""
    model = read_bytes(model_path)
    return with_results(docs, lambda keep: _encoder(model, alpha, seed, keep, name), [(name, "array<int>")])


def decode(rows: DataFrame, model_path: str = MODEL, pieces: str = "pieces", name: str = "decoded") -> DataFrame:
    """Adds ``name``, the text of the column ``pieces``; a column of that name (in any case) is replaced."""
    model = read_bytes(model_path)
    return with_results(rows, lambda keep: _decoder(model, pieces, keep, name), [(name, "string")])


def _round_tripper(model: bytes, alpha: float, seed: int):
    """Encodes and decodes in one worker, so that neither texts nor decoded texts travel back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, d = _sampler(model, alpha), Decoder(model)
        for batch in slices(batches, "text", _SLICE):
            texts, pieces = _encoded(s, batch, seed)
            back = d.texts(pieces)
            columns = {
                "doc_id": batch.column("doc_id"),
                "pieces": pieces,
                "decoded_sha256": pa.array([hashlib.sha256(b.as_buffer()).hexdigest() for b in back], pa.string()),
                "lossless": pc.equal(texts, back.cast(pa.large_string())),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def round_trip(docs: DataFrame, model_path: str = MODEL, alpha: float = 0.5, seed: int = 17) -> DataFrame:
    """doc_id, pieces, n_pieces, pieces_sha256, decoded_sha256, lossless for each document: encoded, and decoded from the pieces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = rows.mapInArrow(_round_tripper(read_bytes(model_path), alpha, seed), "doc_id long, pieces array<int>, decoded_sha256 string, lossless boolean")
    return both.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(F.array_join("pieces", ","), 256).alias("pieces_sha256"), "decoded_sha256", "lossless")
