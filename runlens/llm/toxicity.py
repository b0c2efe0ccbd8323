"""Toxicity: embeddings of hashed character n-grams, averaged into a linear softmax and trained jointly in numpy.

A word is the mean of the vectors of its n-grams (with word-boundary marks) and of the word itself, all hashed into one
table, so an unseen misspelling shares most of its vectors with the word it comes from. A text is the mean of its
words, a word said n times weighing 1 + ln n, and a linear softmax over two classes gives the score. Table and softmax
are trained together by Adam with weight decay; n-grams of fewer than ``min_docs`` texts keep the zero vector.

Training takes a bounded sample of labelled rows: up to ``sample`` of each class, by a hash of doc_id. Their words and
counts are gathered and fitted in one task; a longer text comes in chunks of ``chunk`` words that share its weight, of which
``per_text``, evenly spaced, are taken, so that task never holds more than 2 * sample * per_text * chunk words (usual texts
of 300 words make 3 million). Scoring takes all rows and whole texts; only a bounded word cache is kept in a task.

Edge cases: a text that is null, empty or without words scores by the prior of class 1; with labels of one class only
(or none) every score is that class's share (0.5 without labels); repeated rows train repeatedly and score alike; an empty
table gives an empty result; other columns pass through, and one that is named like a result (in any case) is replaced,
unless ``names`` gives the results other names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import letter_runs, mix64, slices, with_results

_CACHE_WORDS = 150_000
_SCALE = 32.0
#: Weight of the zero words that each text is averaged with, so that a few words alone can't decide.
_ZERO_WORDS = 8.0


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 20
    dim: int = 4
    shortest: int = 3
    longest: int = 5


def words_of(text: str | None) -> list[str]:
    return letter_runs(text.lower()) if text else []


def subwords(words: list[str], s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words' n-grams one after the other, and how many each word has (one at least)."""
    marked = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(chars))  # characters from here to the word's end
    owner, keys = [np.arange(len(words))], []
    with np.errstate(over="ignore"):
        coded = mix64(chars + np.uint64(0x51ED2701))
        place = (np.arange(len(chars)) - np.repeat(start, size)).astype(np.uint64)
        keys.append(mix64(np.add.reduceat(mix64(coded + place * np.uint64(0x9E3779B97F4A7C15)), start)) if len(words) else np.empty(0, np.uint64))
        of = np.repeat(np.arange(len(words)), size)
        for n in range(s.shortest, s.longest + 1):
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + coded[at + k]
            owner.append(of[at])
            keys.append(mix64(h))
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return (keys[order] % np.uint64(s.buckets)).astype(np.int64), np.bincount(owner, minlength=len(words))


def _mean_rows(table: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[at], np.cumsum(count) - count, axis=0) / count[:, None].astype(table.dtype)


@dataclass
class Model:
    shape: Shape
    word_score: np.ndarray  # table @ (w1 - w0), a value for each bucket
    bias: float

    def logits(self, words: list[str]) -> np.ndarray:
        at, count = subwords(words, self.shape)
        return np.add.reduceat(self.word_score[at], np.cumsum(count) - count) / count if len(words) else np.empty(0)


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of non-empty words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        place = (np.arange(len(chars)) - np.repeat(start, size)).astype(np.uint64)
        return mix64(np.add.reduceat(mix64(chars + np.uint64(0x51ED2701) + place * np.uint64(0x9E3779B97F4A7C15)), start) + size.astype(np.uint64)) if len(words) else np.empty(0, np.uint64)


def _gather(batches: Iterator[pa.RecordBatch], chunk: int, per_text: int) -> Iterator[pa.RecordBatch]:
    """label, weight, word hashes and counts of each chunk of a text; words new to the task come along once, with a null label."""
    known: set[str] = set()
    for batch in slices(batches, "text", 2 << 20):
        out: list[tuple] = []
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            n = -(-len(words) // chunk)
            for i in (np.unique(np.linspace(0, n - 1, min(n, per_text)).astype(int)) * chunk).tolist() if n else ():
                part: dict[str, int] = {}
                for w in words[i : i + chunk]:
                    part[w] = part.get(w, 0) + 1
                new = [w for w in part if w not in known]
                known.update(new)
                out.append((label, min(1.0, max(chunk / len(words), 1 / per_text)), word_hashes([*part]).tobytes(), np.fromiter(part.values(), np.int32, len(part)).tobytes(), "\n".join(new)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _GATHERED, strict=True)] if out else [pa.array([], t) for t in _GATHERED], ["label", "weight", "hashes", "counts", "words"])


_GATHERED = (pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.string())


def train(docs: DataFrame, labels: DataFrame, sample: int = 5000, epochs: int = 8, shape: Shape = Shape(), seed: int = 7, chunk: int = 4096, per_text: int = 8) -> Model:
    """``docs``: doc_id, text. ``labels``: doc_id, label (0 or 1). Takes at most ``sample`` labels of each class, those of the
    smallest hashes of doc_id; these few rows are broadcast to the texts."""
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    drawn = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picked = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn[0].unionAll(drawn[1])), "doc_id")
    gathered = picked.mapInArrow(lambda b: _gather(b, chunk, per_text), "label int, weight double, hashes binary, counts binary, words string")
    found = gathered.repartition(1).mapInArrow(_fitter(epochs, shape, seed), "scores binary, bias double").first()
    return Model(shape, np.frombuffer(found.scores, np.float32), found.bias)


def _fitter(epochs: int, shape: Shape, seed: int):
    """Fits the bounded sample in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, vocabulary = [], set()
        for batch in batches:
            vocabulary.update(w for ws in batch.column("words").to_pylist() for w in ws.split("\n") if w)
            for label, weight, h, c in zip(*(batch.column(c).to_pylist() for c in ("label", "weight", "hashes", "counts")), strict=True):
                rows.append((label, weight, np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32)))
        m = fit_table(rows, sorted(vocabulary), epochs, shape, seed)
        yield pa.RecordBatch.from_arrays([pa.array([m.word_score.astype(np.float32).tobytes()], pa.binary()), pa.array([float(m.bias)])], ["scores", "bias"])

    return run


def fit_table(rows: list[tuple], vocabulary: list[str], epochs: int = 8, shape: Shape = Shape(), seed: int = 7, min_docs: int = 10, rate: float = 0.02, decay: float = 1.5, eps: float = 1e-8, steps: int = 400, balance: float = 0.5) -> Model:
    """``rows``: label, weight, hashes of the distinct words, their counts. The order of rows has no effect. Few rows are
    gone through more often than ``epochs``, for ``steps`` updates in all."""
    rows = sorted(rows, key=lambda r: (int(r[0]), len(r[2]), r[2].tobytes()))
    y, weight = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y[0]) if len(y) else 0.5
        return Model(shape, np.zeros(shape.buckets), float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -7, 7)))
    epochs = max(epochs, -(-steps * 128 // len(y)))
    rare = y == int(y.mean() < 0.5)
    weight[rare] *= ((~rare).sum() / rare.sum()) ** balance
    parts = [subwords(vocabulary[i : i + 20_000], shape) for i in range(0, len(vocabulary), 20_000)]
    buckets, count = np.concatenate([p[0].astype(np.int32) for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    starts = np.cumsum(count) - count
    held = np.unique(buckets)  # only rows of the table that the sample touches are trained
    at = np.searchsorted(held, buckets).astype(np.int32)
    del buckets
    hashes = word_hashes(vocabulary)
    order = np.argsort(hashes)
    docs = [(order[np.searchsorted(hashes, r[2], sorter=order)], 1 + np.log(r[3].astype(np.float32))) for r in rows]
    frequent = np.zeros(len(held), np.int64)
    for words, _ in docs:
        lens = count[words]
        frequent += np.bincount(np.unique(at[np.repeat(starts[words], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)]), minlength=len(held)) > 0
    # n-grams of too few texts keep a zero vector; the others move up to stand together
    used = frequent >= min_docs
    row = np.where(used, np.cumsum(used) - 1, used.sum()).astype(np.int32)
    values, bias = _fit(docs, y, weight, row[at], count, starts, int(used.sum()), shape, epochs, seed, rate, decay, eps)
    table = np.zeros(shape.buckets)
    table[held[used]] = values
    return Model(shape, table, bias)


def _fit(docs, y, weight, at, count, starts, n_rows: int, shape: Shape, epochs: int, seed: int, rate0: float, decay: float, eps: float) -> tuple[np.ndarray, float]:
    """Row n_rows of the table is the zero vector of n-grams that are not used."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (n_rows + 1, shape.dim)).astype(np.float32)
    emb[-1] = 0
    lin = rng.normal(0, 0.3, (shape.dim, 2)).astype(np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, lin, bias)]
    weight = weight / weight.mean()
    t, size = 0, 128
    total = epochs * -(-len(y) // size)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), size):
            pick = order[lo : lo + size]
            words = np.concatenate([docs[i][0] for i in pick])
            times = np.concatenate([docs[i][1] for i in pick])
            n = np.array([len(docs[i][0]) for i in pick])
            first = np.cumsum(n) - n
            share = times / np.repeat(np.add.reduceat(times, first) + _ZERO_WORDS, n) * _SCALE
            uniq, back = np.unique(words, return_inverse=True)
            lens = count[uniq]
            grams = at[np.repeat(starts[uniq], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)]
            vectors = _mean_rows(emb, grams, lens)
            x = np.add.reduceat(vectors[back] * share[:, None], first, axis=0)
            z = x @ lin + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            g = p * (weight[pick] / len(pick))[:, None]
            gx = g @ lin.T
            per_word = np.stack([np.bincount(back, np.repeat(gx[:, d], n) * share, len(uniq)) for d in range(shape.dim)], axis=1) / lens[:, None]
            ge = np.stack([np.bincount(grams, np.repeat(per_word[:, d], lens), n_rows + 1) for d in range(shape.dim)], axis=1)
            ge[-1] = 0
            t += 1
            rate = rate0 * (1 - 0.9 * t / total)
            for param, grad, (m, v) in zip((emb, lin, bias), (ge, x.T @ g, g.sum(axis=0)), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + eps)).astype(np.float32)
            emb *= 1 - rate * decay
    return (emb[:-1] @ (lin[:, 1] - lin[:, 0])).astype(np.float64) * _SCALE, float(bias[1] - bias[0])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known, self.values = model, {}, np.empty(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        cut = [words_of(t) for t in texts]
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = [w for words in cut for w in words]
        new = set(flat) - self.known.keys()
        if len(self.known) + len(new) > _CACHE_WORDS:
            self.known, self.values = {}, self.values[:0]
            new = set(flat)
        if new:
            words = sorted(new)
            self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
            parts = [self.model.logits(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]  # bounds the n-grams in memory
            self.values = np.concatenate([self.values, *parts])
        z = np.full(len(texts), self.model.bias)
        if flat:
            at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
            pair, times = np.unique(np.repeat(np.arange(len(texts)), count) * (len(self.values) + 1) + at, return_counts=True)
            owner, word, w = pair // (len(self.values) + 1), pair % (len(self.values) + 1), 1 + np.log(times)
            z += np.bincount(owner, w * self.values[word], len(texts)) / (np.bincount(owner, w, len(texts)) + _ZERO_WORDS)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _predictor(model: Model, keep: list[str], names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for batch in slices(batches, "text", 2 << 20):
            score = s.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, *names])

    return run


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the score and the predicted label, called ``names``, to rows with ``text``."""
    return with_results(docs, lambda keep: _predictor(model, keep, names), [(names[0], "double"), (names[1], "int")])
