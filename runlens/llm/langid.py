"""Language ID: unigram piece models of each language, marginalised over all segmentations.

Piece probabilities of each language are learnt over a fixed public vocabulary from labelled texts (pieces of the
vocabulary's own encoder, counted, with additive smoothing). A text's score in a language is the sum over its words of
the log of the summed probability of all segmentations of the word, by the forward algorithm; words are kept between
batches up to a bound. The predicted language has the largest total; ``score`` is its share after a softmax with equal
priors. Texts are lower-cased and words are runs of letters.

Training may take a bounded sample of labelled rows: about ``sample`` of each of the ``languages`` most frequent labels, by
a hash of doc_id; with fewer rows all are taken, and labels beyond teach nothing, so what the driver holds is bounded by
labels times pieces. Scoring takes all rows and whole texts.

Edge cases: a text that is null or has no letter is ``und`` with score 0; with no labelled rows all are ``und``; ties go
to the language that sorts first; labels that are null teach nothing; an empty table gives an empty result; other columns
pass through, and one that is named like a result (in any case) is replaced, unless ``names`` gives the results other names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, letter_runs, read_bytes, slices, with_results
from .pieces import Edges, vocabulary

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
_CACHE_WORDS, _LEARN = 150_000, 8_000


def _counter(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 1 << 20):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = sp.encode(" ".join(letter_runs(text.lower())))
                if lang not in sums:
                    sums[lang] = np.zeros(sp.vocab_size(), np.int64)
                sums[lang] += np.bincount(np.array(ids, np.int64), minlength=sp.vocab_size())
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "piece", "n"])

    return run


def train(labelled: DataFrame, model_path: str = MODEL, sample: int = 5000, smoothing: float = 0.5, languages: int = 512) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (pieces x languages). ``labelled``: doc_id, text, lang. What reaches the driver
    is at most a count for each language and piece."""
    model = read_bytes(model_path)
    rows = labelled.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    frequent = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = {r.lang: min(1.0, sample / r.n) for r in frequent.collect()}
    if not share:
        return [], np.zeros((0, 0))
    draw = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.create_map(*[F.lit(x) for p in share.items() for x in p])[F.col("lang")]
    counts = rows.where(draw).mapInArrow(_counter(model), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    langs = sorted(share)
    import sentencepiece

    table = np.full((sentencepiece.SentencePieceProcessor(model_proto=model).vocab_size(), len(langs)), smoothing)
    found = counts.toPandas()
    np.add.at(table, (found["piece"].to_numpy(), found["lang"].map(langs.index).to_numpy().astype(int)), found["n"].to_numpy())
    return langs, np.log(table / table.sum(axis=0))


class Scorer:
    def __init__(self, model: bytes, log_p: np.ndarray):
        self.v, self.log_p = vocabulary(model), log_p
        self.log_byte = log_p[self.v.byte_ids].mean(axis=0)
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, log_p.shape[1]))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text in each language, and its number of words."""
        cut = [letter_runs(t.lower()) for t in texts]
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = [w for words in cut for w in words]
        new = set(flat) - self.known.keys()
        if len(self.known) + len(new) > _CACHE_WORDS:
            self.known, self.rows = {}, self.rows[:0]
            new = set(flat)
        if new:
            words = sorted(new)
            parts = [self.rows]
            for i in range(0, len(words), _LEARN):  # bounds the lattices in memory
                e = Edges(self.v, [" " + w for w in words[i : i + _LEARN]])
                parts.append(e.forward(e.log_weights(self.log_p, self.log_byte))[e.last])
            self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
            self.rows = np.concatenate(parts)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        out = np.zeros((len(texts), self.rows.shape[1]))
        full = np.flatnonzero(count)
        if len(full):
            out[full] = np.add.reduceat(self.rows[at], (np.cumsum(count) - count)[full], axis=0)
        return out, count


def _predictor(model: bytes, langs: list[str], log_p: np.ndarray, keep: list[str], names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model, log_p) if langs else None
        for batch in slices(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if s is None:
                best, top = ["und"] * len(texts), np.zeros(len(texts))
            else:
                totals, count = s.totals(texts)
                k = totals.argmax(axis=1)
                top = np.where(count > 0, 1.0 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                best = [langs[i] if n else "und" for i, n in zip(k.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(best, pa.string()), pa.array(top, pa.float64())], [*keep, *names])

    return run


def predict(docs: DataFrame, languages: list[str], log_p: np.ndarray, model_path: str = MODEL, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its score, called ``names``, to rows with ``text``."""
    model = read_bytes(model_path)
    return with_results(docs, lambda keep: _predictor(model, languages, log_p, keep, names), [(names[0], "string"), (names[1], "double")])
