"""Spelling variants: words one edit apart, each pointed at its most frequent neighbour.

Neighbourhoods are Bloom-guided. Each word of the vocabulary generates the words that one deletion or one replacement makes of
it and probes them, by polynomial hashes that change in one term, against blocked Bloom filters of the vocabulary, one shard
a word length. Only positives become strings, which an exact join with the vocabulary confirms or drops. Insertions need no
probes, as they are the other ends of deletions, and replacements are probed towards larger code points only; each confirmed
pair counts for both words.

The filters are broadcast; their size is bounded (``limit_mb``) whatever the vocabulary: a vocabulary too large for it costs
more false positives, not links. Numbers of links and longest words are not bounded.

Defined results: null words are left out; repeated words add their counts; an empty vocabulary gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import discard, mix64, stored

#: Words of this many code points and more share a shard.
_LONGEST = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _codes(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _by_length(words: list[str], cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index and code points (one row a word) of the words of each length, at most about ``cells`` code points at once."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
        n = int(size[part[0]])
        if not n:
            continue
        for lo in range(0, len(part), max(1, cells // n)):
            own = part[lo : lo + max(1, cells // n)]
            # code units of four bytes each
            yield own, np.frombuffer("".join(words[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP)]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        h, shard = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int32)
        for own, points in _by_length(words):
            with np.errstate(over="ignore"):
                h[own] = mix64((_codes(points) * _powers(points.shape[1])[:-1]).sum(1, dtype=np.uint64))
            shard[own] = min(points.shape[1], _LONGEST)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(shard)], names=["h", "shard"])


def edits(words: list[str], alphabet: np.ndarray, known: bloom.Bloom) -> Iterator[tuple[int, str]]:
    """Index of a word and one deletion or replacement (towards larger code points) of it that may be in ``known``."""
    of = _codes(alphabet)
    for own, points in _by_length(words):
        n = points.shape[1]
        shard, shorter = min(n, _LONGEST), min(n - 1, _LONGEST)
        code, power = _codes(points), _powers(n)
        with np.errstate(over="ignore"):
            terms = code * power[:-1]
            whole = terms.sum(1, dtype=np.uint64)
            before = np.cumsum(terms, 1, dtype=np.uint64) - terms
            # behind a deleted point all terms move down by one power
            closer = code * np.concatenate([power[:1], power[:-2]])
            behind = closer.sum(1, dtype=np.uint64)[:, None] - np.cumsum(closer, 1, dtype=np.uint64)
            for i in range(n):
                new = np.flatnonzero(points[:, i] != points[:, i - 1]) if i else np.arange(len(own))
                if n > 1:
                    for k in new[known.has(mix64(before[new, i] + behind[new, i]), shorter)]:
                        w = words[own[k]]
                        yield int(own[k]), w[:i] + w[i + 1 :]
                k, a = np.nonzero(alphabet[None, :] > points[:, i : i + 1])
                hit = known.has(mix64(whole[k] + (of[a] - code[k, i]) * power[i]), shard)
                for j, c in zip(k[hit], alphabet[a[hit]], strict=True):
                    w = words[own[j]]
                    yield int(own[j]), w[:i] + chr(c) + w[i + 1 :]


def vocabulary(words: DataFrame, least_chars: int = 1, least_n: int = 1) -> DataFrame:
    """word, n of the distinct values of the column ``word`` of at least ``least_chars`` code points."""
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def neighbours(vocab: DataFrame, bits_per_key: int = 16, limit_mb: int = 64) -> DataFrame:
    """word, n, near, near_n: every pair of words (unique, with counts ``n``) one edit apart, once for each of the two."""
    spark = vocab.sparkSession
    keys = vocab.select("word").mapInArrow(_hashed, "h long, shard int")
    counts = {r.shard: r.n for r in keys.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a length
    first, size = bloom.shards(counts, _LONGEST + 1, bits_per_key, limit_mb)
    points = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().select(F.ascii("c").alias("p"))
    alphabet = np.array(sorted(r.p for r in points.collect()), np.uint32)  # at most all of Unicode
    known = spark.sparkContext.broadcast(bloom.build(keys, first, size, shard=F.col("shard")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(word, n, near):
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(near, pa.string())], names=["word", "n", "near"])

        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple[str, int, str]] = []
            held = 0
            for i, near in edits(words, alphabet, known.value):
                out.append((words[i], n[i], near))
                held += len(near) + 50
                if held > 4 << 20:
                    yield block(*zip(*out, strict=True))
                    out, held = [], 0
            if out:
                yield block(*zip(*out, strict=True))

    probed = vocab.select("word", "n").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(probe, "word string, n long, near string")
    found = probed.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the pointers (unique word, form) followed to words without one, in doubling steps. Each step joins a
    pointer's end with a unique side, so a root that many words lead to is no hot task; chains must end."""
    up = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not up.where("moved").isEmpty():
        further = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        after = stored(up.join(further, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        discard(up)
        up = after
    return up.select("word", "root")


def variants(words: DataFrame, least_chars: int = 6, least_n: int = 5, ratio: int = 5, bits_per_key: int = 16, limit_mb: int = 64) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least ``least_chars`` code points that stands at least
    ``least_n`` times in the column ``word``. A word's form is its near word of the largest n (ties: the first in order of code
    points) if that n is at least ``ratio`` (over 1) times its own; its root is where the forms end, or itself."""
    vocab = stored(vocabulary(words, least_chars, least_n), "vocabulary")
    # the smallest of (-n, word) is the most frequent, the first in order of code points among equals
    best = neighbours(vocab, bits_per_key, limit_mb).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    all_ = vocab.join(best, "word", "left").withColumn("is_form", -F.col("best.minus") >= ratio * F.col("n"))
    table = stored(
        all_.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("best.near")).alias("form"), F.when(F.col("is_form"), -F.col("best.minus")).alias("form_n")), "forms"
    )
    discard(vocab)
    ends = roots(table.where("form IS NOT NULL"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
