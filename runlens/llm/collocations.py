"""Collocations: phrases whose words stand together more often than their parts let expect, by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\n\\v\\f\\r]`` and those into words at blanks and tabs. Every n-gram
inside a piece gets a 64-bit fingerprint from prefix polynomials over its words' codes, and a second one of 31 bits from another
polynomial. Each block of texts adds up its fingerprints before Spark shuffles (fingerprint, count, least and greatest second
fingerprint, pointer to a document). n-grams of three words and more are hashed only where both of their shorter parts may be
frequent, as a Bloom filter of bounded size tells. Only frequent fingerprints become text: pointers are joined with the documents and the
phrase is cut out there. Where second fingerprints of one fingerprint differ, phrases have collided: these are told apart and
counted again by their text, in another scan.

Defined results: null texts have no words; a null language is ``und``; repeated rows count again; an empty table gives an empty
table; other columns of the documents are not read. Texts of any length are taken whole, in blocks cut between pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import discard, mix64, slices, stored

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_RNG = np.random.default_rng(20240613)
_PRIME = np.uint64((1 << 31) - 1)
_CODE = (_RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(1, (1 << 31) - 1, 256, np.uint64))
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEED = 0x0C01
_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int, prime: int = 0) -> np.ndarray:
    """Powers of ``base`` by 2^64, or by ``prime``."""
    have = _tables.get((base, prime))
    if have is None or len(have) < n:
        n = max(2 * n, 1024)
        if prime:
            out = [1]
            for _ in range(n - 1):
                out.append(out[-1] * base % prime)
            have = np.array(out, np.uint64)
        else:
            with np.errstate(over="ignore"):
                have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base % (1 << 64), np.uint64)]))
        _tables[base, prime] = have
    return have[:n]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Lower-cased bytes, bounds of the texts in them, and the rows; a text above ``limit`` comes in parts cut between pieces."""
    for batch in slices(batches, "text", limit):
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        data, bounds = _LOW[data], bounds - bounds[0]
        if len(data) <= limit or len(texts) > 1:
            yield data, bounds, batch
            continue
        breaks, start = np.flatnonzero(_KIND[data] == _BREAK) + 1, 0
        while start < len(data):
            k = int(np.searchsorted(breaks, start + limit, "right"))
            end = next((int(b) for b in (*breaks[max(k - 1, 0) : k], *breaks[k : k + 1]) if b > start), len(data)) if len(data) - start > limit else len(data)
            yield data[start:end], np.array([0, end - start]), batch
            start = end


class _Grams:
    """The words of a block and the fingerprints of its n-grams. Two languages' equal phrases differ in fingerprint."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, batch: pa.RecordBatch, bits: int):
        self.data, self.mask = data, np.uint64(((1 << bits) - 1) << (64 - bits))
        self.lang = [batch.column(c).to_numpy().view(np.uint64) for c in ("lang1", "lang2")]
        self.rows = batch.column("row").to_numpy()
        kind = _KIND[data]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            heads = bounds[:-1][bounds[:-1] < len(data)]
            first[heads] = inside[heads]
            last[heads[heads > 0] - 1] = inside[heads[heads > 0] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(bounds, self.start, "right") - 1
        self.piece = np.cumsum(kind == _BREAK)[self.start] + self.text
        size, at = self.end - self.start, np.flatnonzero(inside)
        head = np.cumsum(size) - size
        place = np.arange(len(at), dtype=np.int32) - np.repeat(head.astype(np.int32), size)
        longest = int(size.max(initial=0)) + 1
        n = len(self.start)
        with np.errstate(over="ignore"):
            if n:
                one = np.add.reduceat(_CODE[0][data[at]] * _powers(_BASE[0], longest)[place], head)
                two = np.add.reduceat(_CODE[1][data[at]] * _powers(48271, longest, int(_PRIME))[place] % _PRIME, head) % _PRIME
            else:
                one = two = np.zeros(0, np.uint64)
            codes = mix64(one + size.astype(np.uint64)), mix64(two * np.uint64(_BASE[1]) + size.astype(np.uint64))
            self.prefix = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * _powers(b, n + 1)[:n])]) for c, b in zip(codes, _BASE, strict=True)]

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, fingerprint and second fingerprint of each n-gram."""
        i = np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]) if len(self.piece) >= n else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            one, two = ((p[i + n] - p[i]) * _powers(pow(b, -1, 1 << 64), len(self.piece) + 1)[i] + self.lang[k][self.text[i]] + np.uint64(n) for k, (p, b) in enumerate(zip(self.prefix, _BASE, strict=True)))
            return i, mix64(one) & self.mask, (mix64(two) >> np.uint64(33)).astype(np.int32)

    def none(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text's fingerprint of the empty phrase, which stands for its language, and its number of words."""
        return mix64(self.lang[0].copy()) & self.mask, np.bincount(self.text, minlength=len(self.rows))

    def phrase(self, i: int, n: int) -> str:
        return b" ".join(self.data[self.start[j] : self.end[j]].tobytes() for j in range(i, i + n)).decode("utf-8", "replace")


_COUNTED = "fp long, n long, lo int, hi int, row long"


def _counter(sizes: tuple[int, ...], known, bits: int, limit: int):
    """Fingerprints of n-grams of ``sizes`` (0: the empty phrase), added up block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds, batch in _blocks(batches, limit):
            grams = _Grams(data, bounds, batch, bits)
            parts = []
            for n in sizes:
                if n == 0:
                    fp, count = grams.none()
                    parts.append((fp, count, np.zeros(len(fp), np.int32), grams.rows))
                    continue
                i, fp, second = grams.of(n)
                if known is not None:
                    j, shorter, _ = grams.of(n - 1)
                    may = np.zeros(len(grams.piece) + 1, bool)
                    may[j[known.value.has(shorter)]] = True
                    stay = may[i] & may[i + 1]
                    i, fp, second = i[stay], fp[stay], second[stay]
                parts.append((fp, np.ones(len(fp), np.int64), second, grams.rows[grams.text[i]]))
            fp, count, second, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(fp):
                continue
            del grams, parts, data
            order = np.argsort(fp)
            fp = fp[order]
            head = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            second = second[order]
            out = fp[head].view(np.int64), np.add.reduceat(count[order], head), np.minimum.reduceat(second, head), np.maximum.reduceat(second, head), np.minimum.reduceat(row[order], head)
            for lo in range(0, len(head), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in out], names=["fp", "n", "lo", "hi", "row"])

    return run


def _cutter(longest: int, bits: int, limit: int):
    """The phrases behind the fingerprints that point to a document (column ``wanted``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds, batch in _blocks(batches, limit):
            flat = pc.list_flatten(batch.column("wanted"))
            wanted, at = np.unique(flat.field("fp").to_numpy().view(np.uint64), return_index=True)
            second = flat.field("lo").to_numpy()[at]
            grams = _Grams(data, bounds, batch, bits)
            langs = batch.column("lang")
            found = []
            for n in range(longest + 1):
                i, fp, two = (np.arange(len(grams.rows)), grams.none()[0], 0) if n == 0 else grams.of(n)
                k = np.minimum(np.searchsorted(wanted, fp), len(wanted) - 1)
                at = np.flatnonzero((wanted[k] == fp) & (second[k] == two))
                _, once = np.unique(fp[at], return_index=True) if len(at) else ([], [])
                found += [(int(fp[k]), langs[int(i[k] if n == 0 else grams.text[i[k]])].as_py(), n, grams.phrase(int(i[k]), n)) for k in np.asarray(at)[once]]
            for lo in range(0, len(found), 1 << 14):
                fp, lang, n, phrase = zip(*found[lo : lo + (1 << 14)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(phrase, pa.string())], names=["fp", "lang", "words", "phrase"])

    return run


def _recounter(longest: int, known, bits: int, limit: int):
    """The phrases of n-grams whose fingerprint may be in ``known``, counted block by block by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds, batch in _blocks(batches, limit):
            grams = _Grams(data, bounds, batch, bits)
            langs = batch.column("lang").to_pylist()
            counts: dict[tuple, int] = {}
            fp, words = grams.none()
            for k in np.flatnonzero(known.value.has(fp)):
                at = int(fp[k]), langs[k], 0, ""
                counts[at] = counts.get(at, 0) + int(words[k])
            for n in range(1, longest + 1):
                i, fp, _ = grams.of(n)
                for k in np.flatnonzero(known.value.has(fp)):
                    at = int(fp[k]), langs[grams.text[i[k]]], n, grams.phrase(int(i[k]), n)
                    counts[at] = counts.get(at, 0) + 1
            if counts:
                fp, lang, n, phrase = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(phrase, pa.string()), pa.array(counts.values(), pa.int64())], names=["fp", "lang", "words", "phrase", "f"])

    return run


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, bits: int = 64, filter_mb: int = 64, block_bytes: int = 1 << 20) -> DataFrame:
    """lang, words (how many), phrase, f of every phrase of at most ``longest`` words that stands at least ``least`` times in
    texts (``text``) of a language (``lang``); the empty phrase stands for each word of the language. ``bits``: of the
    fingerprint, fewer for tests of collisions."""
    spark = docs.sparkSession
    lang = F.coalesce("lang", F.lit("und"))
    row = F.xxhash64(*[c for c in ("doc_id", "text", "lang") if c in docs.columns])
    own = docs.select("text", lang.alias("lang"), F.xxhash64(lang).alias("lang1"), F.xxhash64(lang, F.lit(_SEED)).alias("lang2"), row.alias("row"))

    def frequent(sizes: tuple[int, ...], known=None) -> DataFrame:
        counted = own.drop("lang").mapInArrow(_counter(sizes, known, bits, block_bytes), _COUNTED)
        added = counted.groupBy("fp").agg(F.sum("n").alias("f"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("row").alias("row"))
        return stored(added.where(F.col("f") >= least).select("fp", "f", "lo", "row", (F.col("lo") != F.col("hi")).alias("collided")), "fingerprints")

    def filter_of(df: DataFrame) -> object:
        first, size = bloom.shards({0: df.count()}, 1, 16, filter_mb)
        return spark.sparkContext.broadcast(bloom.build(df.select(F.col("fp").alias("h")), first, size))

    parts = [frequent(tuple(range(min(longest, 2) + 1)))]
    for n in range(3, longest + 1):
        parts.append(frequent((n,), filter_of(parts[-1])))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionAll(more)
    if len(parts) > 1:  # phrases of different lengths may collide too
        found = stored(found.groupBy("fp").agg(*[F.min(c).alias(c) for c in ("f", "lo", "row")], (F.bool_or("collided") | (F.count("*") > 1)).alias("collided")), "fingerprints")
        parts.append(found)
    wanted = found.where("NOT collided").groupBy("row").agg(F.collect_list(F.struct("fp", "lo")).alias("wanted"))
    cut = own.join(wanted.hint("merge"), "row").mapInArrow(_cutter(longest, bits, block_bytes), "fp long, lang string, words int, phrase string")
    cut = cut.join(found.where("NOT collided").select("fp", "f").hint("merge"), "fp").groupBy("fp").agg(*[F.min(c).alias(c) for c in ("lang", "words", "phrase", "f")])
    out = stored(cut.select("lang", "words", "phrase", "f"), "phrases")
    collided = found.where("collided").select("fp")
    if not collided.isEmpty():
        again = own.mapInArrow(_recounter(longest, filter_of(collided), bits, block_bytes), "fp long, lang string, words int, phrase string, f long")
        again = again.join(collided.hint("merge"), "fp", "left_semi").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
        out, rest = stored(out.unionAll(again.where(F.col("f") >= least)), "phrases"), out
        discard(rest)
    discard(*parts)
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int | None = 2000, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words that stand at least
    ``least`` times (a) by score descending, a descending, phrase. Cut after its first k words a phrase has parts that stand l
    and r times, and the score floor(1000000 a a / (l r)); its lowest-scoring cut counts, of equals the first. A phrase inside a
    longer one that stands in at least ``share`` percent of its places is left out. n: words of the language."""
    found = phrases(docs, longest, least, **how)
    words = F.split("phrase", " ")
    whole = found.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"))
    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " ").alias("right"))
    part = found.where("words >= 1")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")).hint("merge"), ["lang", "left"]).join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")).hint("merge"), ["lang", "right"])
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("cut").alias("cut"))
    inner = whole.where("words >= 3").select("lang", "a", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("phrase"))
    outer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(outer.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
