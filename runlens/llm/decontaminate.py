"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all items.

Texts and items are normalised alike: A-Z lower-cased, words are runs of ASCII letters and digits and non-ASCII
characters. Every window of ``width`` consecutive item words (the whole item, if it is shorter) is a pattern
`` w1 w2 ... `` with single spaces around words, so a match is always on word boundaries. Each text is scanned once and
the matches are mapped back to words and then to code points of the original text.

Normalised texts are scanned as bytes in Latin-1 form: one character a byte. The windows are a table (each with the items
that hold it), whose bytes are added up first: one automaton takes about ``max_bytes`` of patterns and item names, and a
larger benchmark is dealt by window into several. Then every automaton scans the texts by itself and gives only the runs it
hits; runs of a text meet by a shuffle of these, and no text is written or shuffled for them. So what the driver and a task
hold is bounded by ``max_bytes`` whatever the benchmark's size, and a single long item is dealt like any other.

Edge cases: null and empty texts have no words and are clean; null items and items without words have no windows; windows
of items with a null item_id count as hits, but the item has no name to be listed by; items that repeat an item_id are
listed once; ties do not arise; repeated rows each get their row; an empty benchmark leaves all texts clean; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, slices, stored, with_results

#: ASCII letters in lower case, digits and all bytes of non-ASCII characters are kept, the rest are spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


#: The words of ``words_of`` as a pattern for Spark's functions.
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """pattern, n (its words), items (sorted names of the items that hold it): each window once."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(low, F.lit(_WORDS), F.lit(0)).alias("w")).where("size(w) > 0")
    each = words.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))), lambda i: F.slice("w", i, width))).alias("p"))
    return each.groupBy(F.array_join("p", " ").alias("pattern"), F.size("p").alias("n")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def automaton(patterns: list[tuple[str, int, list[str]]]):
    """Aho-Corasick over patterns; each carries its length in words and the items that hold it. None without patterns."""
    import ahocorasick

    if not patterns:
        return None
    found = ahocorasick.Automaton()
    for p, n, items in patterns:
        found.add_word(f" {p} ".encode().decode("latin-1"), (n, tuple(items)))
    found.make_automaton()
    return found


_MACHINE: list = [None, None]


def _machine(digest: str, patterns: list[tuple[str, int, list[str]]]):
    """The last automaton of this worker process, built anew for other patterns."""
    if _MACHINE[0] != digest:
        _MACHINE[:] = [None, None]
        _MACHINE[:] = [digest, automaton(patterns)]
    return _MACHINE[1]


def scan(text: str | None, machine, spans: bool = True) -> tuple[int, set[str], list[tuple[int, int, int, int]]]:
    """Words of one text, items with occurring windows, and the runs of hit words: first and last word, start and end code
    points (0 without ``spans``)."""
    words = words_of(text)
    if not words or machine is None:
        return len(words), set(), []
    flat = b" " + b" ".join(words) + b" "
    items: set[str] = set()
    ends, sizes = [], []
    for end, (n, who) in machine.iter(flat.decode("latin-1")):
        ends.append(end)
        sizes.append(n)
        items.update(who)
    if not ends:
        return len(words), items, []
    after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # place of the space behind each word
    last = np.searchsorted(after, np.array(ends))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - np.array(sizes) + 1, 1)
    np.add.at(change, last + 1, -1)
    hit = np.cumsum(change[:-1]) > 0
    runs = np.diff(hit.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
    places = _spans(text, first, last) if spans else [(0, 0)] * len(first)
    return len(words), items, [(a, b, *p) for a, b, p in zip(first.tolist(), last.tolist(), places, strict=True)]


def _spans(text: str, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words as code points of the original text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kept = np.frombuffer(_TABLE, np.uint8)[raw] != 32
    edge = np.diff(kept.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    return list(zip(points[starts[first]].tolist(), points[stops[last]].tolist(), strict=True))


def merged(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of several automata over one text as runs of one: those that overlap or meet are one run."""
    out: list[list[int]] = []
    for a, b, start, end in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1], out[-1][3] = max(out[-1][1], b), max(out[-1][3], end)
        else:
            out.append([a, b, start, end])
    return [tuple(r) for r in out]


_RUN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _scanner(digest: str, patterns: list[tuple[str, int, list[str]]]):
    """Whole findings of one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(digest, patterns)
        for batch in slices(batches, "text"):
            rows = [scan(t, machine) for t in batch.column("text").to_pylist()]
            yield _findings(batch.column("doc_id"), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])

    return run


def _findings(ids: pa.Array, n_words: list, items: list, runs: list) -> pa.RecordBatch:
    columns = {
        "doc_id": ids,
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array([sum(b - a + 1 for a, b, _, _ in r) for r in runs], pa.int64()),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        "spans": pa.array([[{"start": a, "end": b} for _, _, a, b in r] for r in runs], pa.list_(_SPAN)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _hitter(digest: str, patterns: list[tuple[str, int, list[str]]], spans: bool):
    """Only texts that one of several automata hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(digest, patterns)
        for batch in slices(batches, "text"):
            rows = [scan(t, machine, spans) for t in batch.column("text").to_pylist()]
            at = [i for i, r in enumerate(rows) if r[2]]
            runs = [[dict(zip(("first", "last", "start", "end"), x, strict=True)) for x in rows[i][2]] for i in at]
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("digest"), pa.array([sorted(rows[i][1]) for i in at], pa.list_(pa.string())), pa.array(runs, pa.list_(_RUN))], ["doc_id", "digest", "items", "runs"])

    return run


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [merged([tuple(x.values()) for part in parts or () for x in part]) for parts in batch.column("runs").to_pylist()]
        items = [{x for part in parts or () for x in part} for parts in batch.column("items").to_pylist()]
        yield _findings(batch.column("doc_id"), batch.column("n_words").to_pylist(), items, runs)


class Shards:
    """The benchmark's windows in parts of about ``max_bytes``, which the driver holds one at a time."""

    def __init__(self, benchmark: DataFrame, width: int, max_bytes: int):
        table = windows(benchmark, width)
        size = F.octet_length("pattern") + F.coalesce(F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x)), F.lit(0))
        total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        self.n = max(1, -(-total // max_bytes))
        self.table = table if self.n == 1 else stored(table.withColumn("shard", F.pmod(F.xxhash64("pattern"), F.lit(self.n))), "windows")

    def __iter__(self) -> Iterator[tuple[str, list[tuple[str, int, list[str]]]]]:
        for k in range(self.n):
            part = self.table if self.n == 1 else self.table.where(F.col("shard") == k)
            rows = sorted((r.pattern, r.n, list(r["items"])) for r in part.collect())
            yield hashlib.sha256(repr(rows).encode("utf-8", "surrogatepass")).hexdigest(), rows


def _hits(rows: DataFrame, shards: Shards, spans: bool) -> DataFrame:
    """doc_id, digest, items, runs of the texts that any automaton hits, a row for each automaton, as a stored table."""
    out = None
    for digest, patterns in shards:
        part = rows.mapInArrow(_hitter(digest, patterns, spans), "doc_id long, digest long, items array<string>, runs array<struct<first:int,last:int,start:int,end:int>>")
        part = stored(part.distinct(), "hits")
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, items (sorted strings), spans of hit runs in the text.

    ``docs``: doc_id, text. ``benchmark``: item_id, text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    shards = Shards(benchmark, width, max_bytes)
    if shards.n == 1:
        return rows.mapInArrow(_scanner(*next(iter(shards))), SCHEMA)
    keyed = rows.withColumn("digest", F.xxhash64("text"))
    found = _hits(keyed, shards, True).groupBy("doc_id", "digest").agg(F.collect_set("items").alias("items"), F.collect_set("runs").alias("runs"))
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = keyed.select("doc_id", "digest", F.regexp_count(low, F.lit(_WORDS)).cast("long").alias("n_words"))
    same = counted["doc_id"].eqNullSafe(found["doc_id"]) & (counted["digest"] == found["digest"])
    return counted.join(found, same, "left").select(counted["doc_id"], "n_words", "items", "runs").mapInArrow(_joiner, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns; with one automaton nothing is shuffled."""
    shards = Shards(benchmark, width, max_bytes)
    if shards.n == 1:
        part = next(iter(shards))
        return with_results(docs, lambda _: _filter(*part), [])
    (hit,) = free_names(docs, "_hit")
    digest = F.xxhash64(F.col("text"))
    hits = _hits(docs.select(F.lit(0).cast("long").alias("doc_id"), digest.alias("digest"), "text"), shards, False).select(F.col("digest").alias(hit)).distinct()
    return docs.join(hits, digest == F.col(hit), "left_anti")


def _filter(digest: str, patterns: list[tuple[str, int, list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(digest, patterns)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([not scan(t, machine, spans=False)[2] for t in batch.column("text").to_pylist()], pa.bool_()))

    return run
