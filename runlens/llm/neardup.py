"""Near duplicates: improved consistent weighted sampling over TF-IDF word shingles, banded, verified by weighted Jaccard.

1. Document frequencies of all shingles are counted in one hashed table of ``2**bits`` cells. A cell also counts the
   shingles that collide with it: about (shingles a document / cells) of all documents, whatever the corpus size, so
   the weights mean the same at every size and the table's memory is fixed.
2. A shingle weighs tf * (1 + idf_share * ln((1 + N) / (1 + df)) / ln(1 + N)). The idf part is bounded on purpose: with
   plain idf the few edited shingles of a near copy outweigh what a very large group of copies shares, and the group's
   true links fall below the threshold.
3. For each of bands * rows hash functions the sample of a text is the shingle and quantised weight with the least
   ln a = ln c - r (floor(ln w / r + beta) - beta) - r, where r and c are Gamma(2, 1) and beta uniform, all by
   hash of the shingle. That least value itself serves as the sample's fingerprint.
4. Texts of equal word sequences are one node (the smallest doc_id). Nodes that share a band's samples meet in a bucket.
   Nodes are tested against hubs first: each against the smallest node of all its buckets, which joins most of a group at
   once; then against the smallest and largest node of each of its buckets that is of another component. What is left are
   buckets that hold several components, and there every pair of nodes of different components is settled exactly. In
   buckets of up to ``wide`` nodes the pairs are listed and tested. Larger ones are dealt into blocks of about ``block``
   shingles, and each two blocks (but two of the bucket's largest component alone) meet in a group: there pairs without a
   common shingle among the rarest ones, which weigh 1 - threshold of a text, can't reach the threshold and are passed
   over, as are pairs joined meanwhile or met in the group of an earlier band. Tests are weighted Jaccard on the whole
   texts. No pair of a bucket is left out at any size; the price is that a crowd of n blocks of like texts in a bucket that
   are no near duplicates is read n times.
5. Components of the verified links are the classes. All counts, links and labels stay in tables.

Edge cases: a text that is null, empty or without words is similar to nothing and a class by itself; a text of fewer
words than a shingle is one shingle; ties go to the smaller doc_id; repeated rows are one node and each gets its row;
rows with a null doc_id keep their row with a null class; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_names, mix64, slices, stored
from .components import components
from .shingles import sequence_digest, shingles, words


@dataclass(frozen=True)
class Options:
    width: int = 5
    threshold: float = 0.8
    bands: int = 12
    rows: int = 4
    bits: int = 18
    idf_share: float = 0.25
    wide: int = 16
    #: Shingles of a block's texts; a task holds two blocks at a time.
    block: int = 1 << 18
    #: Nodes tested against one copy of a hub's text in a task.
    salted: int = 500


_SLICE = 2 << 20
_BLOCK = 4096
#: Tasks whose counts are added up in one group.
_TASKS = 1000
_R = np.random.default_rng(5)
#: Tables of the distributions, small enough for a core's cache: 12 bits of a hash pick r, 12 c and 12 beta.
_GAMMA_R, _LN_C, _BETA = _R.gamma(2, 1, 1 << 12), np.log(_R.gamma(2, 1, 1 << 12)), _R.random(1 << 12)
_INVERSE_R = 1.0 / _GAMMA_R
_CHUNK = 1 << 15
_MULTIPLIERS = _R.integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)


def _counter(o: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(1 << o.bits, np.int64), 0
        for batch in slices(batches, "text", _SLICE):
            doc, word = words(batch.column("text"))
            who, h, _ = shingles(doc, word, o.width)
            cell = (h >> np.uint64(64 - o.bits)).astype(np.int64)
            order = np.lexsort((cell, who))
            new = (np.diff(who[order], prepend=-1) != 0) | (np.diff(cell[order], prepend=-1) != 0)
            cells += np.bincount(cell[order][new], minlength=len(cells))
            n += batch.num_rows
        if n:
            salt = TaskContext.get().partitionId() // _TASKS
            rows = [(k, cells[k * _BLOCK : (k + 1) * _BLOCK].astype("<i8").tobytes()) for k in range(len(cells) // _BLOCK)] + [(-1, np.array([n], "<i8").tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "salt", "counts"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["counts"].iloc[0]) // 8, "<i8")
    for c in pdf["counts"]:
        total += np.frombuffer(c, "<i8")
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "counts": [total.tobytes()]})


def document_frequencies(docs: DataFrame, o: Options) -> tuple[np.ndarray, int]:
    """Cells of the hashed table (2**bits longs) and the number of documents. Tasks add up what they read before the
    shuffle; a block of cells is summed for ``_TASKS`` tasks at a time and then over these sums, so that no group holds
    more than some tens of MB however many tasks there are; and the driver gets the table once."""
    found = docs.mapInArrow(_counter(o), "block int, salt int, counts binary").groupBy("block", "salt").applyInPandas(_add, "block int, counts binary")
    found = found.groupBy("block").applyInPandas(_add, "block int, counts binary").collect()
    cells, n = np.zeros(1 << o.bits, np.int64), 0
    for r in found:
        part = np.frombuffer(r.counts, "<i8")
        if r.block < 0:
            n = int(part[0])
        else:
            cells[r.block * _BLOCK : r.block * _BLOCK + len(part)] = part
    return cells, n


def idf_table(cells: np.ndarray, n: int, o: Options) -> np.ndarray:
    return (1 + o.idf_share * np.log((1 + n) / (1 + np.minimum(cells, n))) / np.log(2 + n)).astype(np.float64)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray, o: Options) -> np.ndarray:
    return tf * idf[(h >> np.uint64(64 - o.bits)).astype(np.int64)]


def samples(who: np.ndarray, h: np.ndarray, w: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and for each the least ln a of each of ``count`` hash functions."""
    h = mix64(h)
    head = np.flatnonzero(np.diff(who, prepend=-1))
    out = np.empty((len(head), count))
    ends = np.append(head[1:], len(who))
    first = 0
    while first < len(head):  # texts of about _CHUNK shingles at a time, so that what is worked on stays in cache
        last = max(first + 1, int(np.searchsorted(ends, head[first] + _CHUNK, "right")))
        _least(h[head[first] : ends[last - 1]], np.log(w[head[first] : ends[last - 1]]), head[first:last] - head[first], out[first:last])
        first = last
    return who[head], out


def _least(h: np.ndarray, ln_w: np.ndarray, head: np.ndarray, out: np.ndarray) -> None:
    low = np.uint64(0xFFF)
    x, i = np.empty_like(h), np.empty_like(h)
    r, t, u = np.empty(len(h)), np.empty(len(h)), np.empty(len(h))
    for k in range(out.shape[1]):
        np.multiply(h, _MULTIPLIERS[k], out=x)
        np.right_shift(x, np.uint64(52), out=i)
        _GAMMA_R.take(i.view(np.int64), out=r, mode="clip")
        _INVERSE_R.take(i.view(np.int64), out=t, mode="clip")
        np.multiply(t, ln_w, out=t)
        np.right_shift(x, np.uint64(28), out=i)
        np.bitwise_and(i, low, out=i)
        _BETA.take(i.view(np.int64), out=u, mode="clip")
        np.add(t, u, out=t)
        np.floor(t, out=t)
        np.subtract(t, u, out=t)
        np.add(t, 1.0, out=t)
        np.multiply(t, r, out=t)
        np.right_shift(x, np.uint64(40), out=i)
        np.bitwise_and(i, low, out=i)
        _LN_C.take(i.view(np.int64), out=u, mode="clip")
        np.subtract(u, t, out=t)
        out[:, k] = np.minimum.reduceat(t, head)


def _signer(idf: np.ndarray, o: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            n = batch.num_rows
            doc, word = words(batch.column("text"))
            d1, d2 = sequence_digest(doc, word, n)
            who, h, tf = shingles(doc, word, o.width)
            keys = np.zeros((n, o.bands), np.uint64)
            has = np.zeros(n, bool)
            if len(who):
                owner, s = samples(who, h, weights(h, tf, idf, o), o.bands * o.rows)
                bits = s.view(np.uint64).reshape(len(owner), o.bands, o.rows)
                with np.errstate(over="ignore"):
                    key = np.full((len(owner), o.bands), 1, np.uint64) * np.arange(1, o.bands + 1, dtype=np.uint64)
                    for k in range(o.rows):
                        key = mix64(key * np.uint64(31) + bits[:, :, k])
                keys[owner], has[owner] = key, True
            flat = pa.array(keys[has].view(np.int64).ravel())
            offsets = np.concatenate([[0], np.cumsum(has * o.bands)]).astype(np.int32)
            size = pa.array(np.bincount(who, minlength=n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), flat), size], ["doc_id", "digest", "d1", "d2", "keys", "size"])

    return run


def _tester(idf: np.ndarray, o: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, []  # the hub's texts: several where its doc_id has several
        for batch in slices(batches, "text", _SLICE):
            doc, word = words(batch.column("text"))
            who, h, tf = shingles(doc, word, o.width)
            w = weights(h, tf, idf, o)
            ends = np.searchsorted(who, np.arange(batch.num_rows + 1))
            out: list[tuple[int, int, float]] = []
            for i, (to, is_hub, node) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("is_hub").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                mine, my_w = h[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]]
                if hub != to:
                    hub, held = to, []
                if is_hub:
                    held.append((mine, my_w))
                    continue
                for hub_h, hub_w in held:
                    if not len(mine) or not len(hub_h):
                        continue
                    at = np.minimum(np.searchsorted(hub_h, mine), len(hub_h) - 1)
                    same = hub_h[at] == mine
                    shared = np.minimum(my_w[same], hub_w[at[same]]).sum()
                    j = shared / (my_w.sum() + hub_w.sum() - shared)
                    if j >= o.threshold - 1e-9:
                        out.append((to, node, float(j)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], ["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, o: Options, used: list[DataFrame]) -> DataFrame:
    """a, b, similarity of the pairs (hub, node) that reach the threshold. A hub's text goes once to each salt. (Counts by hub
    are a table of their own, so that Spark can split the join of a hub with very many nodes.) ``used`` gets what may go later."""
    sizes = stored(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / o.salted).cast("int").alias("salts")), "sizes")
    used.append(sizes)
    salted = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("is_hub"), F.col("node").alias("doc_id"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_hub"), F.col("hub").alias("doc_id"))
    roles = salted.unionAll(hubs)
    rows = texts.join(roles.hint("shuffle_hash"), "doc_id").select("hub", "salt", "is_hub", "doc_id", "text")
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("is_hub"))
    return dealt.mapInArrow(_tester(idf, o), "a long, b long, similarity double")


def _crossing(who: np.ndarray, h: np.ndarray, w: np.ndarray, comp: np.ndarray, side: np.ndarray, earlier: np.ndarray, o: Options) -> list[tuple[int, int, float]]:
    """Links (x, y, similarity) between texts of different components and, if there are two sides, of different sides. Every
    such pair is tested but those that can't reach the threshold, share an ``earlier`` key or are joined by then."""
    n = len(comp)
    _, root = np.unique(comp, return_inverse=True)
    terms, v = np.unique(h, return_inverse=True)
    df = np.bincount(v, minlength=len(terms))
    ends = np.searchsorted(who, np.arange(n + 1))
    total = np.bincount(who, w, minlength=n)
    # rarest shingles first; behind a text's prefix less than the threshold's share of its weight is left
    order = np.lexsort((v, df[v], who))
    before = np.cumsum(w[order]) - w[order]
    filled = ends[:-1] < ends[1:]
    before -= np.repeat(before[ends[:-1][filled]], np.diff(ends)[filled])
    at = order[(before <= (1 - o.threshold) * total[who] + 1e-6) & (df[v[order]] > 1)]
    mine = np.searchsorted(who[at], np.arange(n + 1))
    prefix = v[at]
    by_term = np.argsort(prefix, kind="stable")
    first = np.searchsorted(prefix[by_term], np.arange(len(terms) + 1))
    holder = who[at][by_term]
    mark, out, split = np.zeros(len(terms)), [], side.min() != side.max()
    for x in range(1, n):
        t = prefix[mine[x] : mine[x + 1]]
        if not len(t):
            continue
        hit = np.zeros(x, bool)
        for k in t:
            some = holder[first[k] : first[k + 1]]
            hit[some[: np.searchsorted(some, x)]] = True
        hit &= (root[:x] != root[x]) & (np.minimum(total[:x], total[x]) >= (o.threshold - 1e-6) * np.maximum(total[:x], total[x]))
        if split:
            hit &= side[:x] != side[x]
        ys = np.flatnonzero(hit)
        if len(ys):
            ys = ys[~(earlier[ys] == earlier[x]).any(axis=1)]
        mark[v[ends[x] : ends[x + 1]]] = w[ends[x] : ends[x + 1]]
        for y in ys:
            if root[y] != root[x]:
                shared = np.minimum(mark[v[ends[y] : ends[y + 1]]], w[ends[y] : ends[y + 1]]).sum()
                j = shared / (total[x] + total[y] - shared)
                if j >= o.threshold - 1e-9:
                    out.append((int(y), x, float(j)))
                    root[root == root[y]] = root[x]
        mark[v[ends[x] : ends[x + 1]]] = 0
    return out


def _group_tester(idf: np.ndarray, o: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def links() -> pa.RecordBatch:
            node, comp, side, keys = (np.concatenate([x[k] for x in held]) for k in range(4))
            starts = np.cumsum([0] + [len(x[0]) for x in held])
            who = np.concatenate([x[4] + s for x, s in zip(held, starts, strict=False)])
            h, w = (np.concatenate([x[k] for x in held]) for k in (5, 6))
            band = int(np.flatnonzero(keys[0] == group[0])[0])
            found = _crossing(who, h, w, comp, side, keys[:, :band], o) if len(who) else []
            return pa.RecordBatch.from_arrays([pa.array([int(node[f[0]]) for f in found], pa.int64()), pa.array([int(node[f[1]]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["a", "b", "similarity"])

        for batch in slices(batches, "text", _SLICE):
            key, number = (batch.column(c).to_numpy() for c in ("key", "group"))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(number) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if group != (key[a], number[a]):
                    if held:
                        yield links()
                    group, held = (key[a], number[a]), []
                part = batch.slice(a, b - a)
                who, h, tf = shingles(*words(part.column("text")), o.width)
                keys = part.column("keys").flatten().to_numpy().reshape(len(part), -1)
                held.append((*(part.column(c).to_numpy() for c in ("doc_id", "comp", "side")), keys, who, h, weights(h, tf, idf, o)))
        if held:
            yield links()

    return run


def _crossing_links(members: DataFrame, texts: DataFrame, idf: np.ndarray, o: Options, used: list[DataFrame]) -> DataFrame:
    """Links between the components of large buckets. ``members``: key, node, comp, size, keys."""
    parts = members.groupBy("key", "comp").agg(F.sum("size").alias("size"))
    of = parts.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("all"))
    blocks = lambda size: F.ceil(size / o.block).cast("int")
    # the bucket's largest component is dealt into blocks of its own, as its nodes needn't meet
    of = stored(of.select("key", F.col("main.comp").alias("main"), F.when(F.col("all") > o.block, blocks(F.col("main.size"))).otherwise(0).alias("mains"), F.when(F.col("all") > o.block, blocks(F.col("all") - F.col("main.size"))).otherwise(1).alias("others")), "parts")
    used.append(of)
    dealt = members.join(of, "key").withColumn("is_main", (F.col("comp") == F.col("main")) & (F.col("mains") > 0))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    dealt = dealt.withColumn("side", F.when(F.col("is_main"), F.col("side") + F.col("others")).otherwise(F.col("side")))
    every = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    groups = F.transform(every, lambda k: F.least(k, F.col("side")).cast("long") * (F.col("others") + F.col("mains")) + F.greatest(k, F.col("side")))
    roles = dealt.select("key", F.explode(groups).alias("group"), "side", "comp", "keys", F.col("node").alias("doc_id"))
    rows = texts.join(roles.hint("shuffle_hash"), "doc_id").select("key", "group", "side", "comp", "keys", "doc_id", "text")
    met = rows.repartition("key", "group").sortWithinPartitions("key", "group")
    return met.mapInArrow(_group_tester(idf, o), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, is_representative: one row for each document."""
    every = _classed(docs, options)
    sizes = every.groupBy(F.col("class_id").alias("_class")).agg(F.count(F.lit(1)).alias("class_size"))
    joined = every.join(sizes, F.col("class_id").eqNullSafe(F.col("_class")), "left")
    return joined.select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("is_representative"))


def _classed(docs: DataFrame, o: Options) -> DataFrame:
    """doc_id, digest (of the text), class_id of each row, as a stored table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cells, n = document_frequencies(rows, o)
    idf = idf_table(cells, max(n, 1), o)
    told = rows.withColumn("digest", F.xxhash64("text"))
    signed = stored(told.mapInArrow(_signer(idf, o), "doc_id long, digest long, d1 long, d2 long, keys array<long>, size long"), "signed")
    nodes = stored(signed.where("doc_id IS NOT NULL AND size(keys) > 0").groupBy("d1", "d2", "keys").agg(F.min("doc_id").alias("node"), F.max("size").alias("size")), "nodes")
    links = _links(nodes, rows, idf, o)
    label = nodes.select("d1", "d2", "node")
    comps = components(links) if links is not None else None
    if comps is not None:
        label = label.join(comps, "node", "left").select("d1", "d2", F.coalesce("comp", "node").alias("class_id"))
    else:
        label = label.select("d1", "d2", F.col("node").alias("class_id"))
    has = signed.select("doc_id", "digest", "d1", "d2", (F.size("keys") > 0).alias("has"))
    classed = has.where("has AND doc_id IS NOT NULL").join(label, ["d1", "d2"], "left").select("doc_id", "digest", "class_id")
    alone = has.where("NOT has OR doc_id IS NULL").select("doc_id", "digest", F.col("doc_id").alias("class_id"))
    every = stored(classed.unionAll(alone), "classed")
    discard(signed, nodes, links, comps)
    return every


def _links(nodes: DataFrame, rows: DataFrame, idf: np.ndarray, o: Options) -> DataFrame | None:
    """Verified links (a, b) that connect the classes, as a stored table; None if no two nodes meet."""
    met = nodes.select("node", F.explode("keys").alias("key"))
    buckets = stored(met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1"), "buckets")
    # one row a node again right behind the join: its buckets (at most ``bands`` for each text) with their size and hubs
    held = F.when(F.col("n").isNotNull(), F.struct("key", "n", "low", "high"))
    nodes_in = met.join(buckets, "key", "left").groupBy("node").agg(F.min("low").alias("low"), F.collect_list(held).alias("buckets"))
    candidates = stored(nodes_in.where("low IS NOT NULL"), "candidates")
    discard(buckets)
    if candidates.isEmpty():
        return None
    ids = candidates.select(F.col("node").alias("doc_id"))
    texts = stored(rows.join(ids.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    parts: list[DataFrame] = []  # tables of links found so far
    used = [candidates, texts]

    def test(pairs: DataFrame) -> None:
        parts.append(stored(verified(pairs, texts, idf, o, used).select("a", "b"), "links"))

    def found() -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def done() -> DataFrame:
        out = stored(found(), "links")
        discard(*parts, *used)
        return out

    tested = candidates.where("low <> node").select(F.col("low").alias("hub"), "node")
    test(tested)
    used.append(comps := components(found()))
    labelled = _label(candidates, "node", comps)
    hubs = F.explode(F.array_distinct(F.concat(F.transform("buckets", lambda x: x.low), F.transform("buckets", lambda x: x.high))))
    other = _label(labelled.select("node", F.col("comp").alias("own"), hubs.alias("hub")), "hub", comps).where("own <> comp").select("hub", "node")
    fresh = stored(_unordered(other).join(tested, ["hub", "node"], "left_anti"), "pairs")
    used.append(fresh)
    if fresh.isEmpty():
        return done()
    tested = tested.unionAll(fresh)
    test(fresh)

    # what is left are buckets that hold several components
    used.append(comps := components(found()))
    labelled = _label(candidates, "node", comps)
    members = labelled.select("node", "comp", F.explode("buckets").alias("b")).select("node", "comp", "b.key", "b.n")
    mixed = stored(members.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("key"), "mixed")
    members = stored(members.join(mixed, "key"), "members")
    used += [mixed, members]
    if members.isEmpty():
        return done()
    small = members.where(F.col("n") <= o.wide)
    others = small.select("key", F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    near = small.join(others, "key").where("hub < node AND comp <> hub_comp").select("hub", "node").distinct()
    fresh = stored(near.join(tested, ["hub", "node"], "left_anti"), "pairs")
    used.append(fresh)
    if not fresh.isEmpty():
        test(fresh)
    large = stored(members.where(F.col("n") > o.wide).join(nodes.select("node", "keys", "size"), "node").where("array_contains(keys, key)"), "large")
    used.append(large)
    if not large.isEmpty():
        parts.append(stored(_crossing_links(large, texts, idf, o, used).select("a", "b"), "links"))
    return done()


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")).distinct()


def _label(rows: DataFrame, column: str, comps: DataFrame) -> DataFrame:
    named = comps.select(F.col("node").alias(column), "comp")
    return rows.join(named, column, "left").withColumn("comp", F.coalesce("comp", column))


def deduplicated(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the rows of its smallest doc_id, equal rows (doc_id and text) once; null ids
    all stay. Columns of any name pass."""
    kept, hashed = free_names(docs, "_kept", "_digest")
    every = _classed(docs, options)
    found = every.where("doc_id = class_id").select(F.col("doc_id").alias(kept), F.col("digest").alias(hashed)).distinct()
    digest = F.xxhash64(F.col("text").cast("string"))
    known = docs.where("doc_id IS NOT NULL").join(found, (F.col("doc_id").cast("long") == F.col(kept)) & (digest == F.col(hashed)), "left_semi")
    known = known.withColumn(hashed, digest).dropDuplicates(["doc_id", hashed]).drop(hashed)
    return known.unionAll(docs.where("doc_id IS NULL"))
