"""Approximate nearest neighbours by inner product: a navigable small-world graph for each shard, results merged.

Vectors that are equal are one entry of the index (a class with its smallest members), so a very common vector costs a
graph one node. Classes are dealt to shards by a hash: at least ``least_shards``, of about ``shard_rows`` classes at most,
which bounds a task's memory. A shard is one Parquet row of flat arrays: vectors, neighbours of each level, entry point.
Largest inner product is made a nearest-neighbour problem by one more component, sqrt(max norm^2 - norm^2), which a query
has as 0.

Searching: query blocks meet every shard (a stated query set against all rows, in blocks). Copies of a shard's index, one
for at most ``lane_blocks`` blocks, stream their share of the blocks; all queries of a block walk the graph in lockstep. The
found classes are expanded to their members, scored exactly in double precision on the original vectors, and the best k of
each query are kept, ties to the smaller id. Of a class the k + 1 smallest ids suffice for that: its members tie, and one of
them may be the query itself. Up to ``least_shards * shard_rows`` vectors the work of a query grows with the logarithm of
their number, beyond that in proportion to the number of shards.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or as
candidates; vectors of different lengths are never compared; null ids take no part; equal (id, vector) rows count once; an id
with several vectors is one candidate and one query, and two ids score the largest inner product of any of their vectors;
fewer than k candidates are all returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


class Graph:
    """Levels of neighbour arrays (-1: none). Level 0 holds all nodes, level l those that drew l or more."""

    def __init__(self, points: np.ndarray, m: int, ef: int, seed: int):
        n = len(points)
        self.x = np.ascontiguousarray(points, np.float32)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        self.m, self.ef = m, ef
        rng = np.random.default_rng(seed)
        draw = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 8)
        order = np.argsort(-draw, kind="stable")  # high levels first: the entry point never moves
        self.x, self.sq, self.level, self.order = self.x[order], self.sq[order], draw[order], order
        self.links = [np.full((int((self.level >= k).sum()), 2 * m if k == 0 else m), -1, np.int32) for k in range(int(self.level[0]) + 1 if n else 0)]
        self._build()

    def _build(self) -> None:
        n, done = len(self.x), 1
        while done < n:
            step = min(n - done, max(1, min(done // 2, 512)))
            new = np.arange(done, done + step)
            start = np.zeros(step, np.int64)
            for k in range(len(self.links) - 1, -1, -1):
                part = np.flatnonzero(self.level[new] >= k)
                if not len(part):
                    start = self.walk(self.x[new], start, k, done, 1)[0][:, 0]
                    continue
                ids, _ = self.walk(self.x[new], start, k, done, self.ef)
                start = ids[:, 0]
                self._connect(new[part], ids[part], k, done)
            done += step

    def _connect(self, new: np.ndarray, found: np.ndarray, k: int, done: int) -> None:
        """Links new nodes to diverse ones of what they found and of each other, and back."""
        peers = np.tile(new, (len(new), 1)) if len(new) <= 64 else self._near_peers(new)
        both = np.concatenate([found, np.where(peers == new[:, None], -1, peers)], axis=1)
        self.links[k][new] = self._diverse(new, both, self.links[k].shape[1] // (2 if k == 0 else 1))[:, : self.links[k].shape[1]] if k else self._pad(self._diverse(new, both, self.m), self.links[k].shape[1])
        src = np.repeat(new, self.links[k].shape[1])
        dst = self.links[k][new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        heads = np.flatnonzero(np.diff(dst, prepend=-1))
        width = int(np.diff(np.append(heads, len(dst))).max(initial=0))
        if not width:
            return
        touched = dst[heads]
        more = np.full((len(heads), width), -1, np.int64)
        rank = np.arange(len(dst)) - np.repeat(heads, np.diff(np.append(heads, len(dst))))
        more[np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(dst)))), rank] = src
        old = self.links[k][touched]
        free = (old < 0).sum(axis=1)
        simple = (more >= 0).sum(axis=1) <= free
        for rows, full in ((np.flatnonzero(simple), False), (np.flatnonzero(~simple), True)):
            if not len(rows):
                continue
            all_ = np.concatenate([old[rows], more[rows]], axis=1)
            if full:
                self.links[k][touched[rows]] = self._pad(self._diverse(touched[rows], all_, old.shape[1]), old.shape[1])
            else:
                all_.sort(axis=1)
                all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
                self.links[k][touched[rows]] = np.take_along_axis(all_, np.argsort(all_ < 0, axis=1, kind="stable"), axis=1)[:, : old.shape[1]]

    def _near_peers(self, new: np.ndarray) -> np.ndarray:
        d = self.sq[new][None, :] - 2 * (self.x[new] @ self.x[new].T)
        return new[np.argpartition(d, min(16, len(new) - 1), axis=1)[:, :17]]

    @staticmethod
    def _pad(a: np.ndarray, width: int) -> np.ndarray:
        return np.pad(a, ((0, 0), (0, max(0, width - a.shape[1]))), constant_values=-1)[:, :width]

    def _diverse(self, at: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates the nearest that is nearer to the node than to any kept one, ``keep`` times; then the nearest left."""
        out = np.full((len(at), keep), -1, np.int64)
        for lo in range(0, len(at), 256):
            a, c = at[lo : lo + 256], np.sort(ids[lo : lo + 256], axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            c[c == a[:, None]] = -1
            d = self.sq[a][:, None] + self.sq[c] - 2 * np.einsum("ij,ikj->ik", self.x[a], self.x[c])
            d[c < 0] = np.inf
            first = np.argsort(d, axis=1, kind="stable")[:, : 4 * keep]
            c, d = np.take_along_axis(c, first, 1), np.take_along_axis(d, first, 1)
            v = self.x[c]
            between = self.sq[c][:, :, None] + self.sq[c][:, None, :] - 2 * np.einsum("ikd,ild->ikl", v, v)
            alive, taken = np.isfinite(d), np.zeros(d.shape, bool)
            for j in range(d.shape[1]):
                pick = alive[:, j] & (taken.sum(axis=1) < keep)
                taken[:, j] = pick
                alive[:, j + 1 :] &= ~(pick[:, None] & (between[:, j, j + 1 :] < d[:, j + 1 :]))
            rest = np.isfinite(d) & ~taken
            score = np.where(taken, 0, np.where(rest, 1, 2))
            best = np.argsort(score, axis=1, kind="stable")[:, :keep]
            got = np.where(np.take_along_axis(score, best, 1) < 2, np.take_along_axis(c, best, 1), -1)
            out[lo : lo + 256, : got.shape[1]] = got
        return out

    def walk(self, q: np.ndarray, start: np.ndarray, k: int, known: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk of all queries in lockstep on level k among the first ``known`` nodes: ids (-1: none) and distances, best first."""
        n, links = len(q), self.links[k]
        seen = np.zeros((n, known), bool)
        rows = np.arange(n)
        ids, dist = np.full((n, ef), -1, np.int64), np.full((n, ef), np.inf, np.float32)
        open_ = np.zeros((n, ef), bool)
        ids[:, 0], dist[:, 0] = start, self.sq[start] - 2 * np.einsum("ij,ij->i", q, self.x[start])
        open_[:, 0], seen[rows, start] = True, True
        live = rows
        while len(live):
            best = np.argmax(open_[live], axis=1)  # rows are sorted, so the first open one is the nearest
            live = live[open_[live, best]]
            if not len(live):
                break
            best = np.argmax(open_[live], axis=1)
            open_[live, best] = False
            near = links[ids[live, best]].astype(np.int64)
            ok = near >= 0
            ok &= ~seen[live[:, None], np.where(ok, near, 0)]
            r, c = np.nonzero(ok)
            seen[live[r], near[r, c]] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = self.sq[near[r, c]] - 2 * np.einsum("ij,ij->i", q[live[r]], self.x[near[r, c]])
            hit = np.flatnonzero((d < dist[live, -1:]).any(axis=1))
            if len(hit):
                at = live[hit]
                all_d = np.concatenate([dist[at], d[hit]], axis=1)
                top = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
                dist[at] = np.take_along_axis(all_d, top, 1)
                ids[at] = np.where(np.isfinite(dist[at]), np.take_along_axis(np.concatenate([ids[at], near[hit]], axis=1), top, 1), -1)
                open_[at] = np.take_along_axis(np.concatenate([open_[at], np.isfinite(d[hit])], axis=1), top, 1)
        return ids, dist


def _lift(x: np.ndarray) -> np.ndarray:
    norm = np.einsum("ij,ij->i", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], axis=1)


_INDEX = "dim int, shard int, n long, classes binary, vectors binary, links array<binary>, widths array<int>"


def _indexer(m: int, ef: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class_id")  # the same graph whatever order rows arrive in
        x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        g = Graph(_lift(x), m, ef, 11)
        ids = pdf["class_id"].to_numpy()[g.order]
        return pd.DataFrame(
            {"dim": [x.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "n": [len(x)], "classes": [ids.astype(np.int64).tobytes()], "vectors": [g.x.tobytes()], "links": [[a.tobytes() for a in g.links]], "widths": [[a.shape[1] for a in g.links]]}
        )

    return run


def _search_graph(row: dict, q: np.ndarray, k: int, ef: int) -> np.ndarray:
    """Class ids found for each query (-1: none)."""
    n = row["n"]
    classes = np.frombuffer(row["classes"], np.int64)
    g = Graph.__new__(Graph)
    g.x = np.frombuffer(row["vectors"], np.float32).reshape(n, -1)
    g.sq = np.einsum("ij,ij->i", g.x, g.x)
    g.links = [np.frombuffer(b, np.int32).reshape(-1, w) for b, w in zip(row["links"], row["widths"], strict=True)]
    q = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
    if n <= ef:
        return np.tile(classes, (len(q), 1))
    out = []
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        start = np.zeros(len(part), np.int64)
        for level in range(len(g.links) - 1, 0, -1):
            start = g.walk(part, start, level, n, 1)[0][:, 0]
        ids = g.walk(part, start, 0, n, ef)[0][:, :k]
        out.append(np.where(ids >= 0, classes[np.maximum(ids, 0)], -1))
    return np.concatenate(out)


def _searcher(k: int, ef: int):
    """Rows come sorted by shard, each shard's index before its query blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] is None:
                    index = row
                    continue
                if (index.get("dim"), index.get("shard")) != (row["dim"], row["shard"]):
                    continue  # a shard that holds no vector of this length
                q = np.frombuffer(row["block"], np.float64).reshape(-1, row["dim"])
                found = _search_graph(index, q, k, ef)
                owner = np.repeat(np.frombuffer(row["queries"], np.int64), found.shape[1])
                ok = found.ravel() >= 0
                yield pa.RecordBatch.from_arrays([pa.array(owner[ok]), pa.array(found.ravel()[ok])], ["query_id", "class_id"])

    return run


def _packer(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            for dim, part in table.groupby("dim"):
                for lo in range(0, len(part), rows):
                    p = part.iloc[lo : lo + rows]
                    x = np.stack(p["vector"].to_numpy()).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([p["vec_id"].to_numpy(np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["dim", "queries", "block"])

    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles), dim of the rows that take part, equal rows once."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & good).withColumn("dim", F.size("vector"))


def classes(points: DataFrame, k: int) -> DataFrame:
    """class_id (smallest member), vector, dim, members (the k + 1 smallest ids). Members are thinned in tasks first, so
    a very common vector doesn't gather in one."""
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    salts = max(256, points.count() // 50_000)
    salted = points.groupBy("vector", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(smallest(F.collect_list("vec_id")).alias("ids"))
    both = salted.groupBy("vector", "dim").agg(smallest(F.flatten(F.collect_list("ids"))).alias("members"))
    return both.select(F.get("members", F.lit(0)).alias("class_id"), "vector", "dim", "members")


def build_index(found: DataFrame, shard_rows: int = 25_000, least_shards: int = 4, m: int = 16, ef: int = 96) -> DataFrame:
    """One row of flat arrays for each (dim, shard); every class is in one of them."""
    n = found.count()
    shards = max(least_shards, -(-n // shard_rows))
    keyed = found.select("class_id", "vector", "dim", F.pmod(F.xxhash64("class_id"), F.lit(shards)).cast("int").alias("shard"))
    return stored(keyed.groupBy("dim", "shard").applyInPandas(_indexer(m, ef), _INDEX), "graph")


def search(index: DataFrame, found: DataFrame, points: DataFrame, queries: Column, k: int = 20, ef: int = 192, block: int = 256, lane_blocks: int = 500) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of the points that ``queries`` selects, but themselves."""
    asked = points.where(queries).dropDuplicates(["vec_id", "vector"])
    blocks = asked.select("vec_id", "vector", "dim").repartition("vec_id").mapInArrow(_packer(block), "dim int, queries binary, block binary")
    blocks = stored(blocks, "blocks")
    lanes = F.lit(max(4, -(-blocks.count() // lane_blocks))).cast("int")
    last = index.agg(F.max("shard")).first()[0] or 0
    sent = blocks.withColumn("lane", F.pmod(F.xxhash64("queries"), lanes).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    whole = index.withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1)))
    met = whole.unionByName(sent, allowMissingColumns=True).repartition("dim", "shard", "lane")
    hits = met.sortWithinPartitions("dim", "shard", "lane", F.col("block").isNotNull()).mapInArrow(_searcher(k + 1, ef), "query_id long, class_id long")
    members = found.select("class_id", F.explode("members").alias("vec_id"), "vector")
    near = hits.join(members, "class_id").where("query_id <> vec_id")
    dot = F.aggregate(F.zip_with("q", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = near.join(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "query_id").select("query_id", "vec_id", dot.alias("score"))
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, **options) -> DataFrame:
    points = stored(usable(vectors), "points")
    found = stored(classes(points, k), "classes")
    return search(build_index(found, **options), found, points, queries, k)
