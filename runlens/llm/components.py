"""Connected components of a link table by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) of every node in ``edges`` (a, b); nodes without edges have no row.

    Each round points a node at the smallest of itself and its neighbours, follows these pointers to their roots by doubling,
    and contracts the links along them. A root is smaller than all its neighbours, and each has at least one that points
    at it, so a round at least halves the nodes that still have links; a chain in order of ids is one round of
    log2(length) doublings. Minima are combined before the shuffle, so a node with very many links is no hot task;
    relabelling goes by joins whose one side is unique, which Spark can split. Superseded tables are deleted."""
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = _roots(stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "roots"))
        old = labels
        if labels is None:
            labels = stored(root.select(F.col("a").alias("node"), F.col("up").alias("comp")), "labels")
        else:
            labels = stored(labels.join(root, labels.comp == root.a, "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        pa, pb = (root.select(F.col("a").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        moved = edges.join(pa, "a").join(pb, "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b"))
        rest = stored(moved.where("a <> b").distinct(), "edges")
        discard(edges, root, old)
        edges = rest
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    discard(edges)
    return labels


def _roots(up: DataFrame) -> DataFrame:
    """Pointers (a, up) followed to their roots: each step doubles how far they reach."""
    while True:
        further = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
        after = stored(up.join(further, "up").select("a", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "roots")
        discard(up)
        up = after
        if up.where("moved").isEmpty():
            return up
