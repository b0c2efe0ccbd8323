"""Asset garbage collection: which stored files nothing refers to, and whether deleting them is safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import is_media_key

BASE_ALLOWANCE = 10_000


def roots(*tables: DataFrame) -> DataFrame:
    """Distinct valid keys that any version of any table holds; old versions count on purpose."""
    every = reduce(lambda a, b: a.unionByName(b), (t.select(F.col("cdn_key").alias("key")) for t in tables))
    return every.where(is_media_key(F.col("key"))).distinct()


def unparsed(found: DataFrame, parsed: DataFrame) -> DataFrame:
    return found.join(parsed.select(F.col("parent").alias("key")), "key", "left_anti")


def referenced(found: DataFrame, parsed: DataFrame) -> DataFrame:
    """Roots and the children of parsed manifests (one level)."""
    return found.select("key").union(parsed.select(F.explode("children").alias("key"))).distinct()


def candidates(inventory: DataFrame, ref: DataFrame, acked: DataFrame, cutoff_ms: int) -> DataFrame:
    """Stored before the cutoff, referred to by nothing, and not acknowledged since."""
    recent = acked.where(F.col("acked_ms") >= cutoff_ms).select("key")
    return inventory.where(F.col("created_ms") < cutoff_ms).join(ref, "key", "left_anti").join(recent, "key", "left_anti")


def report(inventory: DataFrame, ref: DataFrame, acked: DataFrame, cutoff_ms: int) -> DataFrame:
    """Counts and bytes of referenced, candidate and in-grace files, distinct and dangling references: one row."""
    r = ref.select("key").distinct().withColumn("r", F.lit(True))
    c = candidates(inventory, ref, acked, cutoff_ms).select("key").withColumn("c", F.lit(True))
    # both sides have a row for each key, so one full join tells stored from referenced
    both = inventory.select("key", "size", F.lit(True).alias("i")).join(r, "key", "full").join(c, "key", "left")
    i, rr, cc = (F.coalesce(F.col(x), F.lit(False)) for x in "irc")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0)).cast("long")
    out = both.agg(
        F.count_if(i).alias("inventory"), F.count_if(i & rr).alias("referenced"), total(i & rr).alias("referenced_bytes"), F.count_if(cc).alias("candidates"), total(cc).alias("candidate_bytes"),
        F.count_if(rr).alias("distinct_references"), F.count_if(rr & ~i).alias("dangling"),
    )
    return out.withColumn("in_grace", F.col("inventory") - F.col("referenced") - F.col("candidates"))


def dangling(inventory: DataFrame, ref: DataFrame, sample: int) -> DataFrame:
    return ref.select("key").distinct().join(inventory.select("key"), "key", "left_anti").orderBy("key").limit(sample)


def gate(rep: DataFrame, open_roots: DataFrame, log_covers_grace: bool, share: float = 0.1, base: int = BASE_ALLOWANCE, question: int | None = None, approval: int | None = None) -> DataFrame:
    """Why nothing may be deleted, or ``open``. A standing ``question`` (its id) holds every pass back until it is answered; an
    ``approval`` of just that question opens the next pass, for the question's files (``approved``), whatever their number."""
    n = open_roots.agg(F.count(F.lit(1)).alias("unparsed"))
    many = F.col("candidates") > base + share * F.col("referenced")
    last = F.when(many, "too many candidates").otherwise("open") if question is None else F.lit("open" if question == approval else "a question is open")
    reason = F.when(~F.lit(log_covers_grace), "the ack log doesn't cover the grace period").when(F.col("unparsed") > 0, "unparsed roots").otherwise(last)
    return rep.crossJoin(n).select(reason.alias("gate"))


def approved(found: DataFrame, question: DataFrame) -> DataFrame:
    """Candidates that an earlier question listed and that are still candidates."""
    return found.join(question.select(F.explode("keys").alias("key")).distinct(), "key", "left_semi")


def index_check(keys: DataFrame, index: DataFrame, sample: int) -> DataFrame:
    """How many keys an index misses, and the first of these by key."""
    seen = index.select("key").distinct().withColumn("seen", F.lit(True))
    joined = keys.select("key").join(seen, "key", "left").withColumn("missed", F.col("seen").isNull())
    first = joined.where("missed").select("key").orderBy("key").limit(sample).agg(F.array_sort(F.collect_list("key")).alias("sample"))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if("missed").alias("missed")).crossJoin(first)


def footprint(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, bytes and files of stored tables, from file metadata."""
    parts = []
    for name, df in tables.items():
        files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
        parts.append(files.agg(F.lit(name).alias("name"), F.sum("n").alias("n_rows"), F.sum("b").alias("bytes"), F.count(F.lit(1)).alias("files")))
    return reduce(lambda a, b: a.unionAll(b), parts)
