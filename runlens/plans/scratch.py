"""Materialising intermediate tables on storage that executors share, and numbering of their rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to ``spark.checkpoint.dir``, for plans that read it several times and must not be recomputed
    differently. Without that setting a temporary folder serves in local mode; elsewhere it is an error."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def shared_root(spark) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="runlens-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds ``name``, the place (from 0) of each row in the order of ``by``: ranges are sorted in their own tasks, and only a
    count of each range goes through a window."""
    dealt = checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumns({"_range": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_in", "_at", "_start")


def running_total(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all rows before each in the order of ``by`` (unique): sums run within ranges, and
    only a total of each range goes through a window over all."""
    dealt = checkpointed(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy("_range").agg(F.sum(value).alias(value))
    starts = totals.select("_range", before(Window.orderBy("_range")).alias("_start"))
    inside = dealt.withColumn("_in", before(Window.partitionBy("_range").orderBy(by)))
    return inside.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")
