"""Streaming ingest: validated points appended by micro-batch, with a registry, heartbeats, a rollup and a change feed.

A micro-batch is the durability unit: ``source`` bounds it by bytes and the trigger by time, and its files by rows. Every
table is written under a folder of its batch id and overwritten when the batch is replayed, so retries leave no trace. Derived tables are partial aggregates of each batch; readers combine them, which
costs a merge of small rows and needs no update in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import is_finite
from ..operators.points import KEY, SERIES, validate_points
from ..operators.registry import heartbeats, registry

TABLES = ("points", "rejects", "registry", "heartbeats", "rollup", "feed")
#: Cell width of the finest rollup tier; wider powers of two are exact merges of it.
WIDTH = 4


def rollup(points: DataFrame, width: int = WIDTH) -> DataFrame:
    """Envelope aggregates of numeric points for each (series, cell): partial sums that merge exactly."""
    y, step = F.col("value").cast("double"), F.col("step")
    ok = is_finite(y)
    v = F.when(ok, y)
    return (
        points.where("value IS NOT NULL")
        .groupBy(*SERIES, F.floor(step / width).alias("cell"))
        .agg(F.count_if(ok).alias("n"), F.sum(v).alias("total"), F.min(v).alias("y_min"), F.max(v).alias("y_max"), F.min("step").alias("lo"), F.max("step").alias("hi"), F.count_if(~ok).alias("odd"))
    )


def merged(parts: DataFrame, factor: int = 1) -> DataFrame:
    """Combines partial rollups, into cells ``factor`` (a power of two) times as wide."""
    return parts.groupBy(*SERIES, F.floor(F.col("cell") / factor).alias("cell")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("odd").alias("odd")
    )


#: Bounds of a cut: rows of a file, bytes of a micro-batch.
CUT_ROWS, CUT_BYTES = 10_000, 8 << 20


def source(spark: SparkSession, schema, path: str, cut_bytes: int = CUT_BYTES) -> DataFrame:
    """A folder of Parquet files as a stream, at most ``cut_bytes`` (one file at least) in a micro-batch."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(cut_bytes)).parquet(path)


def write_batch(root: str, cut_rows: int = CUT_ROWS):
    """The ``foreachBatch`` function of the ingest. Points are written by project, each task a range of the key, so a hot run
    is many files of at most ``cut_rows`` rows."""

    def put(df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")

    def put_points(df: DataFrame, batch: int) -> None:
        dealt = df.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
        dealt.write.mode("overwrite").option("maxRecordsPerFile", cut_rows).partitionBy("project_id").parquet(f"{root}/points/batch={batch}")

    def run(df: DataFrame, batch: int) -> None:
        # a batch is often one file that one task reads: dealt, so that the tables are not made of one partition
        checked = validate_points(df.repartition(*KEY)).persist()
        try:
            good = checked.where("reason IS NULL").drop("reason")
            put_points(good, batch)
            put(checked.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "rejects", batch)
            put(registry(good), "registry", batch)
            put(heartbeats(good), "heartbeats", batch)
            put(rollup(good), "rollup", batch)
            put(good.groupBy("project_id", "run_id").agg(F.count(F.lit(1)).alias("points"), F.max("timestamp_ms").alias("last_ms")), "feed", batch)
        finally:
            checked.unpersist()

    return run


def start(points: DataFrame, root: str, every: str | None = "2 seconds") -> StreamingQuery:
    """Starts the ingest of a streaming point table; with ``every`` None it takes what is there and ends."""
    w = points.writeStream.foreachBatch(write_batch(root)).option("checkpointLocation", f"{root}/checkpoint")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "registry").groupBy("project_id", "run_id", "metric_name").agg(F.max("type_code").alias("type_code"))


def read_heartbeats(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "heartbeats").groupBy("project_id", "run_id").agg(F.max("last_main_ms").alias("last_main_ms"), F.max("last_system_ms").alias("last_system_ms"))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Run versions of the change feed: how many batches touched a run."""
    return read(spark, root, "feed").groupBy("project_id", "run_id").agg(F.countDistinct("batch").alias("version"))


def frames(changes: DataFrame, every_ms: int = 1000) -> DataFrame:
    """What a listener is sent of changes (run_id, version, at_ms): at most one frame of a run in each ``every_ms``, the newest."""
    beat = F.floor(F.col("at_ms") / every_ms)
    newest = changes.groupBy("run_id", beat.alias("frame")).agg(F.max(F.struct("version", "at_ms")).alias("n"))
    return newest.select("run_id", "frame", "n.version", "n.at_ms")


def without_retries(points: DataFrame, within: str = "16 seconds") -> DataFrame:
    """Drops repeated sends of a row; state is bounded by the watermark on ingest time."""
    return points.withWatermark("inserted_at", within).dropDuplicatesWithinWatermark([*KEY, "inserted_at"])


def classify(batch: DataFrame, marks: DataFrame) -> DataFrame:
    """How each row of a batch meets what is stored: ``marks`` has each series' highest step and newest insertion.

    append: behind the last step. late: new step range but stamped no later than what is there. rewrite: at or before the
    last step. tombstone: a payload of another kind, which takes a numeric point away."""
    m = marks.select(*SERIES, "high_step", "newest")
    kind = (
        F.when(F.col("value").isNull(), "tombstone")
        .when(F.col("high_step").isNull(), "append")
        .when(F.col("step") <= F.col("high_step"), "rewrite")
        .when(F.col("inserted_at") <= F.col("newest"), "late")
        .otherwise("append")
    )
    return batch.join(m, SERIES, "left").withColumn("route", kind).drop("high_step", "newest")


def recompute(points: DataFrame, touched: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rollup cells of (series, cell) that late rows, rewrites or tombstones touched, from the newest versions."""
    from ..operators.points import latest

    cells = touched.select(*SERIES, F.floor(F.col("step") / width).alias("cell")).distinct()
    mine = points.withColumn("cell", F.floor(F.col("step") / width)).join(cells, [*SERIES, "cell"], "left_semi").drop("cell")
    return rollup(latest(mine), width)
