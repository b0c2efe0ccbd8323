"""The engine's tables from general ones: points, runs, text streams and media from events, orders, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["project_id", "run_id", "metric_name", "tag", "step"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(col: str):
    """Milliseconds of a timestamp column, with or without a time zone (session zone UTC)."""
    return F.unix_millis(F.col(col).cast("timestamp"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar points of events: a run for each eighth user, some values NaN or infinite."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 101 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return e.select(
        F.lit("events").alias("project_id"),
        F.concat(F.lit("run"), (F.col("user_id") % 8).cast("string")).alias("run_id"),
        F.col("event_type").alias("metric_name"),
        F.lit("").alias("tag"),
        F.col("event_id").alias("step"),
        epoch_ms("ts").alias("timestamp_ms"),
        value.cast("float").alias("value"),
        F.lit(None).cast("string").alias("cdn_key"),
        F.lit(None).cast("string").alias("text_data"),
        F.col("ts").cast("timestamp").alias("inserted_at"),
    )


def dense_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of line items: tagged series, several versions of a key, and keys whose newest payload is media or text."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.col("l_orderkey") % 50
    return li.select(
        F.concat(F.lit("p"), (F.col("l_suppkey") % 2).cast("string")).alias("project_id"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("run_id"),
        F.concat(F.lit("flag/"), "l_returnflag").alias("metric_name"),
        F.when(F.col("l_linenumber") % 4 == 0, "").otherwise((F.col("l_linenumber") % 4).cast("string")).alias("tag"),
        (F.col("l_orderkey") % 1000).alias("step"),
        (epoch_ms("l_shipdate") + F.col("l_partkey")).alias("timestamp_ms"),
        F.when(~kind.isin(7, 8), F.col("l_extendedprice")).cast("float").alias("value"),
        F.when(kind == 7, F.concat(F.lit("a"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lit(".png"))).alias("cdn_key"),
        F.when(kind == 8, F.concat(F.lit("line "), F.col("l_partkey").cast("string"), F.lit("\n"))).alias("text_data"),
        F.timestamp_millis(epoch_ms("l_shipdate") + F.col("l_partkey") % 1000).alias("inserted_at"),
    )


def text_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log chunks of documents: a run for each source, a stream for each language, chunks cut where the text is."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit("docs").alias("project_id"),
        F.col("source").alias("run_id"),
        F.concat(F.lit("logs/"), "lang").alias("metric_name"),
        F.lit("").alias("tag"),
        F.col("doc_id").alias("step"),
        (F.col("doc_id") * 1000).alias("timestamp_ms"),
        F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("\r\n")).when(F.col("doc_id") % 3 == 1, F.lit("\n")).otherwise("")).alias("text_data"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of orders: a project for each nation of the customer; lifecycle times derived from the order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    created = epoch_ms("o_orderdate") + F.col("o_orderkey") % 1000
    status, k = F.col("o_orderstatus"), F.col("o_orderkey")
    ms = lambda col: F.timestamp_millis(col)
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("project_id"),
        F.concat(F.lit("r"), k.cast("string")).alias("run_id"),
        F.concat(F.lit("Run "), (k % 700).cast("string")).alias("run_name"),
        ms(created).alias("created_at"),
        F.when(status != "P", ms(created + (k % 90) * 1000)).alias("last_main_metric_at"),
        F.when(k % 3 != 0, ms(created + (k % 650) * 1000)).alias("last_system_metric_at"),
        ms(created + (k % 700) * 1000).alias("last_ingested_at"),
        F.when(status == "F", F.when(k % 5 == 0, 1).otherwise(0)).cast("int").alias("exit_code"),
        F.when(status == "F", ms(created + (k % 600) * 1000)).alias("terminated_at"),
        F.when(k % 11 == 0, ms(created + (k % 20) * 86_400_000)).alias("deleted_at"),
        F.when(k % 121 == 0, ms(created + 40 * 86_400_000)).alias("purging_at"),
        F.when(k % 363 == 0, ms(created + 41 * 86_400_000)).alias("purge_attempt_at"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media inventory of pages: key, size, created."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.sha2(F.coalesce("html", F.lit("")), 256), F.lit(".bin")).alias("key"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"), (F.col("page_id") * 3_600_000).alias("created_ms"), "page_id", "url")
