"""Discovery: which projects, runs and metrics there are, and what kind each metric is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import previous
from .points import bad_text

CDN, NUMERIC, TEXT = 1, 2, 3


def registry(points: DataFrame) -> DataFrame:
    """Highest kind ever seen of each metric of a run: CDN < numeric < text. A plain partial aggregate over all versions."""
    code = F.when(F.col("value").isNotNull(), NUMERIC).when(F.col("cdn_key").isNotNull(), CDN).otherwise(TEXT)
    return points.groupBy("project_id", "run_id", "metric_name").agg(F.max(code).alias("type_code"))


def reconcile(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry rows to store, and those that can't be stored; an unknown type code is an error."""
    checked = found.withColumn("type_code", F.when(F.col("type_code").isin(CDN, NUMERIC, TEXT), F.col("type_code")).otherwise(F.raise_error(F.concat(F.lit("unknown type code "), F.col("type_code").cast("string"))).cast("int")))
    bad = bad_text("project_id", 256) | bad_text("run_id", 256) | bad_text("metric_name", 2048)
    return checked.where(~bad), checked.where(bad)


def run_set_metrics(found: DataFrame, runs: list[str]) -> DataFrame:
    return found.where(F.col("run_id").isin(runs)).groupBy("metric_name").agg(F.max("type_code").alias("type_code")).orderBy("metric_name")


def heartbeats(points: DataFrame) -> DataFrame:
    """Latest main and system time of each run; text and ``system/`` metrics are system."""
    system = F.col("text_data").isNotNull() | F.col("metric_name").startswith("system/")
    return points.groupBy("project_id", "run_id").agg(F.max(F.when(~system, F.col("timestamp_ms"))).alias("last_main_ms"), F.max(F.when(system, F.col("timestamp_ms"))).alias("last_system_ms"))


def known_runs(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Registry rows of known runs; orphans are dropped."""
    return found.join(runs.select("project_id", "run_id").distinct(), ["project_id", "run_id"])


def id_conflicts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(F.countDistinct("project_id").alias("projects")).where("projects > 1")


def union_runs(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("project_id", "run_id")
    for t in tables[1:]:
        out = out.union(t.select("project_id", "run_id"))
    return out.distinct()


def filter_runs(runs: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of a run's name or id, or of its ordinal with an optional '#'; '#' alone narrows nothing."""
    t = text.strip().lower()
    held = [F.contains(F.lower("run_name"), F.lit(t)), F.contains(F.lower("run_id"), F.lit(t)), F.contains(F.col("ordinal").cast("string"), F.lit(t.removeprefix("#")))]
    return runs.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in held]))


def filter_panels(panels: DataFrame, text: str) -> DataFrame:
    t = F.lit(text.strip().lower())
    return panels.where(F.contains(F.lower("label"), t) | F.contains(F.lower("metric_name"), t))


#: Extensions under which files are stored.
EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "ico", "tiff", "json", "txt", "csv", "wav", "mp3", "mp4", "webm", "ogg", "pdf", "gz", "bin")


def is_media_key(key: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Four hexadecimal digits or more and an extension, in any case."""
    return F.coalesce(key.rlike(rf"^[0-9A-Fa-f]{{4,}}\.(?i:{'|'.join(extensions)})\z"), F.lit(False))


def readable_key(key: Column) -> Column:
    """Placeholders of uploads that aren't done read as null."""
    return F.when(~key.startswith("pending:"), key)


def firing_alerts(docs: DataFrame, body: str) -> DataFrame:
    """Firing alerts for users of monitoring replies: name, summary, class and since when, by name and class (none first).

    Fields that are no text read as empty, a class that is none as null; a reply without a list of alerts is an error."""
    v = F.try_parse_json(body)
    alerts = F.try_variant_get(v, "$.data.alerts", "array<variant>")
    told = docs.select(F.explode(F.coalesce(alerts, F.raise_error(F.lit("a reply has no data.alerts list")).cast("array<variant>"))).alias("a"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("a", path, "variant")) == "STRING", F.try_variant_get("a", path, "string"))
    rows = told.where((text("$.state") == "firing") & (text("$.labels.audience") == "user"))
    empty = lambda path: F.coalesce(text(path), F.lit(""))
    return rows.select(empty("$.labels.alertname").alias("name"), empty("$.annotations.summary").alias("summary"), text("$.labels.class").alias("class"), empty("$.activeAt").alias("active_at")).orderBy("name", F.asc_nulls_first("class"))


def previous_gap(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """``gap``: x less the x before it in its key, null at the first. Keys of any size are scanned in blocks."""
    return previous(df, by, [x], {"_was": F.col(x)}).withColumn("gap", F.col(x) - F.col("_was")).drop("_was")


def panels(found: DataFrame, natural: Column) -> DataFrame:
    """An automatic dashboard: a panel for each metric, sections by prefix, system and logs on relative time."""
    from ..functions.expressions import section

    s = section(F.col("metric_name"))
    late = (s == "system") | (s == "logs") | s.startswith("system/") | s.startswith("logs/")
    rows = found.groupBy("metric_name").agg(F.max("type_code").alias("type_code"))
    priority = F.when(s == "", 100).when(s.isin("info", "logs", "system"), -100).otherwise(0)
    return rows.select("metric_name", "type_code", s.alias("section"), priority.alias("priority"), F.when(late, "relative").otherwise("step").alias("axis"), natural.alias("sort_key"))
