"""Point tables: validation, newest versions, selection, tag groups and windows over series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import FLOAT_MAX, is_finite
from ..plans.scan import dealt, last_before, previous, running, undealt

KEY = ["project_id", "run_id", "metric_name", "tag", "step"]
SERIES = ["project_id", "run_id", "metric_name", "tag"]
RESERVED = "trash"
TS_MIN, TS_MAX = -200_000_000_000_000, 9_000_000_000_000_000


def bad_text(column: str, most: int) -> Column:
    """Whether a name can't be stored: over ``most`` bytes or with a NUL. Empty names can."""
    return (F.octet_length(column) > most) | F.contains(F.col(column), F.lit("\x00"))


def validate_points(df: DataFrame) -> DataFrame:
    """Adds ``reason``: null for a good point; a bad id refuses its batch, other reasons skip the point."""
    reason = (
        F.when(F.col("project_id") == RESERVED, "reserved project")
        .when(bad_text("project_id", 256), "bad project id")
        .when(bad_text("run_id", 256), "bad run id")
        .when(bad_text("metric_name", 2048), "bad metric name")
        .when((F.col("timestamp_ms") < TS_MIN) | (F.col("timestamp_ms") > TS_MAX), "timestamp out of range")
        .when(F.col("value").isNull() & F.col("cdn_key").isNull() & F.col("text_data").isNull(), "no payload")
    )
    return df.withColumn("reason", reason)


def repair_text(raw: Column) -> Column:
    """Text of bytes that may not be UTF-8, bad sequences replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def normalize_numeric(df: DataFrame, column: str, importing: bool = False) -> DataFrame:
    """``value`` (float) and ``refused``: a finite number past the float range is refused, or NaN when importing."""
    d = F.expr(f"try_cast({column} AS double)")
    over = is_finite(d) & (F.abs(d) > FLOAT_MAX)
    f = d.cast("float")
    return df.withColumn("value", F.when(over, F.lit(float("nan")).cast("float") if importing else F.lit(None).cast("float")).otherwise(f)).withColumn("refused", F.coalesce(over, F.lit(False)))


def latest(df: DataFrame, version: str = "inserted_at") -> DataFrame:
    """The newest version of each key, by one shuffle on the key: rows that can't be a task's newest of their key are dropped
    before it (Spark limits the ranked groups on both sides), so many versions of a key cost a row a task.

    Ties of the version go to the larger payload, so that the answer doesn't depend on the order of rows. Filters on the
    payload belong above this: a newer payload of another kind replaces the older."""
    rest = [c for c in ("value", "cdn_key", "text_data", "timestamp_ms") if c in df.columns]
    newest = Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in (version, *rest)])
    return df.select(*KEY, version, *rest).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def version_conflicts(df: DataFrame, version: str = "inserted_at") -> DataFrame:
    """Keys whose newest version stands in rows with different payloads."""
    payload = F.struct("value", "cdn_key", "text_data")
    top = Window.partitionBy(*KEY)
    newest = df.withColumn("_top", F.max(version).over(top)).where(F.col(version) == F.col("_top"))
    return newest.groupBy(*KEY).agg(F.countDistinct(payload).alias("payloads")).where("payloads > 1")


def kind(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.when(F.col("value").isNotNull(), "numeric").when(F.col("cdn_key").isNotNull(), "cdn").when(F.col("text_data").isNotNull(), "text"))


def select_series(df: DataFrame, project: str, runs: list[str], metric: str, steps: tuple[int, int] | None = None) -> DataFrame:
    """Project, runs, metric and inclusive step range: key columns only, so it may stand below ``latest`` and reach the scan."""
    out = df.where((F.col("project_id") == project) & F.col("run_id").isin(runs) & (F.col("metric_name") == metric))
    return out if steps is None else out.where(F.col("step").between(*steps))


def tag_groups(df: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Where a run's metric has tagged rows, its scalar rows are hidden; ``tags`` narrows tagged rows only. Which metrics have any
    is a pre-combined aggregate that joins back, so that no task takes a whole series."""
    keys = ["project_id", "run_id", "metric_name"]
    tagged = df.groupBy(*keys).agg(F.bool_or(F.col("tag") != "").alias("_tagged"))
    out = df.join(tagged, keys).where(~F.col("_tagged") | (F.col("tag") != ""))
    if tags:
        out = out.where((F.col("tag") == "") | F.col("tag").isin(tags))
    return out.select(*df.columns)


def series_labels(series: DataFrame) -> DataFrame:
    """What tells the series apart: run if all share the metric, metric if all share the run, else ``run/metric``. With a tag:
    the tag alone if they share both, ``run/tag``, ``metric_tag`` or ``run/metric_tag``."""
    same = series.agg((F.min("run_id") == F.max("run_id")).alias("_run"), (F.min("metric_name") == F.max("metric_name")).alias("_metric"))
    run, metric, tag = F.col("run_id"), F.col("metric_name"), F.col("tag")
    scalar = F.when(F.col("_metric"), run).when(F.col("_run"), metric).otherwise(F.concat_ws("/", run, metric))
    named = F.concat_ws("_", metric, tag)
    tagged = F.when(F.col("_metric"), F.when(F.col("_run"), tag).otherwise(F.concat_ws("/", run, tag))).otherwise(F.when(F.col("_run"), named).otherwise(F.concat_ws("/", run, named)))
    return series.crossJoin(F.broadcast(same)).withColumn("label", F.when(tag == "", scalar).otherwise(tagged)).drop("_run", "_metric")


def incremental(df: DataFrame, watermark, read_start) -> DataFrame:
    """Rows since a watermark, with a second of overlap; the next watermark stays 15 s behind the read's start."""
    return df.where((F.col("inserted_at") > F.lit(watermark) - F.expr("INTERVAL 1 SECOND")) & (F.col("inserted_at") <= F.lit(read_start)))


def watermark_of(newest: Column, read_start: Column) -> Column:
    return F.least(newest, read_start - F.expr("INTERVAL 15 SECONDS"))


def next_watermark(df: DataFrame, read_start) -> DataFrame:
    return df.agg(watermark_of(F.max("inserted_at"), F.lit(read_start)).alias("watermark"))


def smoothing_margin(algorithm: str, steps: tuple[int, int], tau: float = 10.0, window: int = 1, reach: tuple[float, float] = (0.0, 0.0)) -> tuple[int | None, int | None]:
    """Step range to read so that slots of ``steps`` have their smoother's samples; None is unbounded. ``reach``: what a chart's
    floor widens the smoother to, in x, at the first and the last step."""
    lo, hi = steps
    if algorithm == "ema":
        return lo - max(min(max(math.ceil(8 * tau), 1), 1_000_000), math.ceil(8 * reach[0])), hi
    if algorithm == "triangular":
        return None, hi
    if algorithm == "savgol":
        own = 4 * max(window, 3)
        return lo - max(own, math.ceil(max(reach[0], reach[1] - (hi - lo)))), hi + max(own, math.ceil(reach[1]))
    return lo, hi


def relative_time(df: DataFrame) -> DataFrame:
    """``x``: milliseconds since the series' first timestamp, which comes from a pre-combined aggregate, not a window."""
    first = df.groupBy(*SERIES).agg(F.min("timestamp_ms").alias("_first"))
    return df.join(first, SERIES).withColumn("x", F.col("timestamp_ms") - F.col("_first")).drop("_first")


def positive_gaps(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """by.., gap: positive differences of consecutive x of each series.

    A series is scanned in blocks of equal counts, whatever its density. Equal x give no gap, so each counts once."""
    once = df.select(*by, F.col(x).alias("_x")).where("_x IS NOT NULL").distinct()
    return previous(once, by, ["_x"], {"_was": F.col("_x")}).select(*by, (F.col("_x") - F.col("_was")).alias("gap")).where("gap > 0")


def median_gap(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Upper median of the positive gaps between consecutive x of each series (1 without any), and its rank counts: the gap
    at which a prefix sum over the counts of distinct gaps passes half."""
    counts = positive_gaps(df, x, by).groupBy(*by, "gap").agg(F.count(F.lit(1)).alias("equal"))
    whole = Window.partitionBy(*by).orderBy("gap")
    summed = counts.withColumns({"upto": F.sum("equal").over(whole), "total": F.sum("equal").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    found = summed.where("upto > total div 2 AND upto - equal <= total div 2").select(*by, F.col("gap").alias("median"), (F.col("upto") - F.col("equal")).alias("below"), "equal", "total")
    none = F.lit(0).cast("long")
    return df.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce(F.col("median").cast("double"), F.lit(1.0)).alias("median"), *[F.coalesce(c, none).alias(c) for c in ("below", "equal", "total")])


def counter_rates(df: DataFrame) -> DataFrame:
    """(value - previous) / seconds / 1e6 of counters; a reset or a standing clock gives no point."""
    told = previous(df, SERIES, ["timestamp_ms", "step"], {"_t": F.col("timestamp_ms"), "_v": F.col("value")})
    dt = (F.col("timestamp_ms") - F.col("_t")) / 1000.0
    dv = F.col("value").cast("double") - F.col("_v").cast("double")
    return told.withColumn("_dt", dt).withColumn("_dv", dv).where("_dt > 0 AND _dv >= 0").select(*SERIES, "step", "timestamp_ms", (F.col("_dv") / F.col("_dt") / 1e6).alias("rate"))


def history(df: DataFrame, metric: str) -> DataFrame:
    """All points of a metric by run, then tag (as text) and step."""
    return latest(df.where(F.col("metric_name") == metric)).where("value IS NOT NULL").orderBy("run_id", "tag", "step")


def row_hash(columns: list[str]) -> Column:
    """60 bits of the MD5 of the columns' texts, null told from empty: any engine can audit it."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Order-free content fingerprint of row sets: the sum of row hashes modulo 2^64."""
    total = F.sum(row_hash(columns).cast("decimal(38,0)"))
    return df.groupBy(*by).agg((F.pmod(total, F.lit("18446744073709551616").cast("decimal(38,0)"))).cast("decimal(20,0)").alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def monotone_steps(df: DataFrame, by: list[str], order: list[str], want: str) -> DataFrame:
    """step_i = max(want_i, step_(i-1) + 1) in closed form: row number plus the running maximum of want - row number."""
    placed = running(dealt(df, by, order), by, {"_n": ("sum", F.lit(1).cast("long"))})
    ahead = running(placed, by, {"_d": ("max", F.col(want) - F.col("_n"))})
    return undealt(ahead.withColumn("step", F.col("_n") + F.col("_d"))).drop("_n", "_d")


def fan_out(records: DataFrame, value: str = "record") -> DataFrame:
    """A step record (JSON text of metric -> scalar, list or media) -> points; list element i gets tag i. A finite number past
    the float range is refused: it gives no point."""
    keys = ["project_id", "run_id", "step", "timestamp_ms"]
    pairs = records.select(*keys, F.explode(F.from_json(F.col(value), "map<string,string>")).alias("metric_name", "raw"))
    listed = F.from_json("raw", "array<string>")
    items = pairs.select(*keys, "metric_name", F.posexplode_outer(F.when(F.col("raw").startswith("["), listed)).alias("i", "item"), "raw")
    cell = F.coalesce("item", F.when(~F.col("raw").startswith("["), F.col("raw")))
    d = F.expr("try_cast(cell AS double)")
    out = items.withColumn("cell", cell).where(F.col("cell").isNotNull() & ~F.coalesce(is_finite(d) & (F.abs(d) > FLOAT_MAX), F.lit(False)))
    media = F.get_json_object("cell", "$.media")
    return out.select(*keys, "metric_name", F.coalesce(F.col("i").cast("string"), F.lit("")).alias("tag"), d.cast("float").alias("value"), media.alias("cdn_key"), F.when(d.isNull() & media.isNull(), F.col("cell")).alias("text_data"))


def write_points(df: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by project; tasks hold ranges of the key, so that a hot run is many files, and files are sorted by key, so
    that row-group statistics prune runs, metrics and steps."""
    df.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.mode(mode).partitionBy("project_id").parquet(path)


def replay(batches: DataFrame) -> DataFrame:
    """Point batches that came late, twice or out of order, as if they had come in causal order: by the time they were made,
    the phase (worker, salvage, other) and the place in the batch. ``batches``: points with created_ns, phase, position."""
    ranked = batches.withColumn("_cause", F.struct("created_ns", F.when(F.col("phase") == "worker", 0).when(F.col("phase") == "salvage", 1).otherwise(2).alias("phase"), "position"))
    return latest(ranked, "_cause").drop("_cause")


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it (null without one): a union and a scan in blocks, so
    that a key may be of any size. Right rows with equal ``on`` are taken by their values. Keys mustn't be null."""
    a = left.select(*by, F.col(on).alias("_on"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_r"))
    b = right.select(*by, F.col(on).alias("_on"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    # at equal places right rows come first, in order of their values
    both = a.unionAll(b).withColumn("_late", F.col("_l").isNotNull())
    found = last_before(dealt(both, by, ["_on", "_late", "_r"]), by, {"_v": F.col("_r")}).where("_late")
    return found.select("_l.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, by: list[str], on: str, reach: float, most: int = 100_000) -> DataFrame:
    """Pairs with abs(left.on - right.on) <= reach, by cells of that width: a left row meets its own cell and the two next to it.

    Cells of more than ``most`` right rows are dealt into parts of about that many by a hash of the row, and left rows meet each
    part, so a stretch that holds half of all samples is many groups."""
    cell = F.floor(F.col(on) / reach)
    keys = [*by, "_cell"]
    b = right.select(*by, cell.alias("_cell"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    dense = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.xxhash64(*[F.col(c) for c in b.columns if c not in keys])
    b = b.join(dense, keys, "left").withColumn("_part", F.pmod(salt, parts).cast("int")).drop("_parts")
    a = left.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1))).join(dense, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [*keys, "_part"]).where(F.abs(F.col(on) - F.col(f"r_{on}")) <= reach).drop("_cell", "_part")


def read_points(spark, path: str, project: str) -> DataFrame:
    """A project's points: other projects' folders are never listed."""
    return spark.read.parquet(path).where(F.col("project_id") == project)


def log_domain(df: DataFrame, x: str, custom: bool) -> DataFrame:
    """``plottable`` on a log axis: a step or time from 0, another metric's value above 0."""
    return df.withColumn("plottable", F.col(x) > 0 if custom else F.col(x) >= 0)
