"""Queries that run a stream over the tables to its end (``availableNow``) and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import points as P
from ..plans.scratch import shared_root
from ..sources import adapters as A
from ..streaming import feed as W
from ..streaming import ingest as N
from ..streaming import state as S
from ..streaming import store as T
from .common import DENSE, LATEST, POINTS, registry

ALL, query = registry()


def _root(spark) -> str:
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    """The events table as a stream of files."""
    return N.source(spark, A.table(spark, sf_dir, "events").schema, f"{sf_dir}/events.parquet*")


def _points(e):
    odd = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 101 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    none = F.lit(None).cast("string")
    return e.select(
        F.lit("events").alias("project_id"), F.concat(F.lit("run"), (F.col("user_id") % 8).cast("string")).alias("run_id"), F.col("event_type").alias("metric_name"), F.lit("").alias("tag"), F.col("event_id").alias("step"),
        A.epoch_ms("ts").alias("timestamp_ms"), odd.cast("float").alias("value"), none.alias("cdn_key"), none.alias("text_data"), F.col("ts").cast("timestamp").alias("inserted_at"),
    )


def _ingested(spark, sf_dir) -> str:
    root = _root(spark)
    N.start(_points(_events(spark, sf_dir)), root, None).awaitTermination()
    return root


@query("SRC_5_SM_1_ingest", f"WITH {POINTS} SELECT run_id, metric_name, count(*) AS n, max(step) AS last_step, 4 AS cuts FROM points GROUP BY ALL")
def ingest(spark, sf_dir):
    """The table as four files, each of which passes the bytes of a cut: four micro-batches, each a folder of its own."""
    root = _root(spark)
    e = A.table(spark, sf_dir, "events")
    e.repartition(4).write.option("parquet.block.size", 1 << 20).parquet(f"{root}/in")  # row groups that tasks can share
    N.start(_points(N.source(spark, e.schema, f"{root}/in", cut_bytes=1)), root, None).awaitTermination()
    got = N.read(spark, root, "points")
    cuts = got.select("batch").distinct().agg(F.count(F.lit(1)).cast("int").alias("cuts"))
    return got.groupBy("run_id", "metric_name").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last_step")).crossJoin(F.broadcast(cuts))


@query("SRC_6_SM_1_AG_1_point_store", f"WITH {LATEST} SELECT project_id, run_id, metric_name, count(*) AS n, count(value) AS numbers, round(sum(value::DOUBLE), 2) AS total FROM latest GROUP BY ALL")
def point_store(spark, sf_dir):
    """Points come in three batches, the second twice; a project is compacted between and both behind them."""
    d = A.dense_points(spark, sf_dir)
    s = T.PointStore(spark, _root(spark))
    for k in (0, 1, 1, 2):
        s.append(d.where(F.pmod("timestamp_ms", F.lit(3)) == k), k)
        if k == 1:
            s.compact("p0")
    for p in ("p0", "p1"):
        s.compact(p)
    return s.snapshot().newest().groupBy("project_id", "run_id", "metric_name").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("numbers"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


@query("RN_6_lasting_purge", f"WITH {LATEST} SELECT project_id, run_id, count(*) AS n FROM latest WHERE run_id NOT IN ('s3', 's4') GROUP BY ALL")
def lasting_purge(spark, sf_dir):
    """Two runs are purged between two batches; the second holds late rows of them, which stay away."""
    d = A.dense_points(spark, sf_dir)
    s = T.PointStore(spark, _root(spark))
    s.append(d.where("step % 2 = 0"), 0)
    s.purge(d.where("run_id IN ('s3', 's4')").select("project_id", "run_id").distinct())
    s.append(d.where("step % 2 = 1"), 1)
    return s.snapshot().newest().groupBy("project_id", "run_id").agg(F.count(F.lit(1)).alias("n"))


@query("SM_4_rollup", f"""WITH {POINTS} SELECT run_id, metric_name, step // 64 AS cell, count(*) FILTER (isfinite(value)) AS n, round(sum(value::DOUBLE) FILTER (isfinite(value)), 4) AS total, min(value::DOUBLE) FILTER (isfinite(value)) AS y_min,
  max(value::DOUBLE) FILTER (isfinite(value)) AS y_max FROM points GROUP BY ALL""")
def rollup(spark, sf_dir):
    """The finest tier as streamed, merged into cells of 64 steps."""
    return N.merged(N.read(spark, _ingested(spark, sf_dir), "rollup"), 64 // N.WIDTH).select("run_id", "metric_name", "cell", "n", F.round("total", 4).alias("total"), "y_min", "y_max")


@query("SM_7_registry", f"WITH {POINTS} SELECT run_id, metric_name, 2 AS type_code FROM points GROUP BY ALL")
def stream_registry(spark, sf_dir):
    return N.read_registry(spark, _ingested(spark, sf_dir)).select("run_id", "metric_name", "type_code")


@query("SM_7_heartbeats", f"WITH {POINTS} SELECT run_id, max(timestamp_ms) AS last_main_ms FROM points GROUP BY ALL")
def stream_heartbeats(spark, sf_dir):
    return N.read_heartbeats(spark, _ingested(spark, sf_dir)).select("run_id", "last_main_ms")


@query(
    "SM_8_change_feed",
    """WITH RECURSIVE e AS (SELECT 'run' || (user_id % 8) AS run_id, epoch_us(ts) // 1000 AS moment, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS v FROM events),
  c AS (SELECT run_id, moment, max(v) AS v, row_number() OVER (PARTITION BY run_id ORDER BY moment) AS n FROM e GROUP BY run_id, moment),
  f AS (SELECT run_id, n, moment, v AS sent, moment AS sent_at, v AS waiting, NULL::BIGINT AS timed, NULL::BIGINT AS timed_at, true AS now FROM c WHERE n = 1 UNION ALL
    SELECT run_id, n, moment, CASE WHEN moment >= at2 + 3600000 THEN v ELSE sent2 END, CASE WHEN moment >= at2 + 3600000 THEN moment ELSE at2 END, v, CASE WHEN due THEN sent2 END, CASE WHEN due THEN at2 END, moment >= at2 + 3600000
    FROM (SELECT c.run_id, c.n, c.moment, c.v, f.waiting > f.sent AND c.moment > f.sent_at + 3600000 AS due, CASE WHEN f.waiting > f.sent AND c.moment > f.sent_at + 3600000 THEN f.waiting ELSE f.sent END AS sent2,
      CASE WHEN f.waiting > f.sent AND c.moment > f.sent_at + 3600000 THEN f.sent_at + 3600000 ELSE f.sent_at END AS at2 FROM f JOIN c ON c.run_id = f.run_id AND c.n = f.n + 1))
  SELECT run_id, sent::BIGINT AS version, sent_at AS at_ms FROM f WHERE now UNION ALL SELECT run_id, timed::BIGINT, timed_at FROM f WHERE timed IS NOT NULL
  UNION ALL SELECT run_id, waiting::BIGINT, sent_at + 3600000 FROM f QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC) = 1 AND waiting > sent AND sent_at + 3600000 < max(moment) OVER ()""",
)
def feed(spark, sf_dir):
    """Every event is a version of its run; a listener gets a frame an hour at most, by the events' own time, from a stream of
    many micro-batches. The SQL takes the changes one by one."""
    root = _root(spark)
    e = _points(A.table(spark, sf_dir, "events"))
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("inserted_at", "step"))
    changes = e.select("run_id", nth.cast("long").alias("version"), F.col("inserted_at").alias("event_time"))
    for week in range(5):  # files in order of time, as they would come
        changes.where(F.expr("(dayofyear(event_time) - 1) div 7") == week if week < 4 else F.expr("(dayofyear(event_time) - 1) div 7 >= 4")).coalesce(1).write.parquet(f"{root}/in/{week}")
    s = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    feeds = W.frames(s, every_ms=3_600_000, forget_ms=10**12, watermark="0 seconds")
    feeds.writeStream.format("parquet").option("path", f"{root}/feed").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/feed")


@query(
    "SM_3_routes",
    f"""WITH {DENSE}, m AS (SELECT project_id, run_id, metric_name, tag, max(step) AS high_step, max(inserted_ms) AS newest FROM dense WHERE step < 500 GROUP BY ALL)
  SELECT CASE WHEN value IS NULL THEN 'tombstone' WHEN high_step IS NULL THEN 'append' WHEN step <= high_step THEN 'rewrite' WHEN inserted_ms <= newest THEN 'late' ELSE 'append' END AS route, count(*) AS n
  FROM dense LEFT JOIN m USING (project_id, run_id, metric_name, tag) WHERE step >= 490 GROUP BY ALL""",
)
def routes(spark, sf_dir):
    d = A.dense_points(spark, sf_dir)
    marks = d.where("step < 500").groupBy("project_id", "run_id", "metric_name", "tag").agg(F.max("step").alias("high_step"), F.max("inserted_at").alias("newest"))
    return N.classify(d.where("step >= 490"), marks).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("SM_3_recompute", f"""WITH {DENSE}, l AS (SELECT * FROM dense QUALIFY row_number() OVER (PARTITION BY project_id, run_id, metric_name, tag, step ORDER BY inserted_ms DESC, value DESC NULLS LAST, cdn_key DESC NULLS LAST, text_data DESC NULLS LAST) = 1)
  SELECT run_id, metric_name, tag, step // 4 AS cell, count(value) AS n, max(value::DOUBLE) AS y_max FROM l WHERE step // 4 IN (SELECT step // 4 FROM dense d WHERE step % 97 = 5 AND d.run_id = l.run_id AND d.metric_name = l.metric_name AND d.tag = l.tag) AND value IS NOT NULL GROUP BY ALL""")
def recompute(spark, sf_dir):
    d = A.dense_points(spark, sf_dir)
    return N.recompute(d, d.where("step % 97 = 5")).select("run_id", "metric_name", "tag", "cell", "n", "y_max")


@query("SM_5_smoother_state", f"""WITH {POINTS}, s AS (SELECT run_id, metric_name, step, value::DOUBLE AS y FROM points WHERE isfinite(value))
  SELECT a.run_id, a.metric_name, a.step, round(sum(exp(-(a.step - b.step) / 50.0) * b.y) / sum(exp(-(a.step - b.step) / 50.0)), 6) AS smoothed FROM s a JOIN s b ON a.run_id = b.run_id AND a.metric_name = b.metric_name AND b.step <= a.step GROUP BY ALL""")
def smoother(spark, sf_dir):
    root = _root(spark)
    p = _points(_events(spark, sf_dir)).select("project_id", "run_id", "metric_name", "tag", "step", F.col("value").cast("double").alias("value"))
    S.ema(p, 50.0).writeStream.format("parquet").option("path", f"{root}/ema").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/ema").select("run_id", "metric_name", "step", F.round("smoothed", 6).alias("smoothed"))


@query("SM_2_6_liveness", f"""WITH {POINTS}, t AS (SELECT run_id, timestamp_ms AS moment, lag(timestamp_ms) OVER (PARTITION BY run_id ORDER BY timestamp_ms) AS was FROM points),
  e AS (SELECT run_id, max(moment) AS last, (SELECT max(moment) - 5000 FROM t) AS mark FROM t GROUP BY run_id)
  SELECT run_id, was + 10000 AS at_ms, 'unresponsive' AS status FROM t WHERE moment - was >= 10000 UNION ALL SELECT run_id, was + 600000, 'presumed dead' FROM t WHERE moment - was >= 600000
  UNION ALL SELECT run_id, moment, 'running' FROM t WHERE was IS NULL OR moment - was >= 10000 UNION ALL SELECT run_id, last + 10000, 'unresponsive' FROM e WHERE last + 10000 <= mark""")
def live(spark, sf_dir):
    """Until the watermark, five seconds behind the newest event, has passed."""
    root = _root(spark)
    p = _points(_events(spark, sf_dir)).select("run_id", F.col("inserted_at").alias("event_time"))
    S.liveness(p).writeStream.format("parquet").option("path", f"{root}/live").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/live")


@query("SM_2_watermark", f"""WITH {POINTS}, d AS (SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * i AS start FROM generate_series(1, 31) t(i))
  SELECT epoch_ms(start) AS start_ms, epoch_us(least((SELECT max(inserted_at) FROM points WHERE inserted_at <= start), start - INTERVAL 15 SECOND)) // 1000 AS watermark_ms FROM d WHERE EXISTS (SELECT 1 FROM points WHERE inserted_at <= start)""")
def watermarks(spark, sf_dir):
    """The next watermark of a read that starts at each of the days."""
    days = spark.sql("SELECT explode(sequence(timestamp'2024-01-02', timestamp'2024-02-01', INTERVAL 1 DAY)) AS start")
    per_day = A.points(spark, sf_dir).groupBy(F.date_trunc("day", F.col("inserted_at") - F.expr("INTERVAL 1 MICROSECOND")).alias("day")).agg(F.max("inserted_at").alias("newest"))
    seen = days.join(F.broadcast(per_day), F.col("day") < F.col("start")).groupBy("start").agg(F.max("newest").alias("newest"))
    return seen.select(F.unix_millis("start").alias("start_ms"), F.unix_millis(P.watermark_of(F.col("newest"), F.col("start"))).alias("watermark_ms"))
