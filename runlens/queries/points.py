"""Queries over point tables: sources, filters, newest versions, registries, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import points as P
from ..operators import registry as R
from ..sources import adapters as A
from ..sources import imports as I
from .common import DENSE, LATEST, POINTS, registry

ALL, query = registry()

_TEST_POINTS = """v AS (SELECT CASE WHEN step % 41 = 0 THEN 'trash' WHEN step % 43 = 0 THEN 'a' || chr(0) WHEN step % 37 = 0 THEN '' ELSE project_id END AS project_id, run_id,
  CASE WHEN step % 47 = 0 THEN repeat('m', 3000) ELSE metric_name END AS metric_name, tag, step, CASE WHEN step % 53 = 0 THEN 9100000000000000 ELSE timestamp_ms END AS timestamp_ms,
  CASE WHEN step % 59 = 0 THEN NULL ELSE value END AS value FROM points)"""


@query(
    "SRC_1_validate_points",
    f"""WITH {POINTS}, {_TEST_POINTS} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN project_id = 'trash' THEN 'reserved project' WHEN contains(project_id, chr(0)) THEN 'bad project id'
  WHEN length(metric_name) > 2048 THEN 'bad metric name' WHEN timestamp_ms > 9000000000000000 THEN 'timestamp out of range' WHEN value IS NULL THEN 'no payload' END AS reason FROM v) GROUP BY reason""",
)
def validate(spark, sf_dir):
    """Names with a NUL are refused; empty ones are stored."""
    s = F.col("step")
    p = A.points(spark, sf_dir).withColumns(
        {
            "project_id": F.when(s % 41 == 0, "trash").when(s % 43 == 0, "a\x00").when(s % 37 == 0, "").otherwise(F.col("project_id")),
            "metric_name": F.when(s % 47 == 0, F.repeat(F.lit("m"), 3000)).otherwise(F.col("metric_name")),
            "timestamp_ms": F.when(s % 53 == 0, 9_100_000_000_000_000).otherwise(F.col("timestamp_ms")),
            "value": F.when(s % 59 != 0, F.col("value")),
        }
    )
    return P.validate_points(p).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SRC_2_repair_text", "SELECT doc_id, length(text) + 1 AS n_chars FROM documents")
def repair(spark, sf_dir):
    """Texts with a broken byte put in front: it reads as one replacement character."""
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(P.repair_text(F.concat(F.lit(bytearray(b"\xff")), F.col("text").cast("binary")))).cast("long").alias("n_chars"))


@query(
    "SRC_3_normalize_numeric",
    """SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN NULL WHEN p_partkey % 10 = 4 THEN NULL ELSE p_retailprice::FLOAT END::DOUBLE AS value, p_partkey % 10 = 3 AS refused FROM part""",
)
def numeric(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 10 == 3, "3.5e38").when(F.col("p_partkey") % 10 == 4, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    return P.normalize_numeric(A.table(spark, sf_dir, "part").withColumn("raw", raw), "raw").select("p_partkey", F.col("value").cast("double").alias("value"), "refused")


@query(
    "SRC_4_fan_out",
    """SELECT o_orderkey AS step, metric_name, tag, value, text_data FROM (
  SELECT o_orderkey, 'loss' AS metric_name, '' AS tag, o_totalprice::FLOAT::DOUBLE AS value, NULL::VARCHAR AS text_data FROM orders
  UNION ALL SELECT o_orderkey, 'pair', '0', (o_orderkey % 7)::DOUBLE, NULL FROM orders UNION ALL SELECT o_orderkey, 'pair', '1', (o_orderkey % 3)::DOUBLE, NULL FROM orders
  UNION ALL SELECT o_orderkey, 'note', '', NULL, 'status ' || o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'wide', '', 1e38::FLOAT::DOUBLE, NULL FROM orders WHERE o_orderkey % 4 <> 0)""",
)
def fan_out(spark, sf_dir):
    """A finite number past the float range gives no point."""
    k = F.col("o_orderkey")
    rec = F.to_json(F.struct(F.col("o_totalprice").alias("loss"), F.array(k % 7, k % 3).alias("pair"), F.concat(F.lit("status "), "o_orderstatus").alias("note"), F.when(k % 4 == 0, 3.5e38).otherwise(1e38).alias("wide")))
    o = A.table(spark, sf_dir, "orders").select(F.lit("p").alias("project_id"), F.lit("r").alias("run_id"), k.alias("step"), F.lit(0).cast("long").alias("timestamp_ms"), rec.alias("record"))
    return P.fan_out(o).select("step", "metric_name", "tag", F.col("value").cast("double").alias("value"), "text_data")


@query(
    "SRC_7_series_read",
    f"""WITH {LATEST} SELECT run_id, tag, step, value::DOUBLE AS value, cdn_key, text_data FROM latest WHERE project_id = 'p1' AND run_id IN ('s1', 's3', 's5') AND metric_name = 'flag/A'""",
)
def series_read(spark, sf_dir):
    sel = P.select_series(A.dense_points(spark, sf_dir), "p1", ["s1", "s3", "s5"], "flag/A")
    return P.latest(sel).orderBy("run_id", "tag", "step").select("run_id", "tag", "step", F.col("value").cast("double").alias("value"), "cdn_key", "text_data")


@query(
    "SRC_8_incremental_read",
    f"""WITH {POINTS}, r AS (SELECT * FROM points WHERE inserted_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 SECOND AND inserted_at <= TIMESTAMP '2024-01-25 00:00:00')
  SELECT run_id, count(*) AS n, max(step) AS last_step, (SELECT epoch_us(least(max(inserted_at), TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 15 SECOND)) // 1000 FROM r) AS watermark_ms FROM r GROUP BY run_id""",
)
def incremental(spark, sf_dir):
    """Rows since a watermark, and the next one."""
    ts = lambda t: F.to_timestamp(F.lit(t))
    start = ts("2024-01-25 00:00:00")
    fresh = P.incremental(A.points(spark, sf_dir), ts("2024-01-20 00:00:00"), start)
    mark = P.next_watermark(fresh, start).select(F.unix_millis("watermark").alias("watermark_ms"))
    return fresh.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last_step")).crossJoin(F.broadcast(mark))


@query(
    "SRC_9_unpivot_history",
    """WITH w AS (SELECT 'c' || (o_custkey % 20) AS run_id, o_orderkey AS k, o_orderkey AS step, epoch_ms(o_orderdate) AS moment, o_totalprice AS total, (o_custkey % 9)::DOUBLE AS grp, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus ELSE '' END AS note FROM orders),
  t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY k) AS n FROM w WHERE note <> '')
  SELECT run_id, metric_name, step, timestamp_ms, value::FLOAT::DOUBLE AS value, NULL::VARCHAR AS text_data FROM (SELECT run_id, step, moment AS timestamp_ms, total, grp FROM w) UNPIVOT (value FOR metric_name IN (total, grp))
  UNION ALL SELECT run_id, 'note', (n + max(moment - n) OVER (PARTITION BY run_id ORDER BY k))::BIGINT, moment, NULL, note || chr(10) FROM t""",
)
def unpivot(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    wide = o.select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")).alias("run_id"), k.alias("k"), k.alias("_step"), (A.epoch_ms("o_orderdate") / 1000).alias("_timestamp"), F.col("o_totalprice").alias("total"),
        (F.col("o_custkey") % 9).cast("double").alias("grp"), F.when(k % 5 > 0, F.col("o_orderstatus")).otherwise("").alias("note"),
    )
    return I.unpivot_history(wide, 0, ["k"]).select("run_id", "metric_name", "step", "timestamp_ms", F.col("value").cast("double").alias("value"), "text_data")


@query("SRC_10_column_kinds", """SELECT * FROM (SELECT 'o_orderkey' AS "column", 'numeric' AS kind, count(o_orderkey) AS cells FROM orders UNION ALL SELECT 'o_custkey', 'numeric', count(o_custkey) FROM orders
  UNION ALL SELECT 'o_orderstatus', 'text', count(o_orderstatus) FROM orders UNION ALL SELECT 'o_totalprice', 'numeric', count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', 'unsupported', count(o_orderdate) FROM orders
  UNION ALL SELECT 'o_orderpriority', 'text', count(o_orderpriority) FROM orders UNION ALL SELECT 'note', 'struct', count(*) FROM orders UNION ALL SELECT '_odd', 'skipped', count(*) FILTER (o_orderkey % 3 = 0) FROM orders)""")
def kinds(spark, sf_dir):
    """Each column's kind, and how many of its cells hold something."""
    o = A.table(spark, sf_dir, "orders").withColumn("note", F.struct("o_orderkey")).withColumn("_odd", F.when(F.col("o_orderkey") % 3 == 0, 1))
    found = I.column_kinds(o.schema)
    cells = o.agg(*[F.count(c).alias(c) for c in found])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).alias("cells")) for c, k in found.items()])).alias("p")
    return cells.select(pairs).select("p.*")


@query(
    "SRC_11_row_axes",
    """SELECT run_id, l_orderkey, coalesce(_step, row_number() OVER (PARTITION BY run_id ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) AS step,
  coalesce(CASE WHEN l_linenumber % 2 = 0 THEN epoch_ms(l_shipdate) END, 1000) AS timestamp_ms FROM (
  SELECT *, 'u' || (l_suppkey % 5) AS run_id, CASE WHEN l_suppkey % 2 = 0 THEN l_orderkey END AS _step FROM lineitem)""",
)
def row_axes(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    rows = li.withColumn("run_id", F.concat(F.lit("u"), (F.col("l_suppkey") % 5).cast("string"))).withColumn("_step", F.when(F.col("l_suppkey") % 2 == 0, F.col("l_orderkey")))
    rows = rows.withColumn("_timestamp", F.when(F.col("l_linenumber") % 2 == 0, A.epoch_ms("l_shipdate") / 1000.0))
    return I.row_axes(rows, ["run_id"], ["l_orderkey", "l_linenumber", "l_partkey"], 1000).select("run_id", "l_orderkey", "step", "timestamp_ms")


@query(
    "SRC_12_jsonl_history",
    """WITH o AS (SELECT 'r' || (o_custkey % 5) AS run_id, o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey ELSE 0 END AS step, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 10 * 1000 ELSE 5000 END AS t FROM orders WHERE o_orderkey % 17 <> 0),
  w AS (SELECT *, n0 + max(t - n0) OVER (PARTITION BY run_id ORDER BY k) AS landed FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY k) AS n0 FROM o WHERE s <> 'P')),
  n AS (SELECT run_id, step, t, 'loss' AS metric_name, p AS d FROM o UNION ALL SELECT run_id, step, t, 'wide', CASE WHEN k % 5 = 0 THEN 'nan'::DOUBLE ELSE 1e38 END FROM o UNION ALL SELECT run_id, step, t, 'odd', CASE WHEN k % 7 = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END FROM o
    UNION ALL SELECT run_id, step, t, 'flag', (k % 4 = 0)::INT FROM o UNION ALL SELECT run_id, step, t, 'mixed', k % 9 FROM o WHERE k % 4 <> 1 UNION ALL SELECT run_id, step, t, 'sum/max', p FROM o UNION ALL SELECT run_id, step, t, 'sum/neg_inf', 'inf'::DOUBLE FROM o)
  SELECT run_id, step, t AS timestamp_ms, metric_name, d::FLOAT::DOUBLE AS value, NULL AS text_data FROM n UNION ALL SELECT run_id, landed, t, 'note', NULL, 'NaN, "' || s || chr(10) FROM w""",
)
def jsonl(spark, sf_dir):
    """Lines with all kinds of cells: numbers past the float range, bare NaN and infinities (also inside a text, where they
    stay), booleans, unions with numbers, texts and no number, statistics, media, histograms, lists, empty texts."""
    k = F.col("o_orderkey")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    note = F.to_json(F.array(F.concat(F.lit('NaN, "'), F.col("o_orderstatus"))))
    cells = {
        "loss": F.col("o_totalprice").cast("string"), "wide": F.when(k % 5 == 0, "3.5e38").otherwise("1e38"), "odd": F.when(k % 7 == 0, "-Infinity").otherwise("NaN"), "flag": F.when(k % 4 == 0, "true").otherwise("false"),
        "mixed": F.when(k % 4 == 0, F.concat(F.lit('{"_type_a":null,"_type_b":'), text((k % 9).cast("string")), F.lit("}"))).when(k % 4 == 1, '{"_type_a":"word"}').otherwise(F.concat(F.lit('{"_type_a":'), (k % 9).cast("string"), F.lit("}"))),
        "sum": F.concat(F.lit('{"Max":'), F.col("o_totalprice").cast("string"), F.lit(',"-Inf":Infinity,"Min":"x"}')), "media": F.lit('{"_type":"image-file","path":"a.png"}'), "hist": F.lit('{"_type":"histogram","bins":[1]}'), "list": F.lit("[1,2]"), "nothing": F.lit("null"), "empty": F.lit('""'),
        "note": F.when(F.col("o_orderstatus") != "P", F.substr(note, F.lit(2), F.length(note) - 2)),
    }
    pairs = [F.when(k % 2 == 1, F.concat(F.lit('"_step":'), k.cast("string"))), F.when(k % 3 == 0, F.concat(F.lit('"_timestamp":'), F.expr("CAST(o_orderkey div 10 AS string)"))), *[F.concat(F.lit(f'"{n}":'), c) for n, c in cells.items()]]
    line = F.when(k % 17 == 0, F.when(k % 2 == 0, "{broken").otherwise("[NaN]")).when(k.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")))
    # lines cost far more to make and parse than to read, so the few splits of the table are dealt anew
    orders = A.table(spark, sf_dir, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), k)
    o = orders.select(F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string")).alias("run_id"), k.alias("n"), line.alias("line"))
    return I.jsonl_points(o, ["run_id"], ["n"], 5000).select("run_id", "step", "timestamp_ms", "metric_name", F.col("value").cast("double").alias("value"), "text_data")


@query(
    "SRC_13_struct_cells",
    """SELECT metric_name, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT 'price/min' AS metric_name, l_discount AS value FROM lineitem UNION ALL SELECT 'price/neg_inf', l_tax FROM lineitem
  UNION ALL SELECT 'mixed', l_quantity FROM lineitem WHERE l_linenumber % 3 = 0 UNION ALL SELECT 'mixed', l_linenumber FROM lineitem WHERE l_linenumber % 3 = 1) GROUP BY metric_name
  UNION ALL SELECT 'texts_skipped', count(*), 0 FROM lineitem WHERE l_linenumber % 3 = 2 UNION ALL SELECT 'histograms_skipped', count(*), 0 FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT 'stats_expanded', count(*), 0 FROM lineitem""",
)
def struct_cells(spark, sf_dir):
    n = F.col("l_linenumber")
    li = A.table(spark, sf_dir, "lineitem").select(
        F.struct(F.col("l_discount").alias("Min"), F.col("l_tax").alias("-Inf")).alias("price"),
        F.struct(F.when(n % 3 == 1, n).alias("_type_int64"), F.when(n % 3 == 0, F.col("l_quantity").cast("string")).when(n % 3 == 2, "n/a").alias("_type_utf8")).alias("mixed"),
        F.struct(F.when(n % 2 == 0, "histogram").otherwise("image-file").alias("_type"), F.array(F.lit(1)).alias("bins")).alias("media"),
    )
    counts = I.struct_counts(li)
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("metric_name"), F.col(c).alias("n"), F.lit(0.0).alias("total")) for c in counts.columns])).alias("c")
    return I.struct_points(li).groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).unionAll(counts.select(told).select("c.*"))


@query(
    "SRC_14_media_items",
    """WITH p AS (SELECT page_id, page_id::VARCHAR AS k, page_id % 5 AS kind FROM pages)
  SELECT page_id, i, 'files/' || k || '_' || i || '.png' AS filename, CASE i WHEN 0 THEN 'shot' WHEN 1 THEN 'True' ELSE '' END AS caption, 'png' AS extension FROM p, (VALUES (0), (1), (2)) v(i) WHERE kind = 0
  UNION ALL SELECT page_id, 0, 'files/' || k || '.mp4', 'a b', 'mp4' FROM p WHERE kind = 1
  UNION ALL SELECT page_id, i, 'files/' || k || '/' || i || '.html', '', 'bin' FROM p, (VALUES (0), (1)) v(i) WHERE kind = 2
  UNION ALL SELECT page_id, i, 'media/images/loss_' || k || '_' || i || '.jpg', CASE i WHEN 0 THEN 'first' ELSE '' END, 'jpg' FROM p, (VALUES (0), (1)) v(i) WHERE kind = 3""",
)
def media_items(spark, sf_dir):
    """Cells of four kinds: listed files, one file, a list of cells, a count; and files outside the run's folder."""
    p = A.table(spark, sf_dir, "pages")
    k = F.col("page_id").cast("string")
    kind = F.col("page_id") % 5
    cell = (
        F.when(kind == 0, F.concat(F.lit('{"_type": "images/separated", "filenames": ['), *[F.concat(F.lit(f'{"," if i else ""}"files/'), k, F.lit(f'_{i}.png"')) for i in range(3)], F.lit('], "captions": ["shot", true]}')))
        .when(kind == 1, F.concat(F.lit('{"_type": "video-file", "path": "files/'), k, F.lit('.mp4", "caption": ["a", null, "b"]}')))
        .when(kind == 2, F.concat(F.lit('{"_type": "html", "count": 2, "html": [{"path": "files/'), k, F.lit('/0.html"}, {"path": "files/'), k, F.lit('/1.html"}]}')))
        .when(kind == 3, F.lit('{"_type": "images", "count": 2, "format": "JPG", "captions": ["first"]}'))
        .otherwise(F.lit('{"_type": "image-file", "path": "../outside.png"}'))
    )
    found = I.media_items(p.select("page_id", cell.alias("cell"), F.lit("loss").alias("metric"), F.col("page_id").alias("step")), ["page_id"], "cell", "metric", "step")
    return found.select("page_id", F.col("i").cast("int").alias("i"), "filename", "caption", "extension")


_SYSTEM = (
    ("system.gpu.3.temp", "system/gpu_temp_c", "3"), ("system.gpu.0.memoryAllocated", "system/gpu_mem_used_pct", "0"), ("system.gpu.1.oddThing", "system/gpu_odd_thing", "1"), ("system.gpu.process.2.memory", "system/gpu_proc_mem_util_pct", "2"),
    ("system.gpu.process.2.newKey", "system/gpu_proc_new_key", "2"), ("system.cpu.11.cpu_percent", "system/cpu_core_pct", "11"), ("system.cpu.2.clockSpeed", "system/cpu_core_clock_speed", "2"), ("system.disk.sda.in", "system/disk_in_mb", "sda"),
    ("system.disk./a.b.out", "system/disk_out_mb", "/a.b"), ("system.disk./.usagePercent", "system/disk_used_pct", "/"), ("system.disk./.usageGB", "system/disk_used_gb", "/"), ("system.cpu", "system/proc_cpu_pct", ""),
    ("system.memory", "system/sys_mem_pct", ""), ("system.proc.memory.rssMB", "system/proc_mem_used_mb", ""), ("system.network.sent", "system/net_sent_bytes", ""), ("system.odd.someName", "system/odd_some_name", ""), ("loss", None, None),
)


def _case(key: str, values) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


@query(
    "SRC_15_system_columns",
    f"""WITH k AS (SELECT l_partkey % {len(_SYSTEM)} AS k FROM lineitem) SELECT {_case("k", [r[0] for r in _SYSTEM])} AS name, {_case("k", [r[1] for r in _SYSTEM])} AS metric_name, {_case("k", [r[2] for r in _SYSTEM])} AS tag, count(*) AS n FROM k GROUP BY k""",
)
def system_columns(spark, sf_dir):
    names = F.get(F.array(*[F.lit(r[0]) for r in _SYSTEM]), (F.col("l_partkey") % len(_SYSTEM)).cast("int"))
    return I.system_columns(A.table(spark, sf_dir, "lineitem").select(names.alias("name"))).groupBy("name", "metric_name", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SRC_18_monotone_steps",
    """WITH RECURSIVE r AS (SELECT user_id, event_id, (event_id * 7919) % 50 AS want, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  f AS (SELECT user_id, event_id, want AS step, n FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.event_id, greatest(r.want, f.step + 1), r.n FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
  SELECT user_id, event_id, step FROM f""",
)
def monotone(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 7919) % 50).alias("want"))
    return P.monotone_steps(e, ["user_id"], ["event_id"], "want").select("user_id", "event_id", "step")


@query(
    "SRC_19_run_identity",
    """WITH c AS (SELECT *, c_custkey % 7 AS k FROM customer)
  SELECT 'wandb_' || lower(replace(c_mktsegment, ' ', '-')) || '_' || c_custkey AS run_id, CASE k WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN c_custkey::VARCHAR WHEN 2 THEN repeat('é', 1024) ELSE c_name END AS run_name,
  CASE WHEN k IN (0, 1, 2) THEN 1704067201000 + k * 1000 + CASE k WHEN 1 THEN 250 ELSE 0 END ELSE 5000 END AS created_ms, CASE k WHEN 0 THEN 1704070800000 WHEN 1 THEN 1704067202250 WHEN 2 THEN 1704067203000 ELSE 5000 END AS ended_ms,
  CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 255 WHEN 3 THEN 137 WHEN 4 THEN 143 END AS exit_code FROM c""",
)
def run_identity(spark, sf_dir):
    """Names that are blank, padded or too long; times in three shapes and others; all states."""
    c = F.col("c_custkey")
    k = c % 7
    created = F.when(k == 0, "2024-01-01T00:00:01Z").when(k == 1, "2024-01-01T00:00:02.250000Z").when(k == 2, "2024-01-01T02:00:03+0200").when(k == 3, "2024-01-01 00:00:03").when(k == 4, "2024-01-01T00:00:03").when(k == 5, "soon")
    name = F.when(k == 0, "").when(k == 1, "  ").when(k == 2, F.repeat(F.lit("é"), 1100)).otherwise(F.concat(F.lit(" "), "c_name", F.lit("\n")))
    states = F.array(*[F.lit(x) for x in ("finished", "failed", "crashed", "killed", "preempted", "running", "odd")])
    rows = A.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("project"), c.cast("string").alias("id"), name.alias("name"), created.alias("created"), F.when(k == 0, "2024-01-01T01:00:00Z").alias("heartbeat"), F.get(states, k.cast("int")).alias("state"))
    return I.run_identity(rows, 5000).select("run_id", "run_name", "created_ms", "ended_ms", "exit_code")


@query(
    "SRC_20_settledness",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no_export' WHEN o_orderkey % 7 = 1 THEN 'export_incomplete' WHEN o_orderkey % 7 = 2 THEN 'export_errors' WHEN o_orderkey % 7 = 3 THEN 'export_skipped'
  WHEN o_orderstatus = 'O' OR o_orderkey % 5 < 2 THEN 'run_not_finished' END AS unsettled FROM orders""",
)
def settledness(spark, sf_dir):
    """The state of the export and that of the run both count, and an unknown one isn't final."""
    k = F.col("o_orderkey") % 7
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", (k != 0).alias("exported"), (k != 1).alias("complete"), F.when(k == 2, 3).otherwise(0).alias("errors"), F.when(k == 3, 1).otherwise(0).alias("skipped"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("finished").alias("state"), F.when(F.col("o_orderkey") % 5 == 1, "running").when(F.col("o_orderkey") % 5 > 1, "killed").alias("run_state"))
    return I.unsettled(o).select("o_orderkey", "unsettled")


@query(
    "SRC_21_reexport_needed",
    """WITH k AS (SELECT c_custkey AS k FROM customer)
  SELECT k AS run, k % 8 = 7 OR k % 11 = 0 OR k % 3 = 0 OR k % 13 = 0 OR k % 5 = 0 OR k % 7 = 0 OR k % 17 = 0 AS needed,
    k % 8 = 7 OR k % 11 = 0 OR k % 19 = 0 OR k % 3 = 0 OR k % 13 = 0 OR k % 5 = 0 OR k % 7 = 0 OR k % 17 = 0 OR k % 23 = 0 AS needed_whole FROM k""",
)
def reexport(spark, sf_dir):
    """Runs not exported (8), not whole (11), not over then (3) or now (13), with another heartbeat (5) or length (7), or
    without their media (17); then also with errors tried again (19) and without files that the first time weren't asked for (23)."""
    k = F.col("c_custkey")
    cur = A.table(spark, sf_dir, "customer").select(k.alias("run"), F.when(k % 13 == 0, "running").otherwise("finished").alias("state"), F.lit(10).alias("heartbeat"), F.lit(5).alias("lines"))
    r = F.col("run")
    skipped = F.array_compact(F.array(F.when(r % 17 == 0, "media"), F.when(r % 23 == 0, "files")))
    state = F.when(r % 3 == 0, F.lit(None)).otherwise("crashed")
    prev = cur.where(r % 8 != 7).select("run", (r % 11 != 0).alias("complete"), F.when(r % 19 == 0, 2).otherwise(0).alias("errors"), skipped.alias("skipped"), state.alias("state"), F.when(r % 5 == 0, 9).otherwise(10).alias("heartbeat"), F.when(r % 7 == 0, 4).otherwise(5).alias("lines"))
    whole = I.reexport_needed(prev, cur, retry_errors=True).select("run", F.col("needed").alias("needed_whole"))
    return I.reexport_needed(prev, cur, skip=("files",)).select("run", "needed").join(whole, "run")


@query(
    "SRC_22_run_info",
    """SELECT c_custkey AS run, '{"meta":{"time":{"start":"' || strftime(make_timestamp(c_custkey * 1000000), '%B %d, %Y %I:%M:%S %p') || '","start_unix":' || c_custkey || '},"system":'
  || CASE WHEN c_custkey % 2 = 0 THEN '{"hostname":"node' || (c_custkey % 7) || '","cpu_count":8,"command":"train.py --name ' || chr(39) || 'a b' || chr(39) || '"},"git":{"remote":"https://git.example.org/' || c_name || '","commit":"c' || c_custkey || '"},"slurm":{"job_id":"7"}' ELSE '{}' END
  || ',"wandb_import":{"url":null,"entity":"team","project":null,"run_id":"r' || c_custkey || '","state":"finished","tags":' || CASE WHEN c_custkey % 3 = 0 THEN '["x"]' ELSE '[]' END || ',"notes":null,"group":null,"job_type":null,"sweep":null,"user":null,"email":null,"created_at":null,"heartbeat_at":null,"history_line_count":5,"imported_at":"2024-01-01T00:00:00Z","summary":{"loss":1},"artifacts":null}}'
  || CASE WHEN c_custkey % 5 = 0 THEN ',"config":{"lr":3}' ELSE '' END || '}' AS info FROM customer""",
)
def run_info(spark, sf_dir):
    k, t = F.col("c_custkey"), F.col("c_custkey").cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    run = cat('{"id":"r', t, '","entity":"team","state":"finished","history_line_count":5', F.when(k % 3 == 0, ',"tags":["x"]').otherwise(""), F.when(k % 5 == 0, ',"config":{"lr":3}').otherwise(""), "}")
    machine = cat('{"host":"node', (k % 7).cast("string"), '","cpu_count":8,"gpu":null,"program":"train.py","args":["--name","a b"],"git":{"remote":"https://user:se@cret@git.example.org/', F.col("c_name"), '","commit":"c', t, '"},"slurm":{"job_id":"7","jwt":"secret"}}')
    rows = A.table(spark, sf_dir, "customer").select(k.alias("run_no"), (k * 1000).alias("created_ms"), run.alias("run"), F.when(k % 2 == 0, machine).alias("machine"), F.lit('{"loss":1}').alias("summary"), F.lit(None).cast("string").alias("artifacts"))
    return I.run_info(rows, "2024-01-01T00:00:00Z").select(F.col("run_no").alias("run"), "info")


@query(
    "SRC_23_dry_run",
    """SELECT kind, count(*) AS n FROM (SELECT unnest(['numeric', 'numeric', 'text']) AS kind FROM orders) GROUP BY kind""",
)
def dry_run(spark, sf_dir):
    return I.dry_run(A.table(spark, sf_dir, "orders").select("o_totalprice", "o_custkey", "o_orderstatus"))


@query(
    "SRC_24_replay_merge",
    f"""WITH {DENSE}, b AS (SELECT *, inserted_ms AS created, 0 AS phase FROM dense UNION ALL SELECT * REPLACE (CASE WHEN value IS NOT NULL THEN value + 1 END AS value), inserted_ms, 1 FROM dense WHERE step % 3 = 0),
  n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY project_id, run_id, metric_name, tag, step ORDER BY created DESC, phase DESC, timestamp_ms DESC, value DESC NULLS LAST, cdn_key DESC NULLS LAST, text_data DESC NULLS LAST) = 1)
  SELECT project_id, run_id, metric_name, count(*) AS n, round(sum(value), 2) AS total FROM n GROUP BY ALL""",
)
def replay(spark, sf_dir):
    """Batches come twice and out of order, the second time with salvaged values: what was made last counts, salvage behind work."""
    p = A.dense_points(spark, sf_dir).withColumns({"created_ns": F.unix_millis("inserted_at"), "phase": F.lit("worker"), "position": F.col("timestamp_ms")})
    again = p.where("step % 3 = 0").withColumns({"phase": F.lit("salvage"), "value": F.col("value") + 1})
    merged = P.replay(again.unionByName(p).unionByName(again))
    return merged.groupBy("project_id", "run_id", "metric_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


@query(
    "SRC_25_registry_reconcile",
    f"""WITH {DENSE}, r AS (SELECT run_id, metric_name, max(CASE WHEN value IS NOT NULL THEN 2 WHEN cdn_key IS NOT NULL THEN 1 ELSE 3 END)::INTEGER AS type_code FROM dense GROUP BY project_id, run_id, metric_name)
  SELECT run_id, metric_name, type_code, true AS stored FROM r UNION ALL SELECT '', metric_name, type_code, true FROM r
  UNION ALL SELECT 'a' || chr(0), metric_name, type_code, false FROM r UNION ALL SELECT repeat('é', 129), metric_name, type_code, false FROM r""",
)
def reconcile(spark, sf_dir):
    """Runs without a name are stored; a NUL and 258 bytes can't be."""
    found = R.registry(A.dense_points(spark, sf_dir))
    odd = found.select("project_id", F.explode(F.array(F.col("run_id"), F.lit(""), F.lit("a\x00"), F.lit("é" * 129))).alias("run_id"), "metric_name", "type_code")
    good, bad = R.reconcile(odd)
    cols = ["run_id", "metric_name", "type_code"]
    return good.select(*cols, F.lit(True).alias("stored")).unionAll(bad.select(*cols, F.lit(False)))


@query("PF_1_2_selection", f"WITH {POINTS} SELECT run_id, metric_name, step, timestamp_ms FROM points WHERE run_id IN ('run1', 'run2') AND metric_name = 'click' AND step BETWEEN 100 AND 5000")
def selection(spark, sf_dir):
    return P.select_series(A.points(spark, sf_dir), "events", ["run1", "run2"], "click", (100, 5000)).select("run_id", "metric_name", "step", "timestamp_ms")


@query("PF_3_smoothing_margin", f"WITH {POINTS} SELECT run_id, count(*) AS n FROM points WHERE step BETWEEN 2000 - 80 AND 3000 GROUP BY run_id")
def margin(spark, sf_dir):
    lo, hi = P.smoothing_margin("ema", (2000, 3000), tau=10)
    return A.points(spark, sf_dir).where(F.col("step").between(lo, hi)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("PF_4_payload_filter", f"WITH {LATEST} SELECT CASE WHEN value IS NOT NULL THEN 'numeric' WHEN cdn_key IS NOT NULL THEN 'cdn' ELSE 'text' END AS kind, count(*) AS n FROM latest GROUP BY ALL")
def payload(spark, sf_dir):
    return P.kind(P.latest(A.dense_points(spark, sf_dir))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "PF_5_tag_groups",
    f"""WITH {LATEST}, n AS (SELECT * FROM latest WHERE value IS NOT NULL) SELECT run_id, metric_name, tag, count(*) AS n FROM n
  WHERE tag <> '' OR NOT EXISTS (SELECT 1 FROM n m WHERE m.run_id = n.run_id AND m.metric_name = n.metric_name AND m.tag <> '') GROUP BY ALL""",
)
def tags(spark, sf_dir):
    n = P.latest(A.dense_points(spark, sf_dir)).where("value IS NOT NULL")
    return P.tag_groups(n).groupBy("run_id", "metric_name", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "PF_6_series_labels",
    f"""WITH {DENSE}, d AS (SELECT DISTINCT run_id, metric_name, tag FROM dense), g AS (
  SELECT 'all' AS asked, * FROM d UNION ALL SELECT 'metric', * FROM d WHERE metric_name = 'flag/A' UNION ALL SELECT 'run', * FROM d WHERE run_id = 's1' UNION ALL SELECT 'one', * FROM d WHERE run_id = 's1' AND metric_name = 'flag/A')
  SELECT asked, run_id, metric_name, tag, CASE asked WHEN 'all' THEN run_id || '/' || metric_name || CASE tag WHEN '' THEN '' ELSE '_' || tag END WHEN 'metric' THEN run_id || CASE tag WHEN '' THEN '' ELSE '/' || tag END
    WHEN 'run' THEN metric_name || CASE tag WHEN '' THEN '' ELSE '_' || tag END ELSE CASE tag WHEN '' THEN run_id ELSE tag END END AS label FROM g""",
)
def labels(spark, sf_dir):
    """Labels of all series, of one metric's, of one run's and of one metric's of one run."""
    d = A.dense_points(spark, sf_dir).select("run_id", "metric_name", "tag").distinct()
    asked = {"all": "true", "metric": "metric_name = 'flag/A'", "run": "run_id = 's1'", "one": "run_id = 's1' AND metric_name = 'flag/A'"}
    parts = [P.series_labels(d.where(c)).select(F.lit(k).alias("asked"), "run_id", "metric_name", "tag", "label") for k, c in asked.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(
    "PF_8_run_filter",
    """WITH r AS (SELECT o_orderkey AS ordinal, 'Run ' || (o_orderkey % 700) AS run_name, 'r' || o_orderkey AS run_id FROM orders)
  SELECT f AS filter, ordinal, run_name FROM r, (VALUES ('N 12'), ('#17'), (' 17'), ('#n'), ('#')) v(f)
  WHERE contains(lower(run_name), trim(lower(f))) OR contains(run_id, trim(lower(f))) OR contains(ordinal::VARCHAR, ltrim(trim(lower(f)), '#'))""",
)
def run_filter(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("Run "), (F.col("o_orderkey") % 700).cast("string")).alias("run_name"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"))
    parts = [R.filter_runs(o, f).select(F.lit(f).alias("filter"), "ordinal", "run_name") for f in ("N 12", "#17", " 17", "#n", "#")]
    return reduce(DataFrame.unionAll, parts)


@query("PF_9_panel_filter", f"WITH {POINTS} SELECT DISTINCT metric_name FROM points WHERE contains(lower(metric_name), 'i')")
def panel_filter(spark, sf_dir):
    m = A.points(spark, sf_dir).select("metric_name").distinct().withColumn("label", F.col("metric_name"))
    return R.filter_panels(m, "I").select("metric_name")


@query(
    "PF_10_media_keys",
    f"""WITH {DENSE}, k AS (SELECT DISTINCT cdn_key FROM dense WHERE cdn_key IS NOT NULL)
  SELECT replace(cdn_key, '.png', e) AS cdn_key FROM k, (VALUES ('.png'), ('.JPG'), ('.jpeg'), ('.Gif'), ('.pdf'), ('.gz'), ('.bin'), ('.webm')) v(e)""",
)
def media_keys(spark, sf_dir):
    """Keys with stored extensions in any case; pages, programs, short and padded keys are none."""
    of = [".png", ".JPG", ".jpeg", ".Gif", ".pdf", ".gz", ".bin", ".webm", ".html", ".exe", ".png ", ".png\n", ""]
    k = A.dense_points(spark, sf_dir).where("cdn_key IS NOT NULL").select("cdn_key").distinct()
    keys = k.select(F.explode(F.concat(F.array(*[F.replace("cdn_key", F.lit(".png"), F.lit(e)) for e in of]), F.array(F.concat(F.lit("x"), "cdn_key"), F.lit("abc.png")))).alias("cdn_key"))
    return keys.where(R.is_media_key(F.col("cdn_key")))


@query("PF_11_alerts", "SELECT 'Full ' || c_custkey AS name, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE '' END AS summary, CASE WHEN c_custkey % 5 <> 0 THEN 'disk' END AS class, '2024-01-01T00:00:00Z' AS active_at FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def alerts(spark, sf_dir):
    k = F.col("c_custkey")
    labels = F.struct(F.concat(F.lit("Full "), k.cast("string")).alias("alertname"), F.when(k % 2 == 0, "user").otherwise("staff").alias("audience"), F.when(k % 5 != 0, "disk").alias("class"))
    alert = F.struct(labels.alias("labels"), F.struct(F.when(k % 4 == 0, F.col("c_name")).alias("summary")).alias("annotations"), F.when(k % 3 == 0, "firing").otherwise("pending").alias("state"), F.lit("2024-01-01T00:00:00Z").alias("activeAt"))
    docs = A.table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.struct(F.array(alert).alias("alerts")).alias("data"))).alias("body"))
    return R.firing_alerts(docs, "body")


@query("PF_12_sections", f"WITH {DENSE} SELECT DISTINCT metric_name, CASE WHEN contains(metric_name, '/') THEN regexp_extract(metric_name, '^(.*)/[^/]*$', 1) ELSE '' END AS section FROM dense")
def sections(spark, sf_dir):
    return A.dense_points(spark, sf_dir).select("metric_name").distinct().withColumn("section", X.section(F.col("metric_name")))


@query("PF_13_marker_kinds", f"WITH {POINTS} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN isnan(value) THEN 1 WHEN value = 'inf'::FLOAT THEN 2 WHEN value = '-inf'::FLOAT THEN 3 ELSE 0 END AS kind FROM points) GROUP BY kind")
def marker_kinds(spark, sf_dir):
    return A.points(spark, sf_dir).select(X.marker_kind(F.col("value")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("AG_1_latest", f"WITH {LATEST} SELECT project_id, run_id, metric_name, tag, step, value::DOUBLE AS value, cdn_key, text_data, timestamp_ms FROM latest")
def latest(spark, sf_dir):
    return P.latest(A.dense_points(spark, sf_dir)).select(*A.KEY, F.col("value").cast("double").alias("value"), "cdn_key", "text_data", "timestamp_ms")


@query("AG_3_registry", f"WITH {DENSE} SELECT project_id, run_id, metric_name, max(CASE WHEN value IS NOT NULL THEN 2 WHEN cdn_key IS NOT NULL THEN 1 ELSE 3 END)::INTEGER AS type_code FROM dense GROUP BY ALL")
def metric_registry(spark, sf_dir):
    return R.registry(A.dense_points(spark, sf_dir))


@query("AG_4_run_set_metrics", f"WITH {DENSE} SELECT metric_name, max(CASE WHEN value IS NOT NULL THEN 2 WHEN cdn_key IS NOT NULL THEN 1 ELSE 3 END)::INTEGER AS type_code FROM dense WHERE run_id IN ('s1', 's2') GROUP BY ALL")
def run_set(spark, sf_dir):
    return R.run_set_metrics(R.registry(A.dense_points(spark, sf_dir)), ["s1", "s2"])


@query(
    "AG_5_heartbeats",
    f"""WITH {DENSE} SELECT project_id, run_id, max(timestamp_ms) FILTER (text_data IS NULL AND metric_name NOT LIKE 'system/%') AS last_main_ms, max(timestamp_ms) FILTER (text_data IS NOT NULL OR metric_name LIKE 'system/%') AS last_system_ms FROM dense GROUP BY ALL""",
)
def heartbeats(spark, sf_dir):
    return R.heartbeats(A.dense_points(spark, sf_dir))


@query(
    "AG_12_median_gap",
    f"""WITH {POINTS}, g AS (SELECT run_id, metric_name, step - lag(step) OVER (PARTITION BY run_id, metric_name ORDER BY step) AS gap FROM points),
  r AS (SELECT *, row_number() OVER (PARTITION BY run_id, metric_name ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY run_id, metric_name) AS total FROM g WHERE gap > 0),
  m AS (SELECT run_id, metric_name, gap AS median, total FROM r WHERE i = total // 2)
  SELECT run_id, metric_name, median::DOUBLE AS median, count(*) FILTER (gap < median) AS below, count(*) FILTER (gap = median) AS equal, total FROM m JOIN r USING (run_id, metric_name, total) GROUP BY ALL""",
)
def gaps(spark, sf_dir):
    return P.median_gap(A.points(spark, sf_dir), "step", ["run_id", "metric_name"])


@query("AG_18_id_conflicts", "SELECT run_id, count(DISTINCT project_id) AS projects FROM (SELECT 'x' || (o_orderkey % 5000) AS run_id, o_custkey % 3 AS project_id FROM orders) GROUP BY run_id HAVING count(DISTINCT project_id) > 1")
def conflicts(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.concat(F.lit("x"), (F.col("o_orderkey") % 5000).cast("string")).alias("run_id"), (F.col("o_custkey") % 3).cast("string").alias("project_id"))
    return R.id_conflicts(o)


_HASH = "('0x' || substr(md5(concat_ws(chr(31), '=' || step, '=' || timestamp_ms, coalesce('=' || q, '-'))), 1, 15))::BIGINT"


@query(
    "AG_21_fingerprint",
    f"WITH {POINTS}, p AS (SELECT *, CASE WHEN isfinite(value) THEN round(value::DOUBLE * 1000)::BIGINT END AS q FROM points) SELECT run_id, metric_name, count(*) AS n, (sum({_HASH}::HUGEINT) % 18446744073709551616::HUGEINT)::VARCHAR AS fingerprint, true AS order_free FROM p GROUP BY ALL",
)
def content_fingerprint(spark, sf_dir):
    """Fingerprints of two orders of the same rows agree."""
    q = F.when(X.is_finite(F.col("value")), F.round(F.col("value").cast("double") * 1000).cast("long"))
    p = A.points(spark, sf_dir).withColumn("q", q)
    cols = ["step", "timestamp_ms", "q"]
    a = P.fingerprint(p, ["run_id", "metric_name"], cols)
    b = P.fingerprint(p.repartition(7, "step"), ["run_id", "metric_name"], cols).select("run_id", "metric_name", F.col("fingerprint").alias("other"))
    return a.join(b, ["run_id", "metric_name"]).select("run_id", "metric_name", "n", F.col("fingerprint").cast("string").alias("fingerprint"), (F.col("fingerprint") == F.col("other")).alias("order_free"))


@query("WN_1_gaps", f"WITH {POINTS} SELECT run_id, metric_name, step, step - lag(step) OVER (PARTITION BY run_id, metric_name ORDER BY step) AS gap FROM points")
def previous_gap(spark, sf_dir):
    return R.previous_gap(A.points(spark, sf_dir), ["run_id", "metric_name"], "step").select("run_id", "metric_name", "step", "gap")


@query(
    "WN_3_version_conflicts",
    f"""WITH {DENSE} SELECT project_id, run_id, metric_name, tag, step, payloads FROM (SELECT project_id, run_id, metric_name, tag, step, count(DISTINCT coalesce(value::VARCHAR, '') || '|' || coalesce(cdn_key, '') || '|' || coalesce(text_data, '')) AS payloads
  FROM (SELECT *, max(v) OVER (PARTITION BY project_id, run_id, metric_name, tag, step) AS top FROM (SELECT *, inserted_ms // 8640000000 AS v FROM dense)) WHERE v = top GROUP BY ALL) WHERE payloads > 1""",
)
def version_conflicts(spark, sf_dir):
    """Versions coarsened to 100 days, so that some keys have several newest rows."""
    d = A.dense_points(spark, sf_dir).withColumn("version", F.floor(F.unix_millis("inserted_at") / 8_640_000_000))
    return P.version_conflicts(d, "version").select(*A.KEY, "payloads")


@query("WN_4_relative_time", f"WITH {POINTS} SELECT run_id, metric_name, step, timestamp_ms - min(timestamp_ms) OVER (PARTITION BY run_id, metric_name, tag) AS x FROM points")
def relative(spark, sf_dir):
    return P.relative_time(A.points(spark, sf_dir)).select("run_id", "metric_name", "step", "x")


@query(
    "WN_13_counter_rates",
    f"""WITH {POINTS}, c AS (SELECT run_id, step, value::DOUBLE AS v, timestamp_ms, lag(timestamp_ms) OVER w AS pt, lag(value::DOUBLE) OVER w AS pv FROM points WHERE metric_name = 'view' AND isfinite(value) WINDOW w AS (PARTITION BY run_id ORDER BY timestamp_ms, step))
  SELECT run_id, step, round((v - pv) / ((timestamp_ms - pt) / 1000.0) * 1000, 6) AS rate FROM c WHERE timestamp_ms > pt AND v >= pv""",
)
def rates(spark, sf_dir):
    p = A.points(spark, sf_dir).where((F.col("metric_name") == "view") & X.is_finite(F.col("value")))
    return P.counter_rates(p).select("run_id", "step", F.round(F.col("rate") * 1e9, 6).alias("rate"))


@query("SL_12_history", f"WITH {LATEST} SELECT run_id, tag, step, value::DOUBLE AS value FROM latest WHERE metric_name = 'flag/R' AND value IS NOT NULL")
def history(spark, sf_dir):
    return P.history(A.dense_points(spark, sf_dir), "flag/R").select("run_id", "tag", "step", F.col("value").cast("double").alias("value"))


@query("SRC_6_point_sink", f"WITH {DENSE} SELECT run_id, count(*) AS n FROM dense WHERE project_id = 'p1' GROUP BY ALL")
def sink(spark, sf_dir):
    """Written partitioned and sorted, and one project read back."""
    from .streams import _root

    path = _root(spark)
    P.write_points(A.dense_points(spark, sf_dir), path, "overwrite")
    return P.read_points(spark, path, "p1").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("PF_7_log_domain", f"WITH {POINTS} SELECT step - 100 >= 0 AS plottable, count(*) AS n FROM points GROUP BY ALL")
def log_domain(spark, sf_dir):
    p = A.points(spark, sf_dir).withColumn("step", F.col("step") - 100)
    return P.log_domain(p, "step", False).groupBy("plottable").agg(F.count(F.lit(1)).alias("n"))


@query(
    "JN_4_asof",
    f"""WITH {POINTS}, a AS (SELECT run_id, step FROM points WHERE metric_name = 'click'), b AS (SELECT run_id, step, timestamp_ms FROM points WHERE metric_name = 'view')
  SELECT a.run_id, a.step, b.timestamp_ms AS view_ms FROM a ASOF LEFT JOIN b ON a.run_id = b.run_id AND a.step >= b.step""",
)
def asof(spark, sf_dir):
    p = A.points(spark, sf_dir)
    a = p.where("metric_name = 'click'").select("run_id", "step")
    b = p.where("metric_name = 'view'").select("run_id", "step", F.col("timestamp_ms").alias("view_ms"))
    return P.asof(a, b, ["run_id"], "step", ["view_ms"])


@query(
    "JN_3_range_join",
    f"""WITH {POINTS}, a AS (SELECT run_id, step FROM points WHERE metric_name = 'click'), b AS (SELECT run_id, step FROM points WHERE metric_name = 'view')
  SELECT a.run_id, a.step, b.step AS r_step FROM a JOIN b ON a.run_id = b.run_id AND abs(a.step - b.step) <= 25""",
)
def range_join(spark, sf_dir):
    p = A.points(spark, sf_dir)
    return P.range_join(p.where("metric_name = 'click'").select("run_id", "step"), p.where("metric_name = 'view'").select("run_id", "step"), ["run_id"], "step", 25)
