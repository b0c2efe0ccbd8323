"""Queries over runs: listing, status, lifecycle, versions, retention, and asset garbage collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import garbage as G
from ..operators import registry as R
from ..operators import runs as U
from ..plans.scratch import numbered
from ..sources import adapters as A
from .common import DENSE, MEDIA, RUNS, registry

ALL, query = registry()

#: 2001-08-02: a moment behind the last order; retention counts back from it.
NOW = 996_710_400_000
_DAY = 86_400_000
_CLASS = f"CASE WHEN purging IS NOT NULL THEN 'purging' WHEN deleted IS NOT NULL THEN CASE WHEN {NOW} - deleted >= 604800000 THEN 'expired' ELSE 'trashed' END ELSE 'active' END"


def _runs(spark, sf_dir):
    return A.runs(spark, sf_dir).withColumn("ordinal", F.substring("run_id", 2, 20).cast("long"))


def _ms(c):
    return F.unix_millis(c)


@query("AG_6_project_last_logged", f"WITH {RUNS} SELECT project_id, max(least(ingested, terminated)) AS last_logged_ms FROM runs GROUP BY ALL")
def last_logged(spark, sf_dir):
    return U.project_last_logged(_runs(spark, sf_dir)).select("project_id", _ms("last_logged").alias("last_logged_ms"))


@query("AG_17_purge_backlog", f"WITH {RUNS} SELECT count(*) AS due, greatest(coalesce(max({NOW} - 604800000 - deleted), 0), 0) AS oldest_overdue_ms FROM runs WHERE deleted IS NOT NULL AND (purging IS NOT NULL OR {NOW} - deleted >= 604800000)")
def backlog(spark, sf_dir):
    return U.purge_backlog(_runs(spark, sf_dir), NOW)


@query("AG_23_projects", f"WITH {RUNS} SELECT project_id, count(*) AS runs FROM runs GROUP BY ALL")
def projects(spark, sf_dir):
    return U.project_last_logged(_runs(spark, sf_dir)).select("project_id", "runs")


@query("JN_6_known_runs", f"WITH {DENSE} SELECT DISTINCT run_id, metric_name FROM dense WHERE run_id IN (SELECT 's' || s_suppkey FROM supplier)")
def known(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("run_id"))
    reg = R.registry(A.dense_points(spark, sf_dir))
    return R.known_runs(reg, reg.select("project_id", "run_id").distinct().join(s, "run_id")).select("run_id", "metric_name")


@query(
    "JN_7_version_lookup",
    f"""WITH {RUNS} SELECT project_id, run_id, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 7 WHEN k % 22 = 0 THEN 9223372036854775807
  ELSE k % 5 + (purging IS NOT NULL OR coalesce({NOW} - deleted >= 604800000, false))::BIGINT END AS version FROM runs UNION ALL SELECT 'elsewhere', run_id, 0 FROM runs""",
)
def lookup(spark, sf_dir):
    """Also runs whose version is the greatest there is, and ids asked for in another project."""
    k = F.col("ordinal")
    r = _runs(spark, sf_dir).withColumn("version", F.when(k % 22 == 0, U.MAX_VERSION).otherwise(k % 5))
    wanted = r.select("project_id", "run_id").unionAll(r.select(F.lit("elsewhere"), "run_id"))
    return U.version_lookup(wanted, r.where("ordinal % 3 = 2"), r.where("ordinal % 3 = 1").select("project_id", "run_id", F.lit(7).cast("long").alias("version")), NOW)


_ASKED = "asked AS (SELECT project_id, run_id, k AS position FROM runs UNION ALL SELECT project_id, run_id, k + 1000000 FROM runs WHERE k % 10 = 0 UNION ALL SELECT project_id, 'x' || k, k + 2000000 FROM runs WHERE k % 100 = 0)"
_CLASSED = f"""{RUNS}, {_ASKED}, c AS (SELECT a.project_id, a.run_id, position, CASE WHEN r.run_id IS NULL THEN CASE WHEN position % 3 = 0 THEN 'purged' ELSE 'missing' END ELSE {_CLASS} END AS lifecycle
  FROM asked a LEFT JOIN runs r ON a.project_id = r.project_id AND a.run_id = r.run_id)"""


def _classified(spark, sf_dir):
    r = _runs(spark, sf_dir)
    k = F.col("ordinal")
    gone = r.where(k % 100 == 0).select("project_id", F.concat(F.lit("x"), k.cast("string")).alias("run_id"), (k + 2_000_000).alias("position"))
    asked = r.select("project_id", "run_id", k.alias("position")).unionAll(r.where(k % 10 == 0).select("project_id", "run_id", (k + 1_000_000).alias("position"))).unionAll(gone)
    return U.classify(asked, r, gone.where("position % 3 = 0").select("project_id", "run_id"), NOW)


@query("JN_8_RN_3_lifecycle", f"WITH {_CLASSED} SELECT run_id, position, lifecycle FROM c")
def lifecycle(spark, sf_dir):
    return _classified(spark, sf_dir).select("run_id", "position", "lifecycle")


_NTH = "row_number() OVER (PARTITION BY project_id, run_id ORDER BY position)"


@query(
    "RN_4_trash_outcomes",
    f"WITH {_CLASSED} SELECT position, CASE WHEN lifecycle = 'active' AND {_NTH} = 1 THEN 'trashed' WHEN lifecycle IN ('active', 'trashed') THEN 'already_trashed' WHEN lifecycle IN ('expired', 'purging', 'purged') THEN 'expired' ELSE 'not_found' END AS outcome FROM c",
)
def trash(spark, sf_dir):
    return U.trash_outcomes(_classified(spark, sf_dir)).select("position", "outcome")


@query(
    "RN_5_restore_outcomes",
    f"WITH {_CLASSED} SELECT position, CASE WHEN lifecycle = 'trashed' AND {_NTH} = 1 THEN 'restored' WHEN lifecycle IN ('active', 'trashed') THEN 'already_active' WHEN lifecycle IN ('expired', 'purging', 'purged') THEN 'expired' ELSE 'not_found' END AS outcome FROM c",
)
def restore(spark, sf_dir):
    return U.restore_outcomes(_classified(spark, sf_dir)).select("position", "outcome")


@query(
    "JN_12_SL_6_bindings",
    f"""WITH {RUNS}, p AS (SELECT run_id, k FROM runs WHERE project_id = 'nation3'), sel AS (SELECT run_id, k % 13 * 100000 + k AS k FROM p WHERE k % 4 = 0),
  e AS (SELECT 0 AS position, 'loss' AS metric_name, k, run_id FROM sel UNION ALL SELECT 1, 'acc', k, run_id FROM p UNION ALL SELECT 2, 'loss', k - 1, run_id FROM (VALUES (1, 'r1'), (2, 'r2')) v(k, run_id)),
  o AS (SELECT metric_name, run_id, min((position, k)) AS seen FROM e GROUP BY ALL), f AS (SELECT run_id FROM (SELECT run_id, min(seen) AS initial FROM o GROUP BY run_id) ORDER BY initial, run_id LIMIT 25)
  SELECT 25 AS most, metric_name, run_id, seen[1]::INTEGER AS position FROM o JOIN f USING (run_id) UNION ALL SELECT 0, metric_name, run_id, seen[1]::INTEGER FROM o""",
)
def bindings(spark, sf_dir):
    p = _runs(spark, sf_dir).where("project_id = 'nation3'")
    sel = p.where("ordinal % 4 = 0").select("run_id", (F.col("ordinal") % 13 * 100_000 + F.col("ordinal")).alias("position"))
    b = spark.createDataFrame([(0, "loss", "selected", None), (1, "acc", "all", None), (2, "loss", "specific", ["r1", "r2"])], "position int, metric_name string, mode string, ids array<string>")
    return U.resolve_bindings(b, sel, p, 25).withColumn("most", F.lit(25)).unionByName(U.resolve_bindings(b, sel, p, 0).withColumn("most", F.lit(0)))


@query(
    "JN_13_roll_forward",
    f"""WITH {RUNS}, b AS (SELECT * FROM runs WHERE deleted IS NULL), l AS (SELECT project_id, max(least(ingested, terminated)) AS t, substr(project_id, 7)::INTEGER AS i FROM b GROUP BY project_id),
  a AS (SELECT *, CASE i % 5 WHEN 1 THEN t // 60000 * 60000 - 1 WHEN 2 THEN t // 60000 * 60000 WHEN 3 THEN t + 600000 WHEN 4 THEN t - 90000000 END AS held FROM l)
  SELECT run_id, CASE WHEN i % 7 <> 6 AND (held IS NULL OR t >= held // 60000 * 60000 + 60000) THEN t END AS project_time_ms FROM b JOIN a USING (project_id)""",
)
def roll(spark, sf_dir):
    """Activities that are unset, of the minute before, of the same minute, later, a day old; some projects have none."""
    r = _runs(spark, sf_dir).where("deleted_at IS NULL")
    t, i = _ms("last_logged"), F.substring("project_id", 7, 9).cast("int")
    minute = F.expr("unix_millis(last_logged) div 60000 * 60000")
    held = F.when(i % 5 == 1, minute - 1).when(i % 5 == 2, minute).when(i % 5 == 3, t + 600_000).when(i % 5 == 4, t - 90_000_000)
    activity = U.project_last_logged(r).where(i % 7 != 6).select("project_id", F.timestamp_millis(held).alias("last_logged"))
    return U.roll_forward(r, activity).select("run_id", _ms("project_time").alias("project_time_ms"))


@query("WN_6_ordinals", f"WITH {RUNS} SELECT run_id, CASE WHEN project_id = 'nation1' THEN 100 ELSE 0 END + row_number() OVER (PARTITION BY project_id ORDER BY created, run_id) AS ordinal FROM runs")
def ordinals(spark, sf_dir):
    r = _runs(spark, sf_dir).drop("ordinal")
    marks = r.where("project_id = 'nation1'").select("project_id").distinct().withColumn("high_water", F.lit(100))
    return U.assign_ordinals(r, marks).select("run_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("WN_11_transitions", "SELECT * FROM (SELECT 'u' || user_id AS run_id, event_id AS scan_ms, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type AS after FROM events) WHERE before <> after")
def transitions(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("scan_ms"), F.col("event_type").alias("status"))
    return U.transitions(e)


@query("SL_1_runs_by_ordinal", f"WITH {RUNS} SELECT run_id, k AS ordinal FROM runs WHERE project_id = 'nation7' AND deleted IS NULL AND purging IS NULL")
def listing(spark, sf_dir):
    return U.by_ordinal(_runs(spark, sf_dir).where("project_id = 'nation7'")).select("run_id", "ordinal")


_PAGE = "SELECT run_id, project_id, deleted AS deleted_ms FROM t ORDER BY deleted DESC, project_id, k DESC, run_id LIMIT 11"


@query("SL_2_trash_page", f"WITH {RUNS}, t AS (SELECT * FROM runs WHERE deleted IS NOT NULL AND (deleted < 928195200000 OR (deleted = 928195200000 AND project_id > 'nation2'))) {_PAGE}")
def page(spark, sf_dir):
    """The page behind a cursor in June 1999; expired runs and those being purged stand in it."""
    r = _runs(spark, sf_dir)
    return U.trash_page(r, 10, (928_195_200_000, "nation2", -1, "")).select("run_id", "project_id", _ms("deleted_at").alias("deleted_ms"))


@query("SL_3_key_page", f"WITH {MEDIA} SELECT key FROM media WHERE key > '8' ORDER BY key LIMIT 20")
def keys(spark, sf_dir):
    return U.key_page(A.media(spark, sf_dir).select("key"), "8", 20)


@query(
    "SL_7_purge_candidates",
    f"""WITH {RUNS}, g AS (SELECT * FROM runs WHERE deleted IS NOT NULL)
  SELECT run_id, since_ms FROM (SELECT project_id, run_id, attempt AS since_ms FROM g WHERE attempt < {NOW} UNION ALL SELECT project_id, run_id, deleted + 604800000 FROM g WHERE attempt IS NULL AND deleted + 604800000 <= {NOW})
  ORDER BY since_ms, project_id, run_id LIMIT 30""",
)
def purge_candidates(spark, sf_dir):
    return U.purge_candidates(_runs(spark, sf_dir), NOW, 30).select("run_id", _ms("since").alias("since_ms"))


@query("ST_2_union_of_runs", f"WITH {RUNS}, {DENSE} SELECT project_id, run_id FROM runs UNION SELECT project_id, run_id FROM dense UNION SELECT 'events', 'run' || (user_id % 8) FROM events")
def union(spark, sf_dir):
    """Runs that are registered, and those that only have points."""
    return R.union_runs(_runs(spark, sf_dir), A.dense_points(spark, sf_dir), A.points(spark, sf_dir))


@query(
    "RN_1_status",
    f"""WITH {RUNS}, m AS (SELECT *, created + (k % 8) * 100000 AS now, coalesce(main_at, created) AS main FROM runs), a AS (SELECT *, greatest(coalesce(system_at, main), main) AS alive FROM m)
  SELECT run_id, CASE WHEN exit_code = 0 THEN 'finished' WHEN exit_code IS NOT NULL THEN 'crashed' WHEN now - main < 10000 THEN 'running' WHEN now - alive < 10000 THEN 'stuck' WHEN now - alive < 600000 THEN 'unresponsive' ELSE 'presumed dead' END AS status FROM a""",
)
def status(spark, sf_dir):
    """Each run at a moment of its own up to 700 s behind its creation, which stands in for a main metric where there is none."""
    now = _ms("created_at") + F.col("ordinal") % 8 * 100_000
    return _runs(spark, sf_dir).select("run_id", U.status(now, F.col("exit_code"), _ms("created_at"), _ms("last_main_metric_at"), _ms("last_system_metric_at")).alias("status"))


@query("RN_2_status_candidates", f"WITH {RUNS} SELECT run_id FROM runs WHERE exit_code IS NULL AND deleted IS NULL AND greatest(coalesce(system_at, 0), coalesce(main_at, created)) > 902016000000 - 660000")
def candidates(spark, sf_dir):
    return U.status_candidates(_runs(spark, sf_dir), 902_016_000_000).select("run_id")


@query(
    "RN_6_purge",
    f"""WITH {DENSE}, r AS (SELECT DISTINCT project_id, run_id, substr(run_id, 2)::INTEGER AS k FROM dense), due AS (SELECT project_id, run_id FROM r WHERE k % 3 = 2 OR k % 4 = 1)
  SELECT project_id, run_id, count(*) AS n, false AS tombstone FROM dense WHERE (project_id, run_id) NOT IN (SELECT (project_id, run_id) FROM due) GROUP BY ALL UNION ALL SELECT project_id, run_id, 0, true FROM due""",
)
def purge(spark, sf_dir):
    """Runs past retention and runs claimed before: their points go, and each leaves a tombstone."""
    d = A.dense_points(spark, sf_dir)
    k = F.substring("run_id", 2, 9).cast("int")
    week = F.timestamp_millis(F.lit(NOW - U.RETENTION_MS))
    runs = d.select("project_id", "run_id").distinct().withColumns({"deleted_at": F.when(k % 3 == 2, week).when(k % 3 == 1, week + F.expr("INTERVAL 1 MILLISECOND")), "purging_at": F.when(k % 4 == 1, week)})
    left, gone = U.purge_points(d, U.purge_due(runs, NOW))
    return left.groupBy("project_id", "run_id").agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("tombstone")).unionByName(gone.select("project_id", "run_id", F.lit(0).cast("long").alias("n"), F.lit(True).alias("tombstone")))


@query(
    "RN_7_versions",
    f"""WITH {DENSE}, d AS (SELECT project_id, run_id, step // 10 AS b FROM dense)
  SELECT project_id, run_id, count(DISTINCT b) AS version FROM d GROUP BY ALL UNION ALL SELECT project_id, NULL, count(DISTINCT b) FROM d GROUP BY ALL UNION ALL SELECT NULL, NULL, count(DISTINCT b) FROM d""",
)
def versions(spark, sf_dir):
    """Of every run, every project and the whole."""
    d = A.dense_points(spark, sf_dir).withColumn("batch_id", F.expr("step div 10"))
    return U.all_versions(d).select("project_id", "run_id", "version")


@query(
    "RN_8_changed_since",
    f"""WITH {DENSE}, b AS (SELECT * FROM dense WHERE step < 500), v0 AS (SELECT run_id, count(DISTINCT step // 10) AS v FROM b GROUP BY ALL), v1 AS (SELECT run_id, count(DISTINCT step // 10) AS v FROM dense WHERE run_id <> 's4' OR step < 500 GROUP BY ALL),
  r0 AS (SELECT run_id, metric_name, max(CASE WHEN value IS NOT NULL THEN 2 WHEN cdn_key IS NOT NULL THEN 1 ELSE 3 END) AS c FROM b WHERE metric_name <> 'flag/N' OR run_id <> 's1' GROUP BY ALL),
  r1 AS (SELECT run_id, metric_name, max(CASE WHEN value IS NOT NULL THEN 2 WHEN cdn_key IS NOT NULL THEN 1 ELSE 3 END) AS c FROM dense GROUP BY ALL)
  SELECT v1.run_id, v1.v AS version, EXISTS (SELECT 1 FROM r1 LEFT JOIN r0 ON r0.run_id = r1.run_id AND r0.metric_name = r1.metric_name WHERE r1.run_id = v1.run_id AND (r0.c IS NULL OR r1.c > r0.c)) AS relist FROM v1 LEFT JOIN v0 USING (run_id) WHERE v1.v IS DISTINCT FROM v0.v""",
)
def changed(spark, sf_dir):
    d = A.dense_points(spark, sf_dir).withColumn("batch_id", F.expr("step div 10"))
    b = d.where("step < 500")
    return U.changed_since(U.versions(b), U.versions(d.where("run_id <> 's4' OR step < 500")), R.registry(b.where("metric_name <> 'flag/N' OR run_id <> 's1'")), R.registry(d))


@query(
    "RN_9_media_outcomes",
    """WITH m AS (SELECT 'k' || (o_orderkey % 3000) AS key, (o_orderkey % 5) * 4294967296 + o_orderkey % 3 AS version, 'c' || (o_custkey % 2) AS content, o_orderkey AS position FROM orders),
  h AS (SELECT 'k' || p_partkey AS key, (1 * 4294967296 + 1)::BIGINT AS head, 'c0' AS head_content FROM part), j AS (SELECT m.*, head, head_content FROM m LEFT JOIN h USING (key)),
  w AS (SELECT *, max(version) OVER q AS pv, max((version, content)) OVER q AS pc FROM j WINDOW q AS (PARTITION BY key ORDER BY version, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  z AS (SELECT *, greatest(head, pv) AS top, CASE WHEN pv IS NOT NULL AND (head IS NULL OR pv > head) THEN pc[2] ELSE head_content END AS tc FROM w)
  SELECT position, CASE WHEN version // 4294967296 > 3 THEN 'unallocated epoch' WHEN top IS NULL OR version > top THEN 'accepted' WHEN version < top THEN 'superseded' WHEN tc = content THEN 'idempotent' ELSE 'conflict' END AS outcome FROM z""",
)
def media_outcomes(spark, sf_dir):
    k = F.col("o_orderkey")
    dec = "decimal(20,0)"
    m = A.table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), (k % 3000).cast("string")).alias("key"), ((k % 5).cast(dec) * F.lit(4294967296) + k % 3).cast(dec).alias("version"), F.concat(F.lit("c"), (F.col("o_custkey") % 2).cast("string")).alias("content"), k.alias("position"), F.lit(3).alias("max_epoch"))
    h = A.table(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.lit(4294967297).cast(dec).alias("version"), F.lit("c0").alias("content"))
    return U.media_outcomes(m, h).select("position", "outcome")


@query("RN_10_import_fold", "SELECT 'i' || (o_orderkey % 900) AS run_id, arg_min('n' || o_custkey, o_orderkey) AS run_name, arg_max((o_orderkey % 4)::INTEGER, o_orderkey) AS exit_code FROM orders GROUP BY ALL")
def import_fold(spark, sf_dir):
    k = F.col("o_orderkey")
    o = A.table(spark, sf_dir, "orders").select(F.lit("p").alias("project_id"), F.concat(F.lit("i"), (k % 900).cast("string")).alias("run_id"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("run_name"), F.col("o_orderdate").alias("created_at"), (k % 4).cast("int").alias("exit_code"), F.col("o_orderdate").alias("terminated_at"), k.alias("import_seq"))
    return U.fold_imports(o).select("run_id", "run_name", "exit_code")


@query(
    "RN_11_13_event_fold",
    """WITH e AS (SELECT 'u' || user_id AS run_id, event_id AS seq, CASE WHEN event_id % 19 = 0 THEN 'delete' WHEN event_id % 23 = 0 THEN 'restore' WHEN event_id % 4 = 0 THEN 'rename' WHEN event_id % 29 = 0 THEN 'open' ELSE 'close' END AS kind,
    'n' || (event_id % 50) AS name, (event_id % 3)::INTEGER AS exit_code, event_id * 10 AS t, CASE WHEN event_id % 5 = 2 THEN event_id * 7 % 1000 END AS given FROM events),
  d AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('delete', 'restore') THEN kind END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq), 'restore') AS life FROM e),
  o AS (SELECT *, coalesce(max(CASE WHEN kind = 'open' THEN seq END) OVER (PARTITION BY run_id), -1) AS opened FROM d WHERE life = 'restore' OR kind = 'delete')
  SELECT run_id, arg_max(name, seq) FILTER (kind = 'rename') AS run_name, arg_max(exit_code, seq) FILTER (kind = 'close' AND seq > opened) AS exit_code,
    coalesce(arg_max(given, seq) FILTER (kind = 'close' AND seq > opened AND given IS NOT NULL), arg_min(t, seq) FILTER (kind = 'close' AND seq > opened)) AS ended_at FROM o GROUP BY run_id""",
)
def event_fold(spark, sf_dir):
    k = F.col("event_id")
    e = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), k.alias("seq"), F.when(k % 19 == 0, "delete").when(k % 23 == 0, "restore").when(k % 4 == 0, "rename").when(k % 29 == 0, "open").otherwise("close").alias("kind"),
        F.concat(F.lit("n"), (k % 50).cast("string")).alias("name"), (k % 3).cast("int").alias("exit_code"), (k * 10).alias("at"), F.when(k % 5 == 2, k * 7 % 1000).alias("given_end"),
    )
    return U.fold_events(e)


@query("RN_12_labels", f"WITH {RUNS} SELECT run_id, CASE WHEN count(*) OVER (PARTITION BY project_id, run_name) > 1 THEN run_name || ' #' || k ELSE run_name END AS label FROM runs")
def run_labels(spark, sf_dir):
    return U.labels(_runs(spark, sf_dir)).select("run_id", "label")


@query(
    "SL_8_natural_order",
    """WITH n AS (SELECT DISTINCT o_orderkey % 700 AS n, o_orderkey % 3 AS k, o_custkey % 12 AS h FROM orders),
  t AS (SELECT DISTINCT CASE k WHEN 2 THEN 'Run ' ELSE 'run ' END AS head, CASE k WHEN 0 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END AS a, h::VARCHAR AS b FROM n)
  SELECT head || a || '/h' || b AS name, row_number() OVER (ORDER BY head, length(a), a, length(b), b) - 1 AS place FROM t""",
)
def natural(spark, sf_dir):
    """Names with two numbers, some padded, some in upper case."""
    n, k = F.col("o_orderkey") % 700, F.col("o_orderkey") % 3
    number = F.when(k == 0, n.cast("string")).otherwise(F.lpad(n.cast("string"), 3, "0"))
    name = F.concat(F.when(k == 2, "Run ").otherwise("run "), number, F.lit("/h"), (F.col("o_custkey") % 12).cast("string"))
    keyed = A.table(spark, sf_dir, "orders").select(name.alias("name")).distinct().withColumn("sort_key", X.natural_key(F.col("name")))
    return numbered(keyed, ["sort_key", "name"], "place").select("name", "place")


@query("SL_9_CH_19_auto_dashboard", f"WITH {DENSE} SELECT metric_name, regexp_extract(metric_name, '^(.*)/[^/]*$', 1) AS section, 0 AS priority, 'step' AS axis FROM dense GROUP BY metric_name UNION ALL SELECT m, s, p, 'relative' FROM (VALUES ('system/cpu', 'system', -100), ('logs/out', 'logs', -100)) v(m, s, p)")
def dashboard(spark, sf_dir):
    extra = spark.createDataFrame([("system/cpu", 2), ("logs/out", 3)], "metric_name string, type_code int")
    found = R.registry(A.dense_points(spark, sf_dir)).select("metric_name", "type_code").unionAll(extra)
    return R.panels(found, X.natural_key(F.col("metric_name"))).orderBy(F.desc("priority"), "section", "sort_key").select("metric_name", "section", "priority", "axis")


_GC = f"""{MEDIA}, inv AS (SELECT key, min(created_ms) AS created_ms, max(size) AS size FROM media GROUP BY key), refs AS (SELECT DISTINCT key FROM media WHERE page_id % 3 = 0),
  parsed AS (SELECT key AS parent FROM refs WHERE substr(key, 1, 1) < '8'), kids AS (SELECT DISTINCT 'ffff' || substr(parent, 1, 8) || '.bin' AS key FROM parsed UNION SELECT min(key) FROM media WHERE page_id % 3 = 1),
  referenced AS (SELECT key FROM refs UNION SELECT key FROM kids), acked AS (SELECT DISTINCT key FROM media WHERE page_id % 7 = 1)"""


def _garbage(spark, sf_dir):
    m = A.media(spark, sf_dir)
    inventory = m.groupBy("key").agg(F.min("created_ms").alias("created_ms"), F.max("size").alias("size"))
    roots = G.roots(m.where("page_id % 3 = 0").select(F.col("key").alias("cdn_key")))
    parsed = roots.where(F.substring("key", 1, 1) < "8").select(F.col("key").alias("parent"), F.array(F.concat(F.lit("ffff"), F.substring("key", 1, 8), F.lit(".bin"))).alias("children"))
    extra = m.where("page_id % 3 = 1").agg(F.min("key").alias("key")).select(F.lit(None).cast("string").alias("parent"), F.array("key").alias("children"))
    referenced = G.referenced(roots, parsed.unionAll(extra))
    acked = m.where("page_id % 7 = 1").select("key", F.lit(10**12).alias("acked_ms"))
    return inventory, roots, parsed, referenced, acked


@query("GC_1_roots", f"WITH {MEDIA}, {DENSE} SELECT cdn_key AS key FROM dense WHERE regexp_matches(cdn_key, '^[0-9A-Fa-f]{{4,}}\\.png$') UNION SELECT key FROM media UNION SELECT 'ab12.json'")
def roots(spark, sf_dir):
    """Keys of points and of pages; what is no key of a stored file doesn't count."""
    m = A.media(spark, sf_dir).select(F.col("key").alias("cdn_key"))
    odd = m.select(F.explode(F.array(*[F.lit(k) for k in ("ab12.json", "abc.json", "ab12.exe", "../ab12.json", "ab12.json\n")])).alias("cdn_key"))
    return G.roots(A.dense_points(spark, sf_dir).select("cdn_key"), m, odd)


@query("GC_2_JN_9_unparsed", f"WITH {_GC} SELECT key FROM refs WHERE key NOT IN (SELECT parent FROM parsed)")
def unparsed(spark, sf_dir):
    _, r, parsed, _, _ = _garbage(spark, sf_dir)
    return G.unparsed(r, parsed)


@query("GC_3_JN_10_candidates", f"WITH {_GC} SELECT key, size FROM inv WHERE created_ms < 300000000 AND key NOT IN (SELECT key FROM referenced) AND key NOT IN (SELECT key FROM acked)")
def garbage(spark, sf_dir):
    inv, _, _, ref, acked = _garbage(spark, sf_dir)
    return G.candidates(inv, ref, acked, 300_000_000).select("key", "size")


@query(
    "GC_4_AG_15_report",
    f"""WITH {_GC} SELECT count(*) AS inventory, count(*) FILTER (r) AS referenced, coalesce(sum(size) FILTER (r), 0)::BIGINT AS referenced_bytes, count(*) FILTER (c) AS candidates, coalesce(sum(size) FILTER (c), 0)::BIGINT AS candidate_bytes,
  (SELECT count(*) FROM referenced) AS distinct_references, (SELECT count(*) FROM referenced WHERE key NOT IN (SELECT key FROM inv)) AS dangling, count(*) - count(*) FILTER (r) - count(*) FILTER (c) AS in_grace
  FROM (SELECT *, key IN (SELECT key FROM referenced) AS r, created_ms < 300000000 AND key NOT IN (SELECT key FROM referenced) AND key NOT IN (SELECT key FROM acked) AS c FROM inv)""",
)
def report(spark, sf_dir):
    inv, _, _, ref, acked = _garbage(spark, sf_dir)
    return G.report(inv, ref, acked, 300_000_000)


@query("GC_4_dangling_sample", f"WITH {_GC} SELECT key FROM referenced WHERE key NOT IN (SELECT key FROM inv) ORDER BY key LIMIT 10")
def dangling(spark, sf_dir):
    inv, _, _, ref, _ = _garbage(spark, sf_dir)
    return G.dangling(inv, ref, 10)


@query(
    "GC_5_gate",
    f"""WITH {_GC}, c AS (SELECT count(*) AS n, (SELECT count(*) FROM inv WHERE key IN (SELECT key FROM referenced)) AS held FROM inv WHERE created_ms < 300000000 AND key NOT IN (SELECT key FROM referenced) AND key NOT IN (SELECT key FROM acked)),
  o AS (SELECT count(*) AS n FROM refs WHERE key NOT IN (SELECT parent FROM parsed))
  SELECT 'short log' AS setting, 'the ack log doesn''t cover the grace period' AS gate UNION ALL SELECT 'open roots', CASE WHEN o.n > 0 THEN 'unparsed roots' WHEN c.n > 10000 + 0.1 * held THEN 'too many candidates' ELSE 'open' END FROM c, o
  UNION ALL SELECT 'parsed', CASE WHEN c.n > 10000 + 0.1 * held THEN 'too many candidates' ELSE 'open' END FROM c UNION ALL SELECT 'no allowance', CASE WHEN c.n > 0 THEN 'too many candidates' ELSE 'open' END FROM c
  UNION ALL SELECT 'asked', 'a question is open' UNION ALL SELECT 'another answered', 'a question is open' UNION ALL SELECT 'answered', 'open' UNION ALL SELECT 'answered, open roots', CASE WHEN o.n > 0 THEN 'unparsed roots' ELSE 'open' END FROM o""",
)
def gate(spark, sf_dir):
    """The answer where the log is too short, where roots are unparsed, where all is well, where no candidate is allowed, and
    where a question stands without an answer, with another's, and with its own (which lifts the allowance, nothing else)."""
    inv, r, parsed, ref, acked = _garbage(spark, sf_dir)
    rep, roots_left = G.report(inv, ref, acked, 300_000_000), G.unparsed(r, parsed)
    none = roots_left.limit(0)
    asked = {"short log": G.gate(rep, none, False), "open roots": G.gate(rep, roots_left, True), "parsed": G.gate(rep, none, True), "no allowance": G.gate(rep, none, True, share=0.0, base=0)}
    few = {"share": 0.0, "base": 0, "question": 7}
    asked |= {"asked": G.gate(rep, none, True, **few), "another answered": G.gate(rep, none, True, **few, approval=6), "answered": G.gate(rep, none, True, **few, approval=7), "answered, open roots": G.gate(rep, roots_left, True, **few, approval=7)}
    return reduce(DataFrame.unionAll, [g.select(F.lit(k).alias("setting"), "gate") for k, g in asked.items()])


@query("GC_6_approved_subset", f"WITH {_GC}, c AS (SELECT key FROM inv WHERE created_ms < 300000000 AND key NOT IN (SELECT key FROM referenced) AND key NOT IN (SELECT key FROM acked)) SELECT key FROM c WHERE substr(key, 1, 1) < '4'")
def approved(spark, sf_dir):
    inv, _, _, ref, acked = _garbage(spark, sf_dir)
    c = G.candidates(inv, ref, acked, 300_000_000)
    question = inv.where(F.substring("key", 1, 1) < "4").groupBy(F.substring("key", 1, 2).alias("q")).agg(F.collect_list("key").alias("keys"))
    return G.approved(c, question).select("key")


@query("AG_16_index_check", f"WITH {_GC} SELECT count(*) AS n, count(*) FILTER (m) AS missed, list_sort(list(key) FILTER (m))[1:10] AS sample FROM (SELECT key, key NOT IN (SELECT key FROM referenced) AS m FROM inv)")
def index_check(spark, sf_dir):
    inv, _, _, ref, _ = _garbage(spark, sf_dir)
    return G.index_check(inv, ref, 10)


@query("AG_22_footprint", "SELECT 'documents' AS name, count(*) AS n_rows FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def footprint(spark, sf_dir):
    return G.footprint({n: A.table(spark, sf_dir, n) for n in ("documents", "pages")}).select("name", "n_rows")
