"""Queries over text streams, media and metadata documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import media as M
from ..operators import text as T
from ..sources import adapters as A
from .common import DENSE, MEDIA, TEXTS, registry

ALL, query = registry()

_WHOLE = f"""{TEXTS}, w AS (SELECT run_id, string_agg(replace(replace(text_data, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '' ORDER BY step, metric_name, tag) AS t FROM texts GROUP BY run_id),
  s AS (SELECT run_id, t, string_split(t, chr(10)) AS l FROM w), lines AS (SELECT run_id, i - 1 AS line_index, l[i] AS line FROM (SELECT run_id, l, t, unnest(generate_series(1, len(l) - CASE WHEN t[-1] = chr(10) THEN 1 ELSE 0 END)) AS i FROM s))"""


@query("TX_1_2_chunk_index", f"WITH {TEXTS} SELECT run_id, step, (length(t) - length(replace(t, chr(10), '')))::BIGINT AS newlines, t[-1] = chr(10) AS closed, strlen(t) AS bytes FROM (SELECT *, replace(replace(text_data, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM texts)")
def index(spark, sf_dir):
    return T.chunk_index(A.text_points(spark, sf_dir)).select("run_id", "step", "newlines", "closed", F.col("bytes").cast("long").alias("bytes"))


@query("TX_3_6_lines", f"WITH {_WHOLE} SELECT run_id, line_index, line FROM lines")
def lines(spark, sf_dir):
    return T.lines(A.text_points(spark, sf_dir)).select("run_id", "line_index", "line")


@query("TX_4_search", f"WITH {_WHOLE} SELECT run_id, line_index, row_number() OVER (PARTITION BY run_id ORDER BY line_index) - 1 AS match_index FROM lines WHERE contains(lower(line), 'license')")
def search(spark, sf_dir):
    return T.search(A.text_points(spark, sf_dir), "LICENSE").select("run_id", "line_index", "match_index")


@query("SL_4_line_window", f"WITH {_WHOLE} SELECT run_id, line_index, line FROM lines WHERE line_index BETWEEN 40 AND 139")
def window(spark, sf_dir):
    return T.window(A.text_points(spark, sf_dir), 40, 100).select("run_id", "line_index", "line")


@query("SL_5_tail", f"WITH {_WHOLE} SELECT run_id, line_index, line FROM lines QUALIFY line_index > max(line_index) OVER (PARTITION BY run_id) - 20")
def tail(spark, sf_dir):
    return T.tail(A.text_points(spark, sf_dir), 20).select("run_id", "line_index", "line")


@query("TX_5_window_and_tail", f"""WITH {_WHOLE} SELECT 'window' AS part, run_id, line_index, line FROM lines WHERE line_index BETWEEN 5 AND 14 UNION ALL
  SELECT 'tail', run_id, line_index, line FROM (SELECT * FROM lines QUALIFY line_index > max(line_index) OVER (PARTITION BY run_id) - 3)""")
def window_and_tail(spark, sf_dir):
    """Ten lines from the fifth on and the last three, of every stream."""
    c = A.text_points(spark, sf_dir)
    cols = ["run_id", "line_index", "line"]
    return T.window(c, 5, 10).select(F.lit("window").alias("part"), *cols).unionAll(T.tail(c, 3).select(F.lit("tail"), *cols))


@query("AG_14_WN_12_totals", f"WITH {_WHOLE}, f AS (SELECT run_id, min(step) AS first_step FROM texts WHERE length(text_data) > 0 GROUP BY run_id) SELECT run_id, count(*) AS total_lines, any_value(first_step) AS first_step FROM lines JOIN f USING (run_id) GROUP BY run_id")
def totals(spark, sf_dir):
    return T.totals(T.chunk_index(A.text_points(spark, sf_dir))).select("run_id", F.col("total_lines").cast("long").alias("total_lines"), "first_step")


@query("WN_2_line_offsets", f"WITH {TEXTS} SELECT run_id, step, coalesce(sum(n) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lines_before FROM (SELECT *, length(t) - length(replace(t, chr(10), '')) AS n FROM (SELECT *, replace(replace(text_data, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM texts))")
def offsets(spark, sf_dir):
    return T.placed(T.chunk_index(A.text_points(spark, sf_dir))).select("run_id", "step", "lines_before")


@query(
    "SRC_16_console_chunks",
    """WITH RECURSIVE r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role AS stream, replace(coalesce(text, ''), chr(10), ' ') AS line, CASE WHEN turn % 3 = 1 THEN turn * 7 % 5 END AS ts FROM conversations),
  g AS (SELECT conv_id, n, stream, line, 1 AS island, 0 AS part, length(line) + 1 AS held, coalesce(ts, 0) AS ts FROM r WHERE n = 1
    UNION ALL SELECT r.conv_id, r.n, r.stream, r.line, island + (r.stream IS DISTINCT FROM g.stream)::INT, CASE WHEN r.stream IS DISTINCT FROM g.stream THEN 0 WHEN held + length(r.line) + 1 > 200 THEN part + 1 ELSE part END,
      CASE WHEN r.stream IS DISTINCT FROM g.stream OR held + length(r.line) + 1 > 200 THEN 0 ELSE held END + length(r.line) + 1,
      CASE WHEN r.stream IS DISTINCT FROM g.stream OR held + length(r.line) + 1 > 200 THEN coalesce(r.ts, g.ts) ELSE g.ts END FROM g JOIN r ON r.conv_id = g.conv_id AND r.n = g.n + 1)
  SELECT conv_id, island::BIGINT AS island, part::BIGINT AS part, min(stream) AS stream, min(ts) AS timestamp_ms, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY n) || chr(10) AS text_data FROM g GROUP BY ALL""",
)
def console(spark, sf_dir):
    """The turns of conversations as console lines: the SQL takes them one by one."""
    c = A.table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.col("role").alias("stream"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("line"), F.when(F.col("turn") % 3 == 1, F.col("turn") * 7 % 5).alias("timestamp_ms"))
    return T.pack_lines(rows, ["conv_id"], ["turn"], 200).select("conv_id", F.col("island").cast("long").alias("island"), F.col("part").cast("long").alias("part"), "stream", F.col("timestamp_ms").cast("long").alias("timestamp_ms"), "n_lines", "text_data")


@query(
    "SRC_16_console_cap",
    """WITH r AS (SELECT conv_id, turn, replace(coalesce(text, ''), chr(10), ' ') AS line, sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS after, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations),
  k AS (SELECT *, after <= 400 OR nth = 1 AS keep FROM r), n AS (SELECT conv_id, count(*) FILTER (NOT keep) AS dropped, min(turn) FILTER (keep) AS turn FROM k GROUP BY conv_id)
  SELECT conv_id, turn, 1 AS part, line FROM k WHERE keep UNION ALL SELECT conv_id, turn, 0, '[first ' || dropped || ' console lines omitted]' FROM n WHERE dropped > 0""",
)
def console_cap(spark, sf_dir):
    """The newest lines within 400 characters of each stream, behind a note of what went."""
    c = A.table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.col("role").alias("stream"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("line"))
    return T.cap_lines(rows, ["conv_id"], ["turn"], 400).select("conv_id", "turn", "part", "line")


@query(
    "SRC_17_file_chunks",
    """WITH RECURSIVE d AS (SELECT doc_id, replace(text, '. ', chr(10)) AS text FROM documents WHERE length(text) > 0),
  c AS (SELECT doc_id, text, 0 AS part, 0 AS since, 0 AS until FROM d UNION ALL SELECT doc_id, text, part + 1, until,
    CASE WHEN length(text) - until <= 2000 THEN length(text) ELSE until + CASE WHEN 2000 - strpos(reverse(substr(text, until + 1, 2000)), chr(10)) > 0 AND strpos(reverse(substr(text, until + 1, 2000)), chr(10)) > 0 THEN 2001 - strpos(reverse(substr(text, until + 1, 2000)), chr(10)) ELSE 2000 END END
    FROM c WHERE until < length(text))
  SELECT doc_id::VARCHAR AS path, part - 1 AS part, md5(substr(text, since + 1, until - since)) AS digest, until - since AS n_chars FROM c WHERE part > 0""",
)
def file_chunks(spark, sf_dir):
    """All documents as log files, a sentence a line: where each is cut."""
    files = A.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.replace("text", F.lit(". "), F.lit("\n")).alias("text"))
    return T.cut_file(files, 2000).select("path", "part", F.md5("text_data").alias("digest"), F.length("text_data").alias("n_chars"))


_HEADS = f"""{DENSE}, a AS (SELECT run_id, metric_name, tag, step, cdn_key, 0 AS v, 0::HUGEINT AS version, inserted_ms FROM dense WHERE cdn_key IS NOT NULL),
  b AS (SELECT run_id, metric_name, tag, step, 'b' || substr(cdn_key, 2) AS cdn_key, 1 AS v, (3000000000::HUGEINT * 4294967296 + inserted_ms % 1000) AS version, inserted_ms FROM a WHERE step % 100 = 7),
  h AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY run_id, metric_name, tag, step ORDER BY v DESC, version DESC, inserted_ms DESC, cdn_key DESC) = 1)"""


def _heads(spark, sf_dir):
    d = A.dense_points(spark, sf_dir).where("cdn_key IS NOT NULL").withColumn("inserted_ms", F.unix_millis("inserted_at"))
    v = d.where("step % 100 = 7").withColumn("cdn_key", F.concat(F.lit("b"), F.expr("substr(cdn_key, 2)")))
    v = v.withColumn("version", (F.lit(3000000000).cast("decimal(20,0)") * F.lit(4294967296) + F.col("inserted_ms") % 1000).cast("decimal(20,0)"))
    return M.heads(d, v)


@query("AG_2_ST_1_media_heads", f"WITH {_HEADS} SELECT run_id, metric_name, tag, step, cdn_key FROM h")
def heads(spark, sf_dir):
    return _heads(spark, sf_dir)


@query("MD_1_refs", f"WITH {_HEADS}, r AS (SELECT l_orderkey * 10 + l_linenumber AS position, 's' || (l_suppkey % 10) AS run_id, 'flag/' || l_returnflag AS metric_name, '1' AS tag, l_orderkey % 1000 AS step FROM lineitem) SELECT position, cdn_key FROM r LEFT JOIN h USING (run_id, metric_name, tag, step)")
def refs(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    r = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("run_id"), F.concat(F.lit("flag/"), "l_returnflag").alias("metric_name"), F.lit("1").alias("tag"), (F.col("l_orderkey") % 1000).alias("step"))
    return M.for_refs(r, _heads(spark, sf_dir))


@query("SL_11_latest_keys", f"WITH {_HEADS} SELECT run_id, metric_name, arg_max(cdn_key, (step, tag)) AS cdn_key FROM h GROUP BY ALL")
def latest_keys(spark, sf_dir):
    return M.latest_keys(_heads(spark, sf_dir))


@query(
    "SL_10_MD_10_navigation",
    f"""WITH {_HEADS}, s AS (SELECT DISTINCT run_id, metric_name, step FROM h), q AS (SELECT DISTINCT run_id, metric_name, t AS step FROM s, (VALUES (0), (107), (500), (2000)) v(t))
  SELECT run_id, metric_name, step, (SELECT count(*) FROM s WHERE s.run_id = q.run_id AND s.metric_name = q.metric_name AND s.step < q.step) AS position,
  (SELECT max(step) FROM s WHERE s.run_id = q.run_id AND s.metric_name = q.metric_name AND s.step < q.step) AS previous, (SELECT min(step) FROM s WHERE s.run_id = q.run_id AND s.metric_name = q.metric_name AND s.step > q.step) AS following FROM q""",
)
def navigation(spark, sf_dir):
    s = _heads(spark, sf_dir).select("run_id", "metric_name", "step").distinct()
    at = s.select("run_id", "metric_name").distinct().select("run_id", "metric_name", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 107, 500, 2000)])).alias("step"))
    return M.navigate(s, at)


@query("MD_2_3_manifests", f"WITH {MEDIA} SELECT page_id, [key] AS children FROM media")
def manifests(spark, sf_dir):
    """Manifests with a byte order mark, a NaN, a repeated and an invalid resource."""
    m = A.media(spark, sf_dir)
    doc = F.concat(F.lit('﻿{"v": 1, "class": "gallery", "score": NaN, "items": [{"resource": "'), "key", F.lit('", "caption": "a"}, {"resource": "'), "key", F.lit('"}, {"resource": "../x"}]}'))
    return m.select("page_id", M.children(M.parse_manifest(doc.cast("binary"))).alias("children"))


@query(
    "MD_4_galleries",
    f"""WITH {MEDIA}, g AS (SELECT page_id % 5 AS run_order, page_id // 5 AS i, key FROM media)
  SELECT 'run' AS layout, key || '/' || i AS item, row_number() OVER (ORDER BY run_order, i) - 1 AS place, 0 AS line FROM g UNION ALL SELECT 'index', key || '/' || i, row_number() OVER (ORDER BY i, run_order) - 1, i FROM g
  UNION ALL SELECT 'interleaved', key || '/' || i, row_number() OVER (ORDER BY i, run_order) - 1, 0 FROM g""",
)
def galleries(spark, sf_dir):
    """Each run's items together; a row for each place; or every run's first, then every run's second, without rows."""
    m = A.media(spark, sf_dir)
    k = F.col("page_id")
    rows = m.select((k % 5).alias("run_order"), (k % 5).cast("string").alias("run_id"), F.expr("page_id div 5").alias("i"), F.col("key").alias("item"))
    parts = [M.gallery(rows, x).select(F.lit(x).alias("layout"), F.concat("item", F.lit("/"), F.col("i").cast("string")).alias("item"), F.col("place").cast("long").alias("place"), F.col("row").cast("long").alias("line")) for x in ("run", "index", "interleaved")]
    return reduce(DataFrame.unionAll, parts)


_LEAVES = """l AS (SELECT * FROM (
  SELECT c_custkey AS run_id, '/opt/lr' AS path, (c_custkey % 3)::VARCHAR AS leaf FROM customer UNION ALL SELECT c_custkey, '/opt/a~1b', '"' || c_mktsegment || '"' FROM customer
  UNION ALL SELECT c_custkey, '/seed', '7' FROM customer UNION ALL SELECT c_custkey, '/tags', '[1,2]' FROM customer UNION ALL SELECT c_custkey, '/odd', '1' FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, '/part', CASE WHEN c_custkey % 5 = 0 THEN '3' ELSE '{"x":1}' END FROM customer UNION ALL SELECT c_custkey, '/deep/' || repeat('d/', 9) || 'end', '0' FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT c_custkey, '/void', '{}' FROM customer UNION ALL SELECT c_custkey, '/meta/server_time/end', '"' || c_custkey || '"' FROM customer))"""


def _leaves(spark, sf_dir):
    """Documents with nested, missing and empty objects, one deep path, and one that is an object in some documents only."""
    k = F.col("c_custkey")
    opt = F.struct((k % 3).alias("lr"), F.col("c_mktsegment").alias("a/b"))
    whole = F.to_json(F.struct(opt.alias("opt"), F.lit(7).alias("seed"), F.array(F.lit(1), F.lit(2)).alias("tags"), F.when(k % 2 == 0, 1).alias("odd")))
    more = F.concat(F.lit(',"void":{},"meta":{"server_time":{"end":"'), k.cast("string"), F.lit('"}},"part":'), F.when(k % 5 == 0, "3").otherwise('{"x":1}'), F.when(k % 4 == 0, ',"deep":' + '{"d":' * 9 + '{"end":0}' + "}" * 9).otherwise(""), F.lit("}"))
    doc = F.concat(F.regexp_replace(whole, r"\}$", ""), more)
    return M.flatten(A.table(spark, sf_dir, "customer").select(k.alias("run_id"), doc.alias("doc")))


@query("MD_5_flatten", f"WITH {_LEAVES} SELECT run_id, path, leaf FROM l")
def flatten(spark, sf_dir):
    return _leaves(spark, sf_dir)


@query("MD_6_diff", f"WITH {_LEAVES}, n AS (SELECT count(*) AS runs FROM customer) SELECT path, count(DISTINCT leaf) AS texts, count(*) AS held FROM l, n WHERE path NOT LIKE '/meta/server_time%' GROUP BY path, runs HAVING count(DISTINCT leaf) > 1 OR count(*) < runs")
def diff(spark, sf_dir):
    return M.differing(_leaves(spark, sf_dir), A.table(spark, sf_dir, "customer").count())


@query(
    "MD_7_AG_19_tint",
    f"""WITH {_LEAVES}, c AS (SELECT path, leaf, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT path, max(n) AS top FROM c GROUP BY path), k AS (SELECT path, top, (SELECT count(*) FROM c WHERE c.path = t.path AND c.n = t.top) AS ties FROM t)
  SELECT run_id, l.path, l.leaf FROM l JOIN c ON l.path = c.path AND l.leaf = c.leaf JOIN k ON k.path = l.path WHERE c.n < top OR ties > 1""",
)
def tint(spark, sf_dir):
    return M.tinted(_leaves(spark, sf_dir))


@query(
    "AG_20_class_fold",
    """WITH m AS (SELECT p_brand, p_size, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size < 10 THEN 'metadata' WHEN p_size < 20 THEN 'image_gallery' WHEN p_size < 30 THEN CASE WHEN p_partkey % 2 = 0 THEN 'image_gallery' ELSE 'file_list' END
    WHEN p_size < 40 THEN CASE WHEN p_partkey % 3 = 0 THEN 'metadata' ELSE 'image_gallery' END ELSE 'image_gallery' END AS class, p_size >= 40 AND p_partkey % 2 = 0 AS named FROM part),
  k AS (SELECT p_brand || '/' || p_size AS panel, CASE WHEN class = 'metadata' THEN 'M' WHEN class = 'image_gallery' AND NOT named THEN 'G' WHEN class IS NOT NULL THEN 'F' END AS c FROM m),
  s AS (SELECT panel, coalesce(string_agg(DISTINCT c, '' ORDER BY c), '') AS c FROM k GROUP BY panel)
  SELECT panel, CASE c WHEN '' THEN 'none' WHEN 'M' THEN 'metadata' WHEN 'G' THEN 'image_gallery' WHEN 'F' THEN 'file_list' WHEN 'FG' THEN 'file_list' ELSE 'mixed' END AS class FROM s""",
)
def classes(spark, sf_dir):
    """Panels of metadata, of galleries, of galleries among file lists, and of metadata among galleries."""
    size, k = F.col("p_size"), F.col("p_partkey")
    of = (
        F.when(size % 7 == 0, None).when(size < 10, "metadata").when(size < 20, "image_gallery").when(size < 30, F.when(k % 2 == 0, "image_gallery").otherwise("file_list"))
        .when(size < 40, F.when(k % 3 == 0, "metadata").otherwise("image_gallery")).otherwise("image_gallery")
    )
    part = A.table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", size.cast("string")).alias("panel"), of.alias("class"), ((size >= 40) & (k % 2 == 0)).alias("named"))
    return M.fold_classes(part, "panel")


@query(
    "MD_8_JN_11_timing",
    """WITH s AS (SELECT o_orderkey, (o_orderkey * 3607) % 200000 AS s FROM orders)
  SELECT o_orderkey, CASE WHEN s >= 86400 THEN (s // 86400) || 'd' || CASE WHEN s // 3600 % 24 > 0 THEN ' ' || (s // 3600 % 24) || 'h' ELSE '' END WHEN s >= 3600 THEN (s // 3600) || 'h' || CASE WHEN s // 60 % 60 > 0 THEN ' ' || (s // 60 % 60) || 'm' ELSE '' END
    WHEN s >= 60 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END WHEN s > 0 THEN s || 's' ELSE '<1s' END AS span FROM s""",
)
def timing(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", M.compact_span((F.col("o_orderkey") * 3607) % 200_000 * 1000).alias("span"))


@query(
    "JN_11_run_info",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS f, strftime(make_timestamp(c_custkey * 1000000), '%Y-%m-%d %H:%M:%S') AS made, strftime(make_timestamp((c_custkey + 65) * 1000000), '%Y-%m-%d %H:%M:%S') AS ended, strftime(make_timestamp((c_custkey + 9) * 1000000), '%Y-%m-%d %H:%M:%S') AS last FROM customer)
  SELECT k AS run_id, CASE f WHEN 0 THEN '{"a":1,"meta":{"server_time":{"end":"' || ended || '","last_ingested":"' || last || '","run_created":"' || made || '","wall_span":"1m 5s"}}}'
    WHEN 1 THEN '{"meta":{"server_time":{"last_ingested":"' || last || '","own":2,"run_created":"' || made || '"},"time":{"start":"x"}}}' WHEN 2 THEN '{"meta":{"server_time":{"run_created":"' || made || '"}}}' WHEN 3 THEN '{"meta":[1]}' ELSE '[1]' END AS doc FROM c""",
)
def run_info(spark, sf_dir):
    """Runs that ended, that are over without an end, and that go on; documents whose ``meta`` or root is no object."""
    k = F.col("c_custkey")
    f = k % 5
    c = A.table(spark, sf_dir, "customer")
    doc = F.when(f == 0, '{"a":1}').when(f == 1, '{"meta":{"time":{"start":"x"},"server_time":{"own":2}}}').when(f == 2, "{}").when(f == 3, '{"meta":[1]}').otherwise("[1]")
    runs = c.select(k.alias("run_id"), (k * 1000).alias("created_ms"), F.when(f == 0, (k + 65) * 1000).alias("ended_ms"), ((k + 9) * 1000).alias("last_ms"), (f == 1).alias("over"))
    return M.with_timing(c.select(k.alias("run_id"), doc.alias("doc")), runs)


@query("MD_9_content_ids", "SELECT page_id, sha256(coalesce(html, '')) || '.bin' AS id FROM pages")
def content_ids(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", M.content_id(F.coalesce("html", F.lit("")).cast("binary"), F.lit("bin")).alias("id"))


@query("MD_11_config_merge", "SELECT run_id, key, arg_max(value, version) AS value FROM (SELECT o_custkey AS run_id, o_orderkey AS version, 'lr' AS key, (o_orderkey % 9)::VARCHAR AS value FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'k' || (o_orderkey % 4), o_orderstatus FROM orders) GROUP BY ALL")
def config(spark, sf_dir):
    k = F.col("o_orderkey")
    doc = F.to_json(F.map_concat(F.create_map(F.lit("lr"), (k % 9).cast("string")), F.create_map(F.concat(F.lit("k"), (k % 4).cast("string")), F.col("o_orderstatus"))))
    return M.merge_config(A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), k.alias("version"), doc.alias("doc")))


@query("SNK_2_tsv_cells", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '''=' || p_name WHEN 1 THEN 'a ' || p_name WHEN 2 THEN ''' ' || chr(160) || '@' || p_name WHEN 3 THEN 'b  ' || p_name WHEN 4 THEN ''' +' || p_name ELSE p_name END AS cell, CASE p_partkey % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '' ELSE '1.5' END AS number FROM part")
def tsv(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    heads = ["=", "a\t\r\n", " \u00a0@", "b \u2028\u2029", "\t+", ""]
    text = F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), (k % 6 + 1).cast("int")), n)
    value = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("inf")).when(k % 4 == 3, 1.5)
    return A.table(spark, sf_dir, "part").select("p_partkey", X.tsv_cell(text).alias("cell"), X.tsv_number(value).alias("number"))


@query("CH_20_ema_width", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount > 0 AND l_discount < 1 THEN greatest(-1 / ln(1 - l_discount), 1) ELSE 10 END, 6) AS tau FROM lineitem")
def ema_width(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(X.ema_width(F.col("l_discount")), 6).alias("tau"))
