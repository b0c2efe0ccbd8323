"""Media keys, manifests, galleries and metadata documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import checkpointed, running_total
from .registry import is_media_key

KEY = ["run_id", "metric_name", "tag", "step"]


def heads(plain: DataFrame, versioned: DataFrame) -> DataFrame:
    """Newest media key of each point over both tables: versioned rows win, then the version, then the time of insertion."""
    dec = "decimal(20,0)"
    a = plain.select(*KEY, "cdn_key", F.lit(0).alias("_v"), F.lit(0).cast(dec).alias("version"), "inserted_ms")
    b = versioned.select(*KEY, "cdn_key", F.lit(1).alias("_v"), F.col("version").cast(dec).alias("version"), "inserted_ms")
    return a.unionByName(b).groupBy(*KEY).agg(F.max(F.struct("_v", "version", "inserted_ms", "cdn_key")).alias("h")).select(*KEY, F.col("h.cdn_key").alias("cdn_key"))


def for_refs(refs: DataFrame, head: DataFrame) -> DataFrame:
    """Media keys of the asked refs (position, run, metric, tag, step), in their order; a repeated ref is answered each time."""
    return refs.join(head, KEY, "left").select("position", "cdn_key").orderBy("position")


def latest_keys(head: DataFrame) -> DataFrame:
    return head.groupBy("run_id", "metric_name").agg(F.max_by("cdn_key", F.struct("step", "tag")).alias("cdn_key"))


def navigate(steps: DataFrame, at: DataFrame) -> DataFrame:
    """Of each asked step: its insertion point among a series' media steps, the step before and the step after."""
    both = at.select("run_id", "metric_name", F.col("step").alias("s"), F.lit(1).alias("asked")).unionAll(steps.select("run_id", "metric_name", "step", F.lit(0)))
    w = Window.partitionBy("run_id", "metric_name").orderBy("s")
    step = F.when(F.col("asked") == 0, F.col("s"))
    below, above = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(1, Window.unboundedFollowing)
    out = both.withColumns({"previous": F.max(step).over(below), "following": F.min(step).over(above), "position": F.count(step).over(below)})
    return out.where("asked = 1").select("run_id", "metric_name", F.col("s").alias("step"), "position", "previous", "following").distinct()


_SERVER_TIME = "/meta/server_time"
_MANIFEST = "v int, class string, items array<struct<resource:string,filename:string,caption:string>>, data string"


def parse_manifest(raw: Column) -> Column:
    """A manifest's struct: a byte order mark is cut, bad UTF-8 replaced, NaN and Infinity allowed; null if it is none."""
    text = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "^﻿", "")
    return F.from_json(text, _MANIFEST, {"allowNonNumericNumbers": "true", "mode": "PERMISSIVE"})


def children(manifest: Column) -> Column:
    """Valid keys of a manifest's items, sorted, each once."""
    keys = F.filter(F.transform(manifest["items"], lambda x: x.resource), lambda k: is_media_key(k))
    return F.coalesce(F.array_sort(F.array_distinct(keys)), F.array().cast("array<string>"))


def fold_classes(manifests: DataFrame, by: str) -> DataFrame:
    """What a set of manifests (class, named: whether an item has a file name) is shown as: metadata or image_gallery if all
    are, file_list if galleries and file lists meet, mixed if metadata meets anything else. Rows without a class don't count."""
    meta = F.col("class") == "metadata"
    images = (F.col("class") == "image_gallery") & ~F.coalesce("named", F.lit(False))
    g = manifests.groupBy(by).agg(F.bool_or(meta).alias("some"), F.bool_and(meta).alias("all"), F.bool_and(images).alias("images"))
    return g.select(by, F.when(F.col("some").isNull(), "none").when(F.col("all"), "metadata").when(F.col("some"), "mixed").when(F.col("images"), "image_gallery").otherwise("file_list").alias("class"))


def gallery(items: DataFrame, layout: str) -> DataFrame:
    """Items of several runs (run_order, run_id, items; or flat, run_order, run_id, i, item) in order: ``run`` keeps a run's items together, ``index`` and
    ``interleaved`` take every run's first, then every run's second, and so on; ``index`` begins a row with each."""
    flat = items.select("run_order", "run_id", *(["i", "item"] if "item" in items.columns else [F.posexplode("items").alias("i", "item")]))
    order = ["run_order", "i"] if layout == "run" else ["i", "run_order"]
    # places come from counts for each leading key, which are summed by ranges, so that no window holds all items or keys
    start = running_total(flat.groupBy(order[0]).agg(F.count(F.lit(1)).alias("n")), order[0], "n", "start").drop("n")
    inside = F.row_number().over(Window.partitionBy(order[0]).orderBy(order[1])) - 1
    out = flat.withColumn("_in", inside).join(start, order[0])
    return out.select("run_id", "i", "item", (F.col("start") + F.col("_in")).alias("place"), (F.col(order[0]) if layout == "index" else F.lit(0)).alias("row"))


def content_id(raw: Column, extension: Column) -> Column:
    return F.concat(F.sha2(raw, 256), F.lit("."), extension)


def flatten(docs: DataFrame) -> DataFrame:
    """Leaves of JSON objects: JSON Pointer path (``~`` and ``/`` escaped) and JSON text.

    A path is a branch if its values are objects in all documents that have it and one of these holds a key; all else, such
    as arrays, empty objects and what is an object in some documents only, is a leaf. A round for each level of nesting."""
    level = docs.select("run_id", F.lit("").alias("path"), F.try_parse_json("doc").alias("v")).where("schema_of_variant(v) LIKE 'OBJECT<%'")
    out = None
    while True:
        each = level.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", "value")).where("key IS NOT NULL")
        key = F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        each = each.select("run_id", F.concat("path", F.lit("/"), key).alias("path"), F.col("value").alias("v"), F.schema_of_variant("value").alias("shape"))
        each = checkpointed(each)
        of = each.groupBy("path").agg((F.bool_and(F.col("shape").startswith("OBJECT<")) & F.bool_or(F.col("shape").startswith("OBJECT<") & (F.col("shape") != "OBJECT<>"))).alias("branch"))
        told = each.join(of, "path")
        leaves = told.where("NOT branch").select("run_id", "path", F.to_json("v").alias("leaf"))
        out = leaves if out is None else out.unionAll(leaves)
        level = told.where("branch").select("run_id", "path", "v")
        if level.isEmpty():
            return out


def differing(leaves: DataFrame, n_runs: int) -> DataFrame:
    """Paths whose text differs over the runs; a run without the path counts as different. The server's own times (what
    ``with_timing`` adds below ``/meta/server_time``) don't count."""
    own = (F.col("path") == _SERVER_TIME) | F.col("path").startswith(_SERVER_TIME + "/")
    g = leaves.where(~own).groupBy("path").agg(F.countDistinct("leaf").alias("texts"), F.count(F.lit(1)).alias("held"))
    return g.where((F.col("texts") > 1) | (F.col("held") < n_runs)).select("path", "texts", "held")


def tinted(leaves: DataFrame) -> DataFrame:
    """Cells outside a path's one most frequent text; where several are as frequent, all are. Texts are counted before they
    meet the cells, so a text that all runs share is no hot task."""
    counts = checkpointed(leaves.groupBy("path", "leaf").agg(F.count(F.lit(1)).alias("n")))
    top = counts.groupBy("path").agg(F.max("n").alias("top"))
    ties = counts.join(top, "path").where("n = top").groupBy("path", "top").agg(F.count(F.lit(1)).alias("ties"))
    outside = counts.join(ties, "path").where("n < top OR ties > 1").select("path", "leaf")
    return leaves.join(outside, ["path", "leaf"], "left_semi").select("run_id", "path", "leaf")


def with_timing(docs: DataFrame, runs: DataFrame, time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Run information (run_id, doc) with the server's times added inside ``meta.server_time``: creation; the last ingest of a
    run that is over; its end and wall span. Keys that stand there under other names stay, and a document whose root, ``meta``
    or ``meta.server_time`` is no object is left as it is. ``runs``: run_id, created_ms, ended_ms, last_ms, over (a terminal state)."""
    at = lambda ms: F.date_format(F.timestamp_millis(ms), time_format)
    over = F.col("ended_ms").isNotNull() | F.coalesce("over", F.lit(False))
    given = F.struct(
        at(F.col("created_ms")).alias("run_created"), F.when(over, at(F.col("last_ms"))).alias("last_ingested"), at(F.col("ended_ms")).alias("end"), compact_span(F.col("ended_ms") - F.col("created_ms")).alias("wall_span")
    )
    t = runs.select("run_id", F.from_json(F.to_json(given), "map<string,variant>").alias("_times"))
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    is_object = lambda v: v.isNull() | F.schema_of_variant(v).startswith("OBJECT")
    empty = F.create_map().cast("map<string,variant>")
    rows = docs.join(t, "run_id", "left").withColumn("_v", F.try_parse_json("doc"))
    meta, held = F.try_variant_get("_v", "$.meta", "variant"), F.try_variant_get("_v", "$.meta.server_time", "variant")
    fits = F.col("_times").isNotNull() & F.col("_v").isNotNull() & is_object(F.col("_v")) & is_object(meta) & is_object(held)
    times = F.map_concat(F.map_filter(F.coalesce(fields(held), empty), lambda k, _: ~F.map_contains_key("_times", k)), "_times")
    put = lambda base, name, value: F.to_variant_object(F.map_concat(F.map_filter(F.coalesce(base, empty), lambda k, _: k != name), F.create_map(F.lit(name), value)))
    whole = put(fields(F.col("_v")), "meta", put(fields(meta), "server_time", F.to_variant_object(times)))
    return rows.select("run_id", F.when(fits, F.to_json(whole)).otherwise(F.col("doc")).alias("doc"))


def compact_span(ms: Column) -> Column:
    """Two leading units of a duration, the second only where it isn't 0: 1d 3h, 2h, 4m 10s, 12s, <1s."""
    s = F.greatest(F.floor(ms / 1000), F.lit(0))
    d, h, m = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    two = lambda a, u, b, v: F.concat(a.cast("string"), F.lit(u), F.when(b == 0, "").otherwise(F.concat(F.lit(" "), b.cast("string"), F.lit(v))))
    return F.when(ms.isNull(), None).when(d > 0, two(d, "d", h, "h")).when(h > 0, two(h, "h", m, "m")).when(m > 0, two(m, "m", s % 60, "s")).when(s > 0, F.concat(s.cast("string"), F.lit("s"))).otherwise("<1s")


def merge_config(updates: DataFrame) -> DataFrame:
    """Top-level keys of a run's configuration, each from the last update that has it."""
    pairs = updates.select("run_id", "version", F.explode(F.from_json("doc", "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("run_id", "key").agg(F.max_by("value", "version").alias("value"))
