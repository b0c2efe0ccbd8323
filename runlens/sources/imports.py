"""Importing experiment histories: wide tables, JSON lines, struct and media cells, system columns, run identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import FLOAT_MAX, is_finite, truncate_bytes
from ..operators.points import monotone_steps
from ..operators.registry import EXTENSIONS
from ..plans.scan import place
from ..plans.scratch import checkpointed

#: Characters of a text chunk, its terminator included.
TEXT_CHARS = 64_000
#: Fields of summary statistics and the metrics they become.
STATS = {"-Inf": "neg_inf", "Inf": "inf", "Nan": "nan", "Count": "count", "Max": "max", "Min": "min", "Sum": "sum"}

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def column_kinds(schema: T.StructType) -> dict[str, str]:
    """Kind of each history column by its type: numeric, text, struct, skipped (starting with _) or unsupported."""
    out = {}
    for f in schema.fields:
        t = f.dataType
        out[f.name] = "skipped" if f.name.startswith("_") else "numeric" if isinstance(t, _NUMERIC) else "text" if isinstance(t, (T.StringType, T.BinaryType)) else "struct" if isinstance(t, T.StructType) else "unsupported"
    return out


def _imported(v: Column) -> Column:
    """A value past the float range is NaN."""
    d = v.cast("double")
    return F.when(is_finite(d) & (F.abs(d) > FLOAT_MAX), F.lit(float("nan"))).otherwise(d).cast("float")


def text_line(text: Column) -> Column:
    """A text cell as a line: at most ``TEXT_CHARS`` characters with its one terminator."""
    return F.concat(F.regexp_replace(F.left(text, F.lit(TEXT_CHARS - 1)), r"\n\z", ""), F.lit("\n"))


def unpivot_history(df: DataFrame, created_ms: int, order: list[str]) -> DataFrame:
    """Each non-``_`` column of history rows (run_id, ..) -> points (run_id, step, timestamp_ms, metric_name, value or text_data).

    Numbers stand at their row's step. A text cell becomes a line at its row's time, later where the metric has one there
    already. ``order``: what rows of a run go by; empty texts and nulls give no point."""
    kinds = column_kinds(df.drop("run_id", *order).schema)
    numbers = [c for c, k in kinds.items() if k == "numeric"]
    texts = [c for c, k in kinds.items() if k == "text"]
    for axis in ("_step", "_timestamp"):
        df = df if axis in df.columns else df.withColumn(axis, F.lit(None).cast("double"))
    rows = row_axes(df, ["run_id"], order, created_ms)
    ids = ["run_id", "step", "timestamp_ms"]
    out = None
    if numbers:
        wide = rows.select(*ids, *[_imported(F.col(c)).alias(c) for c in numbers])
        out = wide.unpivot(ids, numbers, "metric_name", "value").where("value IS NOT NULL").withColumn("text_data", F.lit(None).cast("string"))
    if texts:
        long = rows.select(*ids, F.struct(*order).alias("_at"), *[F.make_valid_utf8(F.col(c).cast("string")).alias(c) for c in texts]).unpivot([*ids, "_at"], texts, "metric_name", "text_data").where("text_data <> ''")
        stepped = monotone_steps(long.drop("step"), ["run_id", "metric_name"], ["_at"], "timestamp_ms")
        lines = stepped.select(*ids, "metric_name", F.lit(None).cast("float").alias("value"), text_line(F.col("text_data")).alias("text_data"))
        out = lines if out is None else out.unionByName(lines)
    return out


def row_axes(df: DataFrame, run: list[str], order: list[str], created_ms: int) -> DataFrame:
    """step: ``_step``, else the row's place in its run; timestamp_ms: ``_timestamp`` in seconds, else the run's creation."""
    return place(df, run, order, "_place").withColumn("step", F.coalesce(F.col("_step").cast("long"), F.col("_place"))).drop("_place").withColumn("timestamp_ms", F.coalesce((F.col("_timestamp") * 1000).cast("long"), F.lit(created_ms).cast("long")))


def jsonl_points(lines: DataFrame, by: list[str], order: list[str], created_ms: int, column: str = "line") -> DataFrame:
    """JSON lines of runs (``by``), in order, -> points (by.., step, timestamp_ms, metric_name, value or text_data).

    A line that is no object is skipped. ``_step`` and ``_timestamp`` (seconds) default to 0 and the run's creation. Numbers and
    booleans stand at their line's step, NaN past the float range; NaN and Infinity are read as numbers. A text that isn't
    empty becomes a terminated line at its time, later where the metric has one there. Objects are scalars whose type varied
    (all fields start with ``_type_``: the first number or text of them, if it reads as a number) or summary statistics, each
    number of which is a metric of its own; media, histograms and lists give no points."""
    # whatever isn't an object has no keys; a filter above the parsed lines would be pushed below and parse them again
    rows = lines.select(*by, *order, F.try_parse_json(_finite_json(F.col(column))).alias("v"))
    stamp, seconds = F.try_variant_get("v", "$._timestamp", "double"), F.try_variant_get("v", "$._timestamp", "long")
    # whole seconds stay integers, as a double rounds milliseconds past 2^53
    ms = F.when(seconds.cast("double") == stamp, seconds * 1000).otherwise((stamp * 1000).cast("long"))
    rows = rows.select(*by, *order, F.coalesce(F.try_variant_get("v", "$._step", "long"), F.lit(0).cast("long")).alias("step"), F.coalesce(ms, F.lit(created_ms).cast("long")).alias("timestamp_ms"), "v")
    cells = rows.lateralJoin(_exploded()).where("NOT startswith(key, '_')").drop("v").withColumn("kind", F.schema_of_variant("value"))
    # columns of their own, as they are read many times; an object whose first field is no one's gives nothing
    able = F.col("kind").rlike("^OBJECT<`?(_type_|" + "|".join(STATS) + ")")
    held = cells.where("kind <> 'STRING'").withColumns({"fields": F.when(able, F.try_variant_get("value", "$", "map<string,variant>")), "plain": _json_number(F.col("value"))})
    fields, keys = F.col("fields"), F.map_keys("fields")
    number = lambda name, d: F.struct(name.alias("metric_name"), d.alias("d"))
    many = F.transform(F.map_entries(fields), lambda e: number(F.concat(F.col("key"), F.lit("/"), F.element_at(F.create_map(*[F.lit(x) for pair in STATS.items() for x in pair]), e.key)), F.coalesce(_json_number(e.value), _union_number(F.try_variant_get(e.value, "$", "map<string,variant>")))))
    found = F.when(F.col("plain").isNotNull(), F.array(number(F.col("key"), F.col("plain")))).when(fields.isNull(), None)
    found = found.when(F.forall(keys, lambda k: k.startswith("_type_")), F.array(number(F.col("key"), _union_number(fields)))).when(F.forall(keys, lambda k: k.isin(*STATS)), many)
    ids = [*by, "step", "timestamp_ms"]
    numbers = held.select(*ids, F.explode(found).alias("p")).select(*ids, "p.metric_name", _imported(F.col("p.d")).alias("value"), F.lit(None).cast("string").alias("text_data")).where("value IS NOT NULL")
    # keys in a struct, as nulls in it are equal: lines of no run keep their texts too
    told = cells.where("kind = 'STRING'").select(F.struct(*by, F.col("key").alias("metric_name")).alias("_key"), *order, "timestamp_ms", F.expr("try_variant_get(value, '$', 'string')").alias("text")).where("text <> ''")
    # stored, so that dealing and its sample don't parse the lines again
    stepped = monotone_steps(checkpointed(told), ["_key"], order, "timestamp_ms").select("_key.*", "step", "timestamp_ms", "text")
    texts = stepped.select(*ids, "metric_name", F.lit(None).cast("float").alias("value"), text_line(F.col("text")).alias("text_data"))
    return numbers.unionAll(texts)


def _finite_json(line: Column) -> Column:
    """JSON in which NaN and infinities, outside texts, are objects of one text field that ``_union_number`` reads."""
    outside = r'(?>[^"IN\-]+|"(?>[^"\\]+|\\.)*+"|(?!-?Infinity|NaN).)*+'
    changed = F.regexp_replace(line, rf"(?s)\G({outside})(-?Infinity|NaN)", '$1{"_type_text":"$2"}')
    return F.when(line.rlike("Infinity|NaN"), changed).otherwise(line)


def _json_number(v: Column) -> Column:
    """A number or boolean of JSON as a double, else null."""
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)"), F.coalesce(F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "boolean").cast("double")))


def _union_number(fields: Column) -> Column:
    """The first number or text among fields, if it reads as a number."""
    scalar = F.filter(F.map_values(fields), lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|BOOLEAN|STRING)"))
    first = F.get(scalar, F.lit(0))
    return F.coalesce(_json_number(first), F.when(F.schema_of_variant(first) == "STRING", F.try_variant_get(first, "$", "string").try_cast("double")))


def _exploded() -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().tvf.variant_explode(F.col("v").outer()).select("key", "value")


def _shape(t: T.StructType) -> str:
    """What a struct cell is, by its fields: a scalar whose type varied, summary statistics, or media."""
    names = t.fieldNames()
    if names and all(n.startswith("_type_") for n in names):
        return "union"
    return "stats" if names and set(names) <= STATS.keys() else "media"


def _scalar(cell: str, t: T.StructType) -> Column:
    """The first number or text among a union's members, as text."""
    members = [f.name for f in t.fields if isinstance(f.dataType, (*_NUMERIC, T.StringType))]
    return F.coalesce(*[F.when(F.col(f"{cell}.`{n}`").isNotNull(), F.col(f"{cell}.`{n}`").cast("double").cast("string") if isinstance(t[n].dataType, _NUMERIC) else F.col(f"{cell}.`{n}`")) for n in members], F.lit(None))


def struct_points(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points (keys.., metric_name, value) of struct cells: a union's scalar (a text counts if it is a number), and each
    field of summary statistics as metric/field. Media cells and histograms give none."""
    cells = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.StructType):
            continue
        kind = _shape(f.dataType)
        if kind == "union":
            cells.append(F.struct(F.lit(f.name).alias("metric_name"), _scalar(f"`{f.name}`", f.dataType).alias("c")))
        elif kind == "stats":
            cells += [F.struct(F.lit(f"{f.name}/{STATS[n]}").alias("metric_name"), F.col(f"`{f.name}`.`{n}`").cast("double").cast("string").alias("c")) for n in f.dataType.fieldNames() if isinstance(f.dataType[n].dataType, _NUMERIC)]
    found = F.expr("try_cast(c AS double)")
    return df.select(*keys, F.explode(F.array(*cells)).alias("p")).select(*keys, "p.*").where("c IS NOT NULL").select(*keys, "metric_name", _imported(found).cast("double").alias("value")).where("value IS NOT NULL")


def struct_counts(df: DataFrame) -> DataFrame:
    """One row: how many struct cells are statistics that expand, histograms or texts under a union that are no number."""
    stats, histograms, texts = [], [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            kind, cell = _shape(f.dataType), F.col(f"`{f.name}`")
            if kind == "stats":
                stats.append(F.coalesce(*[F.col(f"`{f.name}`.`{n}`").isNotNull().cast("long") for n in f.dataType.fieldNames()], F.lit(0)) if len(f.dataType) == 1 else F.greatest(*[F.col(f"`{f.name}`.`{n}`").isNotNull().cast("long") for n in f.dataType.fieldNames()]))
            elif kind == "union":
                text = _scalar(f"`{f.name}`", f.dataType)
                texts.append((text.isNotNull() & text.try_cast("double").isNull()).cast("long"))
            elif "_type" in f.dataType.fieldNames():
                histograms.append((cell["_type"] == "histogram").cast("long"))
    total = lambda cs: F.coalesce(sum((F.sum(c) for c in cs[1:]), F.sum(cs[0])), F.lit(0)) if cs else F.lit(0).cast("long")
    return df.agg(total(stats).alias("stats_expanded"), total(histograms).alias("histograms_skipped"), total(texts).alias("texts_skipped"))


def _caption(v: Column) -> Column:
    """A caption's text: of a union its text or flag, of a list the parts that say something."""

    def plain(c: Column) -> Column:
        kind = F.schema_of_variant(c)
        return F.when(c.isNull() | (kind == "VOID"), "").when(kind == "BOOLEAN", F.initcap(F.try_variant_get(c, "$", "string"))).when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(c, "$._type_utf8", "string"), F.initcap(F.try_variant_get(c, "$._type_bool", "string")), F.lit(""))).otherwise(F.try_variant_get(c, "$", "string"))

    parts = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), plain), lambda t: t != "")
    return F.coalesce(F.when(F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False)), F.trim(F.array_join(parts, " "))).otherwise(plain(v)), F.lit(""))


def media_items(df: DataFrame, keys: list[str], cell: str, metric: str | None = None, step: str | None = None) -> DataFrame:
    """Gallery items (keys.., i, filename, caption, extension) of media cells in JSON; ``keys`` tell the cells apart.

    A cell lists ``filenames`` with ``captions``, or has one ``path``, or holds such cells in a list, however deep (the first
    list in order of names that has any), or, written before files were named, only a count, from which names are made with
    the metric's name and step (columns ``metric`` and ``step``). Paths that are absolute or lead upwards are dropped."""
    extra = [c for c in (metric, step) if c and c not in keys]
    cells = df.select(*keys, *extra, F.array().cast("array<int>").alias("_at"), F.try_parse_json(cell).alias("_v"))
    names = F.try_variant_get("_v", "$.filenames", "array<variant>")
    captions = F.try_variant_get("_v", "$.captions", "array<variant>")
    listed = F.transform(names, lambda n, i: F.struct(F.when(F.schema_of_variant(n) == "STRING", F.try_variant_get(n, "$", "string")).alias("filename"), _caption(F.get(captions, i)).alias("caption")))
    path = F.when(F.schema_of_variant(F.try_variant_get("_v", "$.path", "variant")) == "STRING", F.try_variant_get("_v", "$.path", "string"))
    one = F.array(F.struct(path.alias("filename"), _caption(F.try_variant_get("_v", "$.caption", "variant")).alias("caption")))
    done, level = None, cells
    while True:  # a level of nesting each time; cells that list their own files leave
        level = checkpointed(level.withColumn("_items", F.when(names.isNotNull(), listed).when(path != "", one)))
        found = level.where("_items IS NOT NULL").select(*keys, "_at", "_items")
        done = found if done is None else done.unionAll(found)
        inner = level.where("_items IS NULL AND schema_of_variant(_v) LIKE 'OBJECT%'")
        fields = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()).select("pos", "value")).where("schema_of_variant(value) LIKE 'ARRAY<OBJECT%'")
        nested = fields.select(*keys, *extra, F.col("_at").alias("_was"), F.col("pos").alias("_field"), F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("_j", "_v"))
        level = nested.select(*keys, *extra, F.concat("_was", F.array("_field", "_j")).alias("_at"), "_v")
        if level.isEmpty():
            break
    flat = done.select(*keys, "_at", F.posexplode("_items").alias("_k", "_item")).where("_item.filename <> ''").withColumn("_list", F.coalesce(F.get("_at", F.lit(0)), F.lit(-1)))
    cell_of = Window.partitionBy(*keys)
    flat = flat.withColumn("_first", F.min("_list").over(cell_of)).where("_list = _first")
    place = (F.row_number().over(cell_of.orderBy("_at", "_k")) - 1).alias("i")
    out = flat.select(*keys, place, F.col("_item.filename").alias("filename"), F.col("_item.caption").alias("caption"))
    if metric and step:
        count, form = F.try_variant_get("_v", "$.count", "int"), F.lower(F.coalesce(F.try_variant_get("_v", "$.format", "string"), F.lit("png")))
        bare = cells.join(out.select(*keys).distinct(), keys, "left_anti").where((count > 0) & F.try_variant_get("_v", "$._type", "string").startswith("images"))
        made = bare.select(*keys, *extra, F.explode(F.sequence(F.lit(0), count - 1)).alias("i"), form.alias("_form"), captions.alias("_captions"))
        name = F.concat(F.lit("media/images/"), F.col(metric), F.lit("_"), F.col(step).cast("string"), F.lit("_"), F.col("i").cast("string"), F.lit("."), F.col("_form"))
        out = out.unionAll(made.select(*keys, "i", name, _caption(F.get("_captions", F.col("i")))))
    safe = ~F.col("filename").startswith("/") & ~F.col("filename").rlike(r"(^|/)\.\.(/|$)")
    return out.where(safe).withColumn("extension", form_of(F.col("filename")))


def form_of(filename: Column) -> Column:
    """A file's extension in lower case; ``bin`` for one that is not stored as such."""
    ext = F.lower(F.regexp_extract(filename, r"[^/.][^/]*\.([^./]+)$", 1))
    return F.when(ext.isin(*EXTENSIONS), ext).otherwise("bin")


def words(name: Column) -> Column:
    """A name's words in small letters with ``_`` between: a word begins at a capital behind a small letter or a digit."""
    return F.lower(F.array_join(F.split(name, "(?<=[a-z0-9])(?=[A-Z])"), "_"))


#: Metrics of exported accelerator columns.
ACCELERATOR = {
    "gpu": "gpu_util_pct", "memory": "gpu_mem_util_pct", "memoryAllocated": "gpu_mem_used_pct", "memoryAllocatedBytes": "gpu_mem_used_bytes", "temp": "gpu_temp_c", "powerWatts": "gpu_power_w",
    "powerPercent": "gpu_power_pct", "enforcedPowerLimitWatts": "gpu_power_limit_w", "smClock": "gpu_sm_clock_mhz", "memoryClock": "gpu_mem_clock_mhz", "correctedMemoryErrors": "gpu_ecc_corrected", "uncorrectedMemoryErrors": "gpu_ecc_uncorrected",
}
#: Metrics of exported columns that stand alone.
ALONE = {
    "cpu": "system/proc_cpu_pct", "memory": "system/sys_mem_pct", "proc.memory.rssMB": "system/proc_mem_used_mb", "proc.memory.percent": "system/proc_mem_pct", "proc.memory.availableMB": "system/sys_mem_avail_mb",
    "proc.cpu.threads": "system/proc_threads", "network.sent": "system/net_sent_bytes", "network.recv": "system/net_recv_bytes",
}
#: Metrics of a disk by the last segment of a column's name.
DISK = {"in": "system/disk_in_mb", "out": "system/disk_out_mb", "usagePercent": "system/disk_used_pct", "usageGB": "system/disk_used_gb"}
#: Families of numbered devices: the segments in front of the number, what their metrics begin with, and the names of some.
DEVICES = (
    (("gpu",), "system/gpu_", {k: v.removeprefix("gpu_") for k, v in ACCELERATOR.items()}),
    (("gpu", "process"), "system/gpu_proc_", {k: v.removeprefix("gpu_") for k, v in ACCELERATOR.items()}),
    (("cpu",), "system/cpu_core_", {"cpu_percent": "pct"}),
)


def system_columns(names: DataFrame, column: str = "name") -> DataFrame:
    """Adds metric_name and tag to exported system column names: numbered devices and disks are tags, the rest are words; null
    for columns that are no system columns. A name is cut into segments once; its first ones, and for disks its last, tell
    the family."""
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    seg = F.slice(F.split(column, r"\.", -1), F.lit(2), F.greatest(F.size(F.split(column, r"\.", -1)) - 1, F.lit(0)))
    cut = names.withColumn("_seg", F.when(F.col(column).startswith("system."), seg))
    n = F.size("_seg")
    rest = lambda start, length: F.array_join(F.slice("_seg", F.lit(start), length), ".")
    answers = []
    for front, begins, known in DEVICES:
        at = len(front) + 1
        key = rest(at + 1, F.greatest(n - at, F.lit(0)))
        fits = (n > at) & (F.slice("_seg", 1, len(front)) == F.array(*[F.lit(f) for f in front])) & F.get("_seg", F.lit(at - 1)).rlike("^[0-9]+$") & (key != "")
        answers.append(F.when(fits, F.struct(F.concat(F.lit(begins), F.coalesce(F.try_element_at(table(known), key), words(key))).alias("metric_name"), F.get("_seg", F.lit(at - 1)).alias("tag"))))
    alone = F.try_element_at(table(ALONE), rest(1, n))
    answers.append(F.when(alone.isNotNull(), F.struct(alone.alias("metric_name"), F.lit("").alias("tag"))))
    device, disk = rest(2, F.greatest(n - 2, F.lit(0))), F.try_element_at(table(DISK), F.element_at("_seg", -1))
    answers.append(F.when((n > 2) & (F.get("_seg", F.lit(0)) == "disk") & (device != "") & disk.isNotNull(), F.struct(disk.alias("metric_name"), device.alias("tag"))))
    plain = F.struct(F.concat(F.lit("system/"), F.replace(words(rest(1, n)), F.lit("."), F.lit("_"))).alias("metric_name"), F.lit("").alias("tag"))
    found = F.when(F.col("_seg").isNotNull(), F.coalesce(*answers, plain))
    return cut.withColumn("_found", found).select("*", "_found.metric_name", "_found.tag").drop("_seg", "_found")


def iso_ms(text: Column) -> Column:
    """Milliseconds of an ISO time with seconds, perhaps a fraction, and a zone (``Z`` or an offset; a fraction goes with ``Z``);
    null for any other text."""
    good = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|\.\d{1,6}Z|[+-]\d\d:?\d\d)$")
    return F.when(good, F.unix_millis(F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d\d)(\d\d)$", "$1:$2"))))


#: Exit codes of the states in which a run has ended.
EXIT_CODES = {"finished": 0, "failed": 1, "crashed": 255, "killed": 137, "preempted": 143}


def run_identity(df: DataFrame, now_ms: int) -> DataFrame:
    """run_id, run_name, created_ms, ended_ms and exit_code of an exported run (project, id, name, created, heartbeat, state).

    A blank name is the id; a name is cut to 2048 bytes; an unreadable creation time is now, an unreadable heartbeat the
    creation; a state that isn't final has no exit code."""
    slug = F.regexp_replace(F.lower("project"), r"[^a-z0-9]+", "-")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    given = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.col("id"))
    name = F.when(strip(given) != "", strip(given)).otherwise(F.col("id"))
    exit_code = F.try_element_at(F.create_map(*[F.lit(x) for pair in EXIT_CODES.items() for x in pair]), F.col("state"))
    out = df.withColumn("run_id", F.concat(F.lit("wandb_"), slug, F.lit("_"), "id")).withColumn("run_name", name)
    out = out.withColumn("run_name", truncate_bytes(F.col("run_name"), 2048))  # of the column, so that names are stripped once
    out = out.withColumn("created_ms", F.coalesce(iso_ms(F.col("created")), F.lit(now_ms).cast("long")))
    return out.withColumn("ended_ms", F.coalesce(iso_ms(F.col("heartbeat")), F.col("created_ms"))).withColumn("exit_code", exit_code)


def unsettled(df: DataFrame) -> DataFrame:
    """First reason why a run's import isn't final; null if it is. ``state`` is the export's, ``run_state`` the run's own: both
    have to be final, and an unknown one isn't."""
    final = lambda c: F.coalesce(F.col(c).isin(*EXIT_CODES), F.lit(False))
    reason = F.when(~F.col("exported"), "no_export").when(~F.col("complete"), "export_incomplete").when(F.col("errors") > 0, "export_errors").when(F.col("skipped") > 0, "export_skipped").when(~(final("state") & final("run_state")), "run_not_finished")
    return df.withColumn("unsettled", reason)


def reexport_needed(previous: DataFrame, current: DataFrame, skip: tuple[str, ...] = (), retry_errors: bool = False, force: bool = False) -> DataFrame:
    """Adds ``needed``: a run that was never exported whole, that isn't over or wasn't then, whose heartbeat or line count has
    moved, or whose export left out parts (``skipped``, names) that are asked for now (all but ``skip``); with
    ``retry_errors`` also one whose export had errors.

    ``previous``: run, complete, errors, skipped, state, heartbeat, lines; ``current``: run, state, heartbeat, lines."""
    p = previous.select("run", F.struct("complete", "errors", "skipped", "state", "heartbeat", "lines").alias("was"))
    final = lambda c: F.coalesce(c.isin(*EXIT_CODES), F.lit(False))
    wanted = F.array_except(F.coalesce("was.skipped", F.array().cast("array<string>")), F.array(*[F.lit(s) for s in skip]).cast("array<string>"))
    needed = (
        F.lit(force) | F.col("was").isNull() | ~F.coalesce("was.complete", F.lit(False)) | (F.lit(retry_errors) & (F.coalesce("was.errors", F.lit(0)) > 0)) | ~final(F.col("was.state")) | ~final(F.col("state"))
        | ~F.col("was.heartbeat").eqNullSafe(F.col("heartbeat")) | ~F.col("was.lines").eqNullSafe(F.col("lines")) | (F.size(wanted) > 0)
    )
    return current.join(p, "run", "left").withColumn("needed", needed).drop("was")


#: What each of a machine's exported properties is called in a run's information.
MACHINE = {
    "host": "hostname", "os": "os", "username": "username", "root": "cwd", "python": "python_version", "executable": "python_executable", "cpu_count": "cpu_count",
    "cpu_count_logical": "logical_cpu_count", "gpu_count": "gpu_count", "gpu": "gpu_type", "cudaVersion": "cuda_version",
}


#: What is told of an export, and the document and property it is read from.
SOURCE = {
    "url": "run.url", "entity": "run.entity", "project": "run.project", "run_id": "run.id", "state": "run.state", "tags": "run.tags", "notes": "run.notes", "group": "run.group", "job_type": "run.job_type",
    "sweep": "run.sweep", "user": "run.user", "email": "machine.email", "created_at": "run.created_at", "heartbeat_at": "run.heartbeat_at", "history_line_count": "run.history_line_count",
    "imported_at": "", "summary": "run.summary", "artifacts": "artifacts",
}


def run_info(df: DataFrame, imported_at: str) -> DataFrame:
    """Adds ``info``, the JSON document of an imported run: when it began, its machine and command line, commit and remote
    without credentials, the batch job without its token, where it comes from, and its configuration.

    ``df``: created_ms and JSON texts ``run`` (the export's description), ``machine``, ``summary``, ``artifacts``. Properties that
    are null or absent are left out, but for those of the export itself, which stand as null."""
    rows = df.withColumns({f"_{c}": F.try_parse_json(c) for c in ("run", "machine", "summary", "artifacts")})

    def get(column: str, path: str, form: str = "variant") -> Column:
        v = F.try_variant_get(f"_{column}", f"$.{path}", "variant")
        there = F.when(~F.is_variant_null(v), v)
        return there if form == "variant" else F.try_variant_get(there, "$", form)

    safe = lambda c: F.when(c.rlike("^[A-Za-z0-9@%+=:,./_-]+$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))
    program = get("machine", "program", "string")
    command = F.when(program != "", F.array_join(F.transform(F.concat(F.array(program), F.coalesce(get("machine", "args", "array<string>"), F.array().cast("array<string>"))), safe), " "))
    began = F.timestamp_millis("created_ms")
    time = F.struct(F.date_format(began, "MMMM dd, yyyy hh:mm:ss a").alias("start"), F.floor(F.col("created_ms") / 1000).alias("start_unix"))
    system = F.struct(*[get("machine", a).alias(b) for a, b in MACHINE.items()], command.alias("command"))
    remote = F.regexp_replace(get("machine", "git.remote", "string"), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1")
    commit = F.coalesce(F.nullif(get("machine", "git.commit", "string"), F.lit("")), F.nullif(get("run", "commit", "string"), F.lit("")))
    git = F.struct(F.nullif(remote, F.lit("")).alias("remote"), commit.alias("commit"))
    slurm = F.map_filter(get("machine", "slurm", "map<string,variant>"), lambda k, _: k != "jwt")
    told = {"imported_at": F.lit(imported_at), "summary": F.coalesce(get("run", "summary"), F.col("_summary")), "artifacts": F.col("_artifacts"), "tags": F.coalesce(get("run", "tags"), F.parse_json(F.lit("[]")))}
    source = [(told[k] if k in told else get(*at.split("."))).alias(k) for k, at in SOURCE.items()]
    part = lambda name, cond, c: F.when(cond, F.concat(F.lit(f',"{name}":'), c)).otherwise("")
    meta = F.concat(
        F.lit('{"meta":{"time":'), F.to_json(time), F.lit(',"system":'), F.to_json(system),
        part("git", F.col("_git.remote").isNotNull() | F.col("_git.commit").isNotNull(), F.to_json("_git")),
        part("slurm", F.size(get("machine", "slurm", "map<string,variant>")) > 0, F.to_json("_slurm")),
        F.lit(',"wandb_import":'), F.to_json(F.struct(*source), {"ignoreNullFields": "false"}), F.lit("}"),
        part("config", F.col("_config").isNotNull(), F.to_json("_config")), F.lit("}"),
    )
    return rows.withColumns({"_git": git, "_slurm": slurm, "_config": get("run", "config")}).select(*df.columns, meta.alias("info"))


def dry_run(df: DataFrame) -> DataFrame:
    """How many points of each kind an import would write: non-null cells, in one scan without a shuffle of rows."""
    kinds = column_kinds(df.schema)
    counts = df.agg(*[F.count(c).alias(c) for c, k in kinds.items() if k in ("numeric", "text")])
    cells = F.array(*[F.struct(F.lit(kinds[c]).alias("kind"), F.col(c).alias("n")) for c in counts.columns])
    return counts.select(F.explode(cells).alias("c")).select("c.*").groupBy("kind").agg(F.sum("n").alias("n"))
