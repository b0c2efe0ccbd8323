"""Runs: status, lifecycle, trash and purge, versions, listings. Times in milliseconds; "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALIVE_MS, DEAD_MS, CANDIDATE_MS = 10_000, 600_000, 660_000
RETENTION_MS = 7 * 86_400_000
MAX_VERSION = 2**63 - 1


def main_or_created(main: Column, created: Column) -> Column:
    """A run's last main metric; before any its creation stands in for one."""
    return F.coalesce(main, created)


def status(now: Column, exit_code: Column, created_ms: Column, last_main_ms: Column, last_system_ms: Column) -> Column:
    """A run is alive as of its last system or main metric, whichever is later."""
    main_ms = main_or_created(last_main_ms, created_ms)
    alive_ms = F.greatest(main_ms, last_system_ms)
    return (
        F.when(exit_code == 0, "finished")
        .when(exit_code.isNotNull(), "crashed")
        .when(now - main_ms < ALIVE_MS, "running")
        .when(now - alive_ms < ALIVE_MS, "stuck")
        .when(now - alive_ms < DEAD_MS, "unresponsive")
        .otherwise("presumed dead")
    )


def status_candidates(runs: DataFrame, now_ms: int) -> DataFrame:
    """Runs whose status may still move: no exit code, not deleted, and alive within eleven minutes."""
    alive = F.greatest(F.col("last_system_metric_at"), main_or_created(F.col("last_main_metric_at"), F.col("created_at")))
    return runs.where(F.col("exit_code").isNull() & F.col("deleted_at").isNull() & (F.unix_millis(alive) > now_ms - CANDIDATE_MS))


def lifecycle(now_ms: int, run: str = "run_id", deleted: str = "deleted_at", purging: str = "purging_at", purged: str = "purged") -> Column:
    due = F.lit(now_ms) - F.unix_millis(deleted) >= RETENTION_MS
    return (
        F.when(F.col(purging).isNotNull(), "purging")
        .when(F.col(deleted).isNotNull(), F.when(due, "expired").otherwise("trashed"))
        .when(F.col(run).isNotNull(), "active")
        .when(F.col(purged), "purged")
        .otherwise("missing")
    )


def classify(keys: DataFrame, runs: DataFrame, tombstones: DataFrame, now_ms: int) -> DataFrame:
    """Lifecycle class of every asked key (project_id, run_id), in order ``position``."""
    r = runs.select("project_id", "run_id", F.col("run_id").alias("_found"), "deleted_at", "purging_at")
    t = tombstones.select("project_id", "run_id", F.lit(True).alias("purged"))
    joined = keys.join(r, ["project_id", "run_id"], "left").join(t, ["project_id", "run_id"], "left").withColumn("purged", F.coalesce("purged", F.lit(False)))
    return joined.withColumn("lifecycle", lifecycle(now_ms, "_found")).drop("_found", "deleted_at", "purging_at", "purged")


def trash_outcomes(classified: DataFrame) -> DataFrame:
    """Of a request list: a run's first active position is trashed; its repeats and trashed runs are already_trashed; runs
    past retention, being purged or purged are expired; the rest is not_found."""
    return _outcomes(classified, "active", "trashed", "already_trashed")


def restore_outcomes(classified: DataFrame) -> DataFrame:
    """Of a request list: a run's first trashed position is restored; its repeats and active runs are already_active; runs past
    retention, being purged or purged are expired; the rest is not_found."""
    return _outcomes(classified, "trashed", "restored", "already_active")


def _outcomes(classified: DataFrame, moves: str, done: str, already: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("project_id", "run_id").orderBy("position")) == 1
    c = F.col("lifecycle")
    return classified.withColumn("outcome", F.when((c == moves) & first, done).when(c.isin("active", "trashed"), already).when(c.isin("expired", "purging", "purged"), "expired").otherwise("not_found"))


def purge_due(runs: DataFrame, now_ms: int) -> DataFrame:
    return runs.where(F.col("purging_at").isNotNull() | (F.lit(now_ms) - F.unix_millis("deleted_at") >= RETENTION_MS))


def purge_points(points: DataFrame, due: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays of a point table without the purged runs, and their tombstones."""
    keys = due.select("project_id", "run_id").distinct()
    return points.join(keys, ["project_id", "run_id"], "left_anti"), keys


def purge_candidates(runs: DataFrame, pass_ms: int, limit: int) -> DataFrame:
    """Deleted runs that a purge pass takes next, by when they came due (``since``): those last tried before the pass began, by
    that try, and those never tried whose retention has run out by then, by its end. Each is a bounded top list."""
    top = lambda df: df.orderBy("since", "project_id", "run_id").limit(limit)
    gone = runs.where("deleted_at IS NOT NULL").select("project_id", "run_id", "purge_attempt_at", (F.col("deleted_at") + F.expr(f"INTERVAL {RETENTION_MS // 1000} SECONDS")).alias("due"))
    begun = F.timestamp_millis(F.lit(pass_ms))
    again = gone.where(F.col("purge_attempt_at") < begun).select("project_id", "run_id", F.col("purge_attempt_at").alias("since"))
    new = gone.where(F.col("purge_attempt_at").isNull() & (F.col("due") <= begun)).select("project_id", "run_id", F.col("due").alias("since"))
    return top(top(again).unionByName(top(new)))


def purge_backlog(runs: DataFrame, now_ms: int) -> DataFrame:
    """How many deleted runs may be purged, and how long the oldest of them has been due (0 at least, also without any)."""
    due = purge_due(runs, now_ms).where("deleted_at IS NOT NULL")
    overdue = F.lit(now_ms) - RETENTION_MS - F.unix_millis(F.min("deleted_at"))
    return due.agg(F.count(F.lit(1)).alias("due"), F.greatest(F.coalesce(overdue, F.lit(0)), F.lit(0)).alias("oldest_overdue_ms"))


def project_last_logged(runs: DataFrame) -> DataFrame:
    """max over a project's runs of least(last_ingested, terminated); an absent time doesn't count."""
    return runs.groupBy("project_id").agg(F.max(F.least("last_ingested_at", "terminated_at")).alias("last_logged"), F.count(F.lit(1)).alias("runs"))


def by_ordinal(runs: DataFrame) -> DataFrame:
    return runs.where("deleted_at IS NULL AND purging_at IS NULL").orderBy(F.desc("ordinal"))


def assign_ordinals(new: DataFrame, marks: DataFrame) -> DataFrame:
    """Ordinals of new runs: behind their project's high-water mark, in order of creation; numbers are never used again."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "run_id"))
    return new.join(marks, "project_id", "left").withColumn("ordinal", F.coalesce("high_water", F.lit(0)) + n).drop("high_water")


def trash_page(runs: DataFrame, page: int, cursor: tuple | None = None) -> DataFrame:
    """Keyset page of all deleted runs, expired ones and those being purged too: deleted_at descending, project, ordinal descending, run, behind the ``cursor`` (deleted in
    ms, project, ordinal, run). One row past the page tells
    whether there is a next one; Spark keeps a bounded heap for it, no full sort."""
    live = runs.where("deleted_at IS NOT NULL")
    if cursor is not None:
        d, p, o, r = F.timestamp_millis(F.lit(cursor[0])), *(F.lit(c) for c in cursor[1:])
        after = (F.col("deleted_at") < d) | ((F.col("deleted_at") == d) & ((F.col("project_id") > p) | ((F.col("project_id") == p) & ((F.col("ordinal") < o) | ((F.col("ordinal") == o) & (F.col("run_id") > r))))))
        live = live.where(after)
    return live.orderBy(F.desc("deleted_at"), "project_id", F.desc("ordinal"), "run_id").limit(page + 1)


def key_page(keys: DataFrame, after: str, limit: int, column: str = "key") -> DataFrame:
    return keys.where(F.col(column) > after).orderBy(column).limit(limit)


def versions(commits: DataFrame, *by: str) -> DataFrame:
    """Version of each run: how many commits (batch ids) touched it; by ``project_id`` that of each project."""
    return commits.groupBy(*(by or ("project_id", "run_id"))).agg(F.countDistinct("batch_id").alias("version"))


def all_versions(commits: DataFrame) -> DataFrame:
    """Versions of every run, of every project (run_id null) and of the whole (both null): one shuffle of (project, run, batch)
    by grouping sets, counted once partial counts have dropped repeats."""
    once = commits.select("project_id", "run_id", "batch_id").distinct()
    sets = once.groupingSets([["project_id", "run_id"], ["project_id"], []], "project_id", "run_id")
    return sets.agg(F.countDistinct("batch_id").alias("version"), F.grouping_id().alias("level"))


def version_lookup(wanted: DataFrame, runs: DataFrame, tombstones: DataFrame, now_ms: int) -> DataFrame:
    """Version of each wanted run (project_id, run_id): its own, one more once it is being purged or has expired (which the
    greatest version leaves room for), a tombstone's, or 0."""
    key = ["project_id", "run_id"]
    ended = F.col("purging_at").isNotNull() | F.coalesce(F.lit(now_ms) - F.unix_millis("deleted_at") >= RETENTION_MS, F.lit(False))
    r = runs.select(*key, F.when(ended, F.least("version", F.lit(MAX_VERSION - 1)) + 1).otherwise(F.col("version")).alias("_live"))
    t = tombstones.select(*key, F.col("version").alias("_dead"))
    return wanted.join(r, key, "left").join(t, key, "left").select(*key, F.coalesce("_live", "_dead", F.lit(0).cast("long")).alias("version"))


def changed_since(before: DataFrame, after: DataFrame, registry_before: DataFrame, registry_after: DataFrame) -> DataFrame:
    """Runs whose version moved, and whether their metric list did."""
    b = before.select("run_id", F.col("version").alias("was"))
    moved = after.join(b, "run_id", "left").where(~F.col("version").eqNullSafe(F.col("was")))
    old = registry_before.select("run_id", "metric_name", F.col("type_code").alias("old_code"))
    fresh = registry_after.join(old, ["run_id", "metric_name"], "left").where("old_code IS NULL OR type_code > old_code").select("run_id").distinct().withColumn("relist", F.lit(True))
    return moved.join(fresh, "run_id", "left").select("run_id", "version", F.coalesce("relist", F.lit(False)).alias("relist"))


def media_outcomes(mutations: DataFrame, heads: DataFrame) -> DataFrame:
    """Outcome of media writes against the newest head of their key (versions are decimal(20,0), epoch * 2^32 + seq)."""
    w = Window.partitionBy("key").orderBy("version", "position").rowsBetween(Window.unboundedPreceding, -1)
    joined = mutations.join(heads.select("key", F.col("version").alias("head"), F.col("content").alias("head_content")), "key", "left")
    top = F.greatest("head", F.max("version").over(w))
    prior = F.max(F.struct("version", "content")).over(w)
    content = F.when(prior.isNotNull() & (F.col("head").isNull() | (prior.getField("version") > F.col("head"))), prior.getField("content")).otherwise(F.col("head_content"))
    out = (
        F.when(F.floor(F.col("version") / F.lit(4294967296).cast("decimal(20,0)")) > F.col("max_epoch"), "unallocated epoch")
        .when(top.isNull() | (F.col("version") > top), "accepted")
        .when(F.col("version") < top, "superseded")
        .when(content.eqNullSafe(F.col("content")), "idempotent")
        .otherwise("conflict")
    )
    return joined.withColumn("outcome", out).drop("head", "head_content")


def fold_imports(imports: DataFrame) -> DataFrame:
    """Repeated imports of a run: the first write holds for name and creation, the last for the end."""
    return imports.groupBy("project_id", "run_id").agg(
        F.min_by("run_name", "import_seq").alias("run_name"), F.min_by("created_at", "import_seq").alias("created_at"), F.max_by("exit_code", "import_seq").alias("exit_code"), F.max_by("terminated_at", "import_seq").alias("terminated_at")
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Rename and lifecycle events of runs, by seq: the last name; of the execution that the last open began, the last
    exit code and its end: the last end given by a close, or the first close's stamp where none is given before one.

    An open clears exit code and end. A close with a given end sets it, one without keeps the end there is and else stamps its
    own time. A run that is deleted (kind ``delete``) takes no events until it is restored (``restore``)."""
    key = [c for c in ("project_id", "run_id") if c in events.columns]
    # which events are taken and which execution they belong to follow from the last delete or restore, and open, before them
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.last(F.when(F.col("kind").isin("delete", "restore"), F.col("kind") == "delete"), True).over(w)
    taken = events.withColumn("_gone", F.coalesce(gone, F.lit(False))).where(~F.col("_gone") | (F.col("kind") == "delete"))
    open_ = F.coalesce(F.max(F.when(F.col("kind") == "open", F.col("seq"))).over(Window.partitionBy(*key)), F.lit(-(2**63)))
    told = taken.withColumn("_live", (F.col("kind") == "close") & (F.col("seq") > open_))
    agg = told.groupBy(*key).agg(
        F.max(F.when(F.col("kind") == "rename", F.struct("seq", "name"))).alias("n"),
        F.max(F.when(F.col("_live"), F.struct("seq", "exit_code"))).alias("e"),
        F.max(F.when(F.col("_live") & F.col("given_end").isNotNull(), F.struct("seq", "given_end"))).alias("given"),
        F.min(F.when(F.col("_live"), F.struct("seq", "at"))).alias("stamped"),
    )
    return agg.select(*key, F.col("n.name").alias("run_name"), F.col("e.exit_code").alias("exit_code"), F.coalesce("given.given_end", "stamped.at").alias("ended_at"))


def labels(runs: DataFrame) -> DataFrame:
    """A name that several runs of a project share is shown with the ordinal."""
    shared = F.count(F.lit(1)).over(Window.partitionBy("project_id", "run_name")) > 1
    return runs.withColumn("label", F.when(shared, F.concat("run_name", F.lit(" #"), F.col("ordinal").cast("string"))).otherwise(F.col("run_name")))


def transitions(scans: DataFrame) -> DataFrame:
    """Status changes between scans (run_id, scan_ms, status); a run's first scan is no change."""
    before = F.lag("status").over(Window.partitionBy("run_id").orderBy("scan_ms"))
    return scans.withColumn("before", before).where("before <> status").select("run_id", "scan_ms", "before", F.col("status").alias("after"))


def roll_forward(bumped: DataFrame, projects: DataFrame) -> DataFrame:
    """Bumped runs with ``project_time``, what their project's activity (project_id, last_logged) moves to: the latest of its
    bumped runs' ingests (not past their end), where that lies in a later minute than the activity or there was none;
    else, and for unknown projects, null."""
    logged = bumped.groupBy("project_id").agg(F.max(F.least("last_ingested_at", "terminated_at")).alias("_at"))
    moved = (F.col("last_logged").isNull() & F.col("_at").isNotNull()) | (F.col("_at") >= F.date_trunc("minute", "last_logged") + F.expr("INTERVAL 1 MINUTE"))
    rolled = projects.join(logged, "project_id").where(moved).select("project_id", F.col("_at").alias("project_time"))
    return bumped.join(rolled, "project_id", "left").select("project_id", "run_id", "project_time")


def resolve_bindings(bindings: DataFrame, selected: DataFrame, runs: DataFrame, max_runs: int) -> DataFrame:
    """Panel bindings (position, metric_name, mode, ids) to the first ``max_runs`` distinct runs in order of first sight (0: all).

    Modes: selected (the selected runs in their order), all (every run by ordinal), specific (the listed ids)."""
    s = bindings.where("mode = 'selected'").crossJoin(selected.select("run_id", F.col("position").alias("k")))
    a = bindings.where("mode = 'all'").crossJoin(runs.select("run_id", F.col("ordinal").alias("k")))
    x = bindings.where("mode = 'specific'").select("*", F.posexplode("ids").alias("k", "run_id"))
    cols = ["position", "metric_name", "k", "run_id"]
    every = s.select(*cols).unionAll(a.select(*cols)).unionAll(x.select(*cols))
    once = every.groupBy("metric_name", "run_id").agg(F.min(F.struct("position", "k")).alias("at"))
    if not max_runs:
        return once.select("metric_name", "run_id", F.col("at.position").alias("position"))
    first = once.groupBy("run_id").agg(F.min("at").alias("first")).orderBy("first", "run_id").limit(max_runs)
    return once.join(first, "run_id").select("metric_name", "run_id", F.col("at.position").alias("position"))
