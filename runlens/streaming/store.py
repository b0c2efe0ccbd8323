"""A point table of immutable folders under a commit list: snapshots, compaction, purges that last.

Each commit is a small manifest that names the folders which make up the table from then on: ``batch`` folders as appended,
``compacted`` ones that hold the newest version of each key of a project, and ``purged`` lists of runs. A manifest is written
under another name and renamed, so readers see a whole one; who comes second sees the first one's and does its change again.
Folders are never changed, so a reader keeps its snapshot while others compact or purge, until ``expire`` deletes what no kept
manifest names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.points import KEY, latest

SCHEMA = "project_id string, run_id string, metric_name string, tag string, step long, timestamp_ms long, value float, cdn_key string, text_data string, inserted_at timestamp"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Snapshot:
    """One version of the table."""

    store: PointStore
    version: int
    entries: tuple[dict, ...]

    def points(self, project: str | None = None) -> DataFrame:
        """All versions of all points, or of a project's, whose folders alone are then listed."""
        spark, mine = self.store.spark, [e for e in self.entries if e["kind"] != "purged" and (project is None or project in e["projects"])]
        plain = [self.store.folder(e, p) for e in mine if e["kind"] == "batch" for p in e["projects"] if project in (None, p)]
        parts = [self.store.table(e) for e in mine if e["kind"] == "compacted"]
        if plain or not parts:
            empty = spark.createDataFrame([], SCHEMA)
            # the project stands in the rows too, so a folder's name needn't be read back
            parts.append(spark.read.schema(SCHEMA).parquet(*plain) if plain else empty)
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def newest(self, project: str | None = None) -> DataFrame:
        """The newest version of each key. A project that is one compacted folder is scanned without a shuffle, as its buckets
        already hold all versions of their keys."""
        return latest(self.points(project))

    def purged(self) -> DataFrame:
        """Runs (project_id, run_id) that are gone for good."""
        paths = [self.store.path(e) for e in self.entries if e["kind"] == "purged"]
        schema = "project_id string, run_id string"
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*paths).distinct() if paths else spark.createDataFrame([], schema)


class PointStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        where, fs = self._fs(name)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def path(self, entry: dict) -> str:
        return f"{self.root}/data/{entry['id']}"

    def folder(self, entry: dict, project: str) -> str:
        """A batch's folder of a project, by a digest, as names may hold anything and be long."""
        return f"{self.path(entry)}/part={hashlib.md5(project.encode()).hexdigest()}"

    def table(self, entry: dict) -> DataFrame:
        """A compacted folder as the bucketed table it was written as."""
        name = f"points_{entry['id']}"
        if not self.spark.catalog.tableExists(name):
            keys = ", ".join(KEY)
            columns = SCHEMA.replace("long", "BIGINT")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {entry['buckets']} BUCKETS LOCATION '{self.path(entry)}'")
        return self.spark.table(name)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one that hasn't expired."""
        if version is None:
            version = max((int(n) for n in self._names("commits") if n.isdigit()), default=0)
        rows = self.spark.read.text(f"{self.root}/commits/{version}").collect() if version else []
        return Snapshot(self, version, tuple(json.loads(r.value) for r in rows))

    def _commit(self, change: Callable[[Snapshot], list[dict] | None]) -> Snapshot:
        """Makes ``change`` of the newest snapshot the next; None leaves it. The change is made again if another came first."""
        while True:
            now = self.snapshot()
            entries = change(now)
            if entries is None:
                return now
            part, fs = self._fs(f"commits/.part-{uuid.uuid4().hex}")
            out = fs.create(part)
            out.write("".join(json.dumps(e) + "\n" for e in entries).encode())
            out.close()
            to = self._fs(f"commits/{now.version + 1}")[0]
            if not fs.exists(to) and fs.rename(part, to):
                return Snapshot(self, now.version + 1, tuple(entries))
            fs.delete(part, False)

    def append(self, points: DataFrame, batch: int | str) -> Snapshot:
        """Adds a batch once, whatever is retried; rows of purged runs are dropped. Tasks hold ranges of the key, so a hot run is
        many files, each of which knows its range of runs, metrics and steps."""
        if any(e.get("batch") == str(batch) for e in self.snapshot().entries):
            return self.snapshot()
        purged = self.snapshot()
        entry = {"kind": "batch", "id": uuid.uuid4().hex, "batch": str(batch)}
        kept = points.select(*[F.col(c).cast(t) for c, t in (x.split() for x in SCHEMA.split(", "))]).join(F.broadcast(purged.purged()) if self._few(purged) else purged.purged(), ["project_id", "run_id"], "left_anti").select(*_COLUMNS)
        named = kept.withColumn("part", F.md5(F.col("project_id").cast("binary")))
        named.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.partitionBy("part").parquet(self.path(entry))
        written = self.spark.read.parquet(self.path(entry)) if self._has_files(entry) else None
        entry["projects"] = sorted(r[0] for r in written.select("project_id").distinct().collect()) if written is not None else []

        def change(now: Snapshot) -> list[dict] | None:
            return None if any(e.get("batch") == entry["batch"] for e in now.entries) else [*now.entries, entry]

        return self._commit(change)

    def _few(self, now: Snapshot) -> bool:
        """Whether the purged runs' files are small enough to be sent to all tasks."""
        size = 0
        for e in now.entries:
            if e["kind"] == "purged":
                where, fs = self._fs(f"data/{e['id']}")
                size += fs.getContentSummary(where).getLength()
        return size <= 8 << 20

    def _has_files(self, entry: dict) -> bool:
        return any(n.startswith("part=") for n in self._names(f"data/{entry['id']}"))

    def _rewritten(self, now: Snapshot, project: str, without: DataFrame | None = None) -> dict:
        """A compacted folder of a project's newest versions, less some runs."""
        rows = now.newest(project).where(F.col("project_id") == project).select(*_COLUMNS)
        if without is not None:
            rows = rows.join(without, ["project_id", "run_id"], "left_anti").select(*_COLUMNS)
        entry = {"kind": "compacted", "id": uuid.uuid4().hex, "projects": [project], "buckets": self.buckets}
        rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", self.path(entry)).saveAsTable(f"points_{entry['id']}")
        return entry

    @staticmethod
    def _less(entries: tuple[dict, ...], project: str, seen: set[str]) -> list[dict]:
        """``entries`` without the project in those that were ``seen``; what is left without a project goes."""
        out = []
        for e in entries:
            if e["kind"] != "purged" and e["id"] in seen and project in e["projects"]:
                e = e | {"projects": [p for p in e["projects"] if p != project]}
                if not e["projects"] and "batch" not in e:
                    continue
            out.append(e)
        return out

    def compact(self, project: str) -> Snapshot:
        """A project's folders merged into one with the newest version of each key. Batches that come meanwhile stay beside it."""
        before = self.snapshot()
        entry, seen = self._rewritten(before, project), {e["id"] for e in before.entries}
        return self._commit(lambda now: [*self._less(now.entries, project, seen), entry])

    def purge(self, runs: DataFrame) -> Snapshot:
        """Removes runs (project_id, run_id) for good: their projects are rewritten, other projects keep their files, and the runs
        are remembered, so that later batches can't bring them back. The list is committed first: whatever is appended from
        then on lacks the runs, and what was appended before is rewritten."""
        entry = {"kind": "purged", "id": uuid.uuid4().hex, "projects": []}
        runs.select("project_id", "run_id").distinct().write.parquet(self.path(entry))
        self._commit(lambda now: [*now.entries, entry])
        gone = self.spark.read.schema("project_id string, run_id string").parquet(self.path(entry))
        now = self.snapshot()
        for project in sorted(r.project_id for r in gone.select("project_id").distinct().collect()):  # one name a project
            if any(project in e["projects"] for e in now.entries):
                before = self.snapshot()
                new, seen = self._rewritten(before, project, gone), {e["id"] for e in before.entries}
                now = self._commit(lambda s, p=project, new=new, seen=seen: [*self._less(s.entries, p, seen), new])
        return self.snapshot()

    def expire(self, keep: int = 1) -> list[str]:
        """Deletes manifests but for the newest ``keep``, and folders that these don't name; what it deleted."""
        versions = sorted(int(n) for n in self._names("commits") if n.isdigit())
        kept = versions[-keep:]
        named = {e["id"] for v in kept for e in self.snapshot(v).entries if e["kind"] == "purged" or e["projects"] or e["kind"] == "batch"}
        gone = [n for n in self._names("data") if n not in named]
        for name in [f"commits/{v}" for v in versions if v not in kept] + [f"data/{n}" for n in gone]:
            where, fs = self._fs(name)
            fs.delete(where, True)
        for n in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS points_{n}")
        return gone


def sink(store: PointStore):
    """The ``foreachBatch`` function that appends a streaming point table to a store; replayed batches add nothing."""
    return lambda df, batch: store.append(df, batch)
