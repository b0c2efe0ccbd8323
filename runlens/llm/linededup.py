"""Line deduplication against levelled sorted runs of line hashes.

``LineIndex`` holds how many documents have each line, as Parquet runs that are bucketed and sorted by the line's hash. A batch
of documents is counted, merge-anti-joined with what the runs have already settled (lines found in enough documents), and what
remains is written as a run of level 0. When a level holds ``fanout`` runs they are merged, with their counts added, into one
run of the next level. All runs have the same buckets, so a batch meets them without shuffling them.

A line's key is the line without `[ \\t\\n\\v\\f\\r]` at both ends, A-Z lower-cased. Each row of a batch is a document; a key
counts once for each document, however often it stands there. Keys are compared by two 64-bit hashes.

Defined results: null and empty texts are one empty line, which stays; keys shorter than ``least_chars`` are never dropped;
repeated rows are documents of their own; an empty table gives an empty table; other columns pass through under any name, but
for those named like a result, in any case, which are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, discard, free_names, new_path, stored

_BLANK = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEED = 0x5EED


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys(text: Column) -> Column:
    """What of each line is compared. An ASCII line takes the fast way, which lower-cases the same letters."""
    bare = F.transform(lines(text), lambda x: F.btrim(x, F.lit(_BLANK)))
    return F.transform(bare, lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER)))


def _hashes(of: Column) -> list[Column]:
    return [F.xxhash64(of).alias("h1"), F.xxhash64(of, F.lit(_SEED)).alias("h2")]


class LineIndex:
    """Document counts of line hashes under one folder. Its state is the newest complete manifest, a small table of
    (level, run), so an interrupted batch or merge leaves the state before it and can be repeated."""

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: int = 10, least_chars: int = 1, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path = spark, path or new_path(spark, "line-index")
        self.threshold, self.least_chars, self.fanout = threshold, least_chars, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs = 0, []
        self._open()

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _open(self) -> None:
        where, fs = self._fs("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        if done := [int(n) for n in names if n.isdigit()]:
            self.version = max(done)
            first, *rest = self.spark.read.text(f"{self.path}/manifests/{self.version}").coalesce(1).collect()
            self.buckets = int(first.value)
            self.runs = [(int(level), run) for level, run in (r.value.split() for r in rest)]

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        """Writes the next manifest under another name first, so that a whole one or none is seen."""
        self.version += 1
        part, fs = self._fs(f"manifests/.part-{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write("".join(f"{x}\n" for x in (self.buckets, *(f"{level} {run}" for level, run in runs))).encode())
        out.close()
        if not fs.rename(part, self._fs(f"manifests/{self.version}")[0]):
            raise RuntimeError(f"another writer has added version {self.version} to {self.path}")
        gone, self.runs = [r for r in self.runs if r not in runs], runs
        self._forget(gone)

    def _forget(self, runs: list[tuple[int, str]]) -> None:
        for _, run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            where, fs = self._fs(run)
            fs.delete(where, True)

    def _dealt(self, counts: DataFrame) -> DataFrame:
        return counts.repartition(self.buckets, "h1", "h2")

    def _write(self, dealt: DataFrame) -> str:
        run = f"line_run_{uuid.uuid4().hex}"
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{self.path}/{run}").saveAsTable(run)
        return run

    def _run(self, run: str) -> DataFrame:
        if not self.spark.catalog.tableExists(run):
            self.spark.sql(
                f"CREATE TABLE {run} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'"
            )
        return self.spark.table(run)

    def _merged(self, runs: list[str]) -> DataFrame:
        """The sums of several runs, read as plain files: Spark takes a union of bucketed scans for bucketed itself and then
        leaves out the shuffle, although the columnar union has appended its partitions."""
        parts = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[f"{self.path}/{r}" for r in runs])
        return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """h1, h2, n of all runs together: n is exact below ``threshold`` and at least ``threshold`` else."""
        return self._merged([r for _, r in self.runs]) if self.runs else self.spark.createDataFrame([], "h1 long, h2 long, n long")

    def add(self, counts: DataFrame) -> None:
        """A batch's lines (``count_lines``) less those that a run has settled, as a run of its own."""
        counts = self._dealt(counts)
        for _, run in self.runs:
            settled = self._run(run).where(F.col("n") >= self.threshold).select("h1", "h2")
            counts = counts.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._commit([*self.runs, (0, self._write(counts))])
        level = 0
        while len(full := [r for k, r in self.runs if k == level]) >= self.fanout:
            self.compact(full, level + 1)
            level += 1

    def compact(self, runs: list[str], level: int) -> None:
        """``runs`` merged into one of ``level``."""
        merged = self._write(self._dealt(self._merged(runs)))
        self._commit([(k, r) for k, r in self.runs if r not in runs] + [(level, merged)])

    def frequent(self) -> DataFrame:
        """h1, h2 of the lines found in at least ``threshold`` documents."""
        return self.counts().where(F.col("n") >= self.threshold).select("h1", "h2")

    def release(self) -> None:
        """Deletes the index."""
        self._forget(self.runs)
        where, fs = self._fs("manifests")
        fs.delete(where.getParent(), True)


def count_lines(docs: DataFrame, least_chars: int = 1, text: str = "text", *by: str) -> DataFrame:
    """h1, h2, n (documents) of each line key of at least ``least_chars`` code points, for each value of the columns ``by``.
    A document's repeated keys are dropped where it lies, so counts are combined before their shuffle and no key is hot."""
    own = F.explode(F.array_distinct(keys(F.col(text)))).alias("key")
    found = docs.select(*by, own).where(F.char_length("key") >= least_chars)
    return found.select(*by, *_hashes(F.col("key"))).groupBy(*by, "h1", "h2").agg(F.count("*").alias("n"))


def drop_lines(docs: DataFrame, frequent: DataFrame, least_chars: int = 1, text: str = "text", names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """``docs`` with the lines whose hashes are in ``frequent`` (unique h1, h2) dropped: the columns of ``docs`` and ``names``.

    Only hashes and positions of lines are joined with ``frequent``; a document's dropped positions, at most its lines, then
    meet its text by a hash of the row. Rows that share that hash differ in no dropped key, so it need not be unique."""
    n_lines, n_dropped, kept = names
    spare = free_names(docs, "row_", "at_")
    row, at = spare
    at_row = docs.withColumn(row, F.xxhash64(*columns(docs)))
    placed = at_row.select(row, F.posexplode(keys(F.col(text))).alias("pos", "key"))
    placed = placed.where(F.char_length("key") >= least_chars).select(row, "pos", *_hashes(F.col("key")))
    hit = placed.join(frequent.hint("merge"), ["h1", "h2"], "left_semi").groupBy(row).agg(F.collect_set("pos").alias(at))
    whole = at_row.join(hit.hint("merge"), row, "left")
    gone = F.coalesce(F.col(at), F.array().cast("array<int>"))
    size = F.size(lines(F.col(text)))
    stay = F.array_except(F.sequence(F.lit(0), size - 1), gone)
    # the array around the lines binds them to a name, so that a text is split once
    rest = F.transform(F.array(lines(F.col(text))), lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n"))
    results = {n_lines: size.cast("long"), n_dropped: F.size(gone).cast("long"), kept: F.get(rest, F.lit(0))}
    taken = {n.lower() for n in names}
    return whole.select(*[c for c, name in zip(columns(docs), docs.columns, strict=True) if name.lower() not in taken], *[v.alias(n) for n, v in results.items()])


def line_dedup(docs: DataFrame, threshold: int = 10, least_chars: int = 1, batches: int = 4, fanout: int = 3, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """``docs`` without the lines that stand in at least ``threshold`` documents of the whole table. The table enters a fresh
    index in ``batches`` batches, dealt by a hash of the row; then all its documents are cleaned with the whole index.
    Columns: see ``drop_lines``."""
    spark = docs.sparkSession
    (batch,) = free_names(docs, "batch_")
    dealt = docs.select("text", F.pmod(F.xxhash64(*columns(docs)), F.lit(batches)).alias(batch))
    counted = stored(count_lines(dealt, least_chars, "text", batch), "line-counts")
    index = LineIndex(spark, threshold=threshold, least_chars=least_chars, fanout=fanout)
    for k in range(batches):
        index.add(counted.where(F.col(batch) == k).drop(batch))
    discard(counted)
    frequent = stored(index.frequent(), "frequent-lines")
    index.release()
    return drop_lines(docs, frequent, least_chars, names=names)
