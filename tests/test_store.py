"""The point store: replays, snapshots, compaction without shuffles, purges that last."""

from pyspark.sql import functions as F

from runlens.operators.points import latest
from runlens.streaming import store as S


def points(spark, n, salt=0, projects=3):
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("p"), (i % projects).cast("string")).alias("project_id"), F.concat(F.lit("r"), (i % 7).cast("string")).alias("run_id"), F.lit("loss").alias("metric_name"), F.lit("").alias("tag"), (i % 50).alias("step"),
        i.alias("timestamp_ms"), (i * 0.5 + salt).cast("float").alias("value"), F.lit(None).cast("string").alias("cdn_key"), F.lit(None).cast("string").alias("text_data"), F.timestamp_millis(i * 10 + salt).alias("inserted_at"),
    )


def same(a, b):
    a, b = (x.select(*sorted(a.columns)) for x in (a, b))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def files(s, snapshot, project):
    return {f for f in snapshot.points(project).inputFiles()}


def test_replays_snapshots_and_compaction(spark, tmp_path):
    s = S.PointStore(spark, f"file://{tmp_path}/t", buckets=3)
    a, b, c = (points(spark, n, k) for k, n in enumerate((400, 300, 200)))
    s.append(a, 0)
    s.append(b, 1)
    s.append(b, 1)  # replayed
    held = s.snapshot()
    want = latest(a.unionByName(b)).cache()
    assert held.version == 2 and same(held.newest(), want)
    s.compact("p1")
    assert same(s.snapshot().newest(), want) and same(held.newest(), want)  # a reader during compaction keeps its snapshot
    plan = s.snapshot().newest("p1")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert all(S.hashlib.md5(b"p1").hexdigest() in f for f in held.points("p1").inputFiles()) and held.points("p1").inputFiles()
    s.append(c, 2)
    s.compact("p1")
    s.compact("p0")
    whole = latest(a.unionByName(b).unionByName(c))
    assert same(s.snapshot().newest(), whole) and same(s.snapshot().newest("p1"), whole.where("project_id = 'p1'"))
    s.append(b, 1)  # a replay after compaction
    again = S.PointStore(spark, f"file://{tmp_path}/t")
    assert same(again.snapshot().newest(), whole)
    assert s.expire() and same(again.snapshot().newest(), whole)


def test_two_writers_lose_nothing(spark, tmp_path):
    s = S.PointStore(spark, f"file://{tmp_path}/t")
    s.append(points(spark, 60), 0)
    done = []

    def change(now):
        if not done:  # another writer comes first
            done.append(s.append(points(spark, 60, 5), 1))
        return [*now.entries, {"kind": "purged", "id": "x", "projects": []}]

    end = s._commit(change)
    assert end.version == 3 and {e.get("batch") for e in end.entries} == {"0", "1", None}


def test_purged_runs_stay_purged(spark, tmp_path):
    s = S.PointStore(spark, f"file://{tmp_path}/t", buckets=2)
    s.append(points(spark, 300), 0)
    before = files(s, s.snapshot(), "p2")
    gone = spark.createDataFrame([("p0", "r1"), ("p1", "r2"), ("p9", "r1")], "project_id string, run_id string")
    s.purge(gone)
    s.append(points(spark, 300, 3), 1)  # late rows of the purged runs
    keys = gone.select("project_id", "run_id")
    want = latest(points(spark, 300).unionByName(points(spark, 300, 3))).join(keys, ["project_id", "run_id"], "left_anti")
    assert same(s.snapshot().newest(), want.select(*s.snapshot().newest().columns))
    assert before <= files(s, s.snapshot(), "p2")  # an untouched project keeps its files
    assert s.snapshot().purged().count() == 3
    s.expire()
    assert same(s.snapshot().newest(), want.select(*s.snapshot().newest().columns))


def test_stream_into_the_store_and_odd_names(spark, tmp_path):
    src, s = f"{tmp_path}/in", S.PointStore(spark, f"file://{tmp_path}/t")
    odd = points(spark, 40).withColumn("project_id", F.when(F.col("project_id") == "p0", "").when(F.col("project_id") == "p1", "a/b=c %").otherwise("p2"))
    for k in range(3):
        odd.where(f"timestamp_ms % 3 = {k}").coalesce(1).write.mode("append").parquet(src)
    q = spark.readStream.schema(odd.schema).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(S.sink(s)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert s.snapshot().version == 3 and same(s.snapshot().newest(), latest(odd))
    assert s.snapshot().newest("a/b=c %").count() == latest(odd.where("project_id = 'a/b=c %'")).count() > 0
    s.append(odd.limit(0), "none")
    assert s.snapshot().version == 4
