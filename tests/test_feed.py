"""The change feed as a real stream: bursts, replays, timers and the end of state."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from runlens.streaming import feed


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_a_burst_is_a_frame_and_replays_are_none(spark, tmp_path, store):
    src = f"{tmp_path}/in"
    put = lambda versions, run="r": spark.createDataFrame([(run, v) for v in versions], "run_id string, version long").coalesce(1).write.mode("append").parquet(src)
    put(range(1, 101))
    changes = spark.readStream.schema("run_id string, version long").parquet(src)
    q = feed.frames(changes, every_ms=15_000).writeStream.format("memory").queryName("feed_frames").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(processingTime="200 milliseconds").start()
    got = lambda: [(r.run_id, r.version) for r in spark.sql("SELECT * FROM feed_frames ORDER BY run_id, at_ms").collect()]

    def until(n, seconds=60):
        end = time.time() + seconds
        while len(got()) < n and time.time() < end:
            time.sleep(0.2)
        return got()

    try:
        assert until(1) == [("r", 100)]  # a hundred versions, one frame
        put(range(1, 101))  # a replay
        put([101]), put([102]), put([103])
        assert until(2)[-1] == ("r", 103)  # what came within the interval is sent once, by the timer
        put([5], "s")
        assert ("s", 5) in until(3)
        times = [r.at_ms for r in spark.sql("SELECT at_ms FROM feed_frames WHERE run_id = 'r' ORDER BY at_ms").collect()]
        assert all(b - a >= 15_000 for a, b in zip(times, times[1:]))
        assert q.exception() is None
    finally:
        q.stop()


@pytest.mark.parametrize("files", [1, 5])
def test_frames_of_the_past_do_not_depend_on_batches(spark, tmp_path, store, files):
    """By the changes' own time: at most a frame a second, the same for any cut into micro-batches; state ends."""
    t0 = datetime.datetime(2024, 1, 1)
    stamps = [0, 10, 500, 999, 1000, 1500, 2600, 2700, 9000, 9100, 70_000]
    rows = [("r", i + 1, t0 + datetime.timedelta(milliseconds=s)) for i, s in enumerate(stamps)]
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], "run_id string, version long, event_time timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k:02}")
    s = spark.readStream.schema("run_id string, version long, event_time timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    feed.frames(s, forget_ms=30_000, watermark="0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    base = int(t0.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    got = sorted((r.at_ms - base, r.version) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 1), (1000, 5), (2000, 6), (3000, 8), (9000, 9), (10_000, 10), (70_000, 11)]
