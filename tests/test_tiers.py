"""Charts from tiers against charts of the points, after appends, late rows, rewrites and removals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.plans.chart import Request, chart
from runlens.streaming.store import PointStore
from runlens.streaming.tiers import Tiers

SCHEMA = "project_id string, run_id string, metric_name string, tag string, step long, timestamp_ms long, value float, cdn_key string, text_data string, inserted_at timestamp"


def batch(spark, k, lo, hi, late=()):
    rng = np.random.default_rng(k)
    rows = []
    for run in ("a", "b"):
        for tag in ("", "0", "1") if run == "b" else ("",):
            steps = [*range(lo, hi, 1 if run == "a" else 3), *late]
            for s in steps:
                v = float(rng.normal()) if rng.random() > 0.02 else [math.nan, math.inf][s % 2]
                gone = s in late and rng.random() < 0.4
                rows.append(("p", run, "loss", tag, int(s), int(s) * 10, None if gone else v, None, "x\n" if gone else None, k * 10_000 + s))
    df = spark.createDataFrame(rows, SCHEMA.replace("inserted_at timestamp", "ms long"))
    return df.select("*", F.timestamp_millis("ms").alias("inserted_at")).drop("ms")


@pytest.fixture(scope="module")
def tiers(spark, tmp_path_factory):
    t = Tiers(PointStore(spark, f"file://{tmp_path_factory.mktemp('tiers')}/t", buckets=2))
    t.apply(batch(spark, 0, 0, 1500), 0)
    t.apply(batch(spark, 1, 1500, 2100, late=(3, 4, 5, 6, 7, 700, 701)), 1)
    t.build((16, 256))
    t.apply(batch(spark, 2, 2100, 2700, late=(5, 1499, 1800)), 2)
    t.apply(batch(spark, 2, 2100, 2700, late=(5, 1499, 1800)), 2)  # replayed
    t.apply(batch(spark, 3, 2690, 3300), 3)  # some steps again
    return t


def plain(df):
    r = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v
    cols = sorted(df.columns)
    return sorted((tuple(r(x[c]) for c in cols) for x in df.collect()), key=repr)


@pytest.mark.parametrize(
    "req",
    [Request(("loss",), target=100), Request(("loss",), target=7), Request(("loss",), target=600), Request(("loss",), runs=("b",), target=40, tags=("1",)), Request(("loss",), target=50, steps=(701, 2902)), Request(("loss",), target=900), Request(("loss",), target=5000), Request(("none",), target=10), Request(("loss",), target=30, log_x=True)],
)
def test_tiers_answer_as_points_do(tiers, req):
    assert plain(tiers.chart("p", req)) == plain(chart(tiers.store.snapshot().points(), req))


def test_envelopes_read_no_points(tiers):
    assert tiers.catalogue() == {16: 1, 256: 1}
    files = tiers.cells(64, lambda df: df).inputFiles()
    assert files and all("/tiers/" in f for f in files) and any("/wide=16/" in f for f in files) and not any("/data/" in f for f in files)


def test_a_purge_and_an_empty_store(spark, tmp_path):
    t = Tiers(PointStore(spark, f"file://{tmp_path}/t", buckets=2))
    req = Request(("loss",), target=10)
    assert t.chart("p", req).count() == 0
    t.build()
    assert t.catalogue() == {}
    t.apply(batch(spark, 0, 0, 300), 0)
    t.store.purge(spark.createDataFrame([("p", "a")], "project_id string, run_id string"))
    t.apply(batch(spark, 1, 300, 400, late=(7,)), 1)
    got = plain(t.chart("p", req))
    assert got == plain(chart(t.store.snapshot().points(), req)) and {r[1] for r in t.chart("p", req).select("tag", "run_id").collect()} == {"b"}
