"""Plans of streaming tables that must not be one task's work or sort all rows."""

from pyspark.sql import functions as F

from runlens.sources import adapters as A
from runlens.streaming import ingest as N
from runlens.streaming import tiers

SF = "/root/testdata/sf0.001"


def test_a_batch_of_one_partition_is_dealt(spark, tmp_path):
    """The tables of a batch that comes as one partition are made by several tasks."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        N.write_batch(f"file://{tmp_path}")(A.points(spark, SF).coalesce(1), 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    held = spark.read.parquet(f"file://{tmp_path}/points")
    assert held.count() == A.points(spark, SF).count()
    cells = N.read(spark, f"file://{tmp_path}", "rollup")
    assert cells.agg(F.sum(F.col("n") + F.col("odd"))).first()[0] == held.count()
    assert len(list(tmp_path.glob("rollup/batch=0/*.parquet"))) > 1


def test_cells_are_hash_aggregates(spark):
    """Cells and their merges are hash aggregates, and keep the first value that can't be drawn."""
    p = A.points(spark, SF)
    fine = tiers.cells_of(p)
    wide = tiers.widened(fine, 16)
    for df in (fine, wide):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    odd = p.where("isnan(value) OR value = double('infinity')")
    want = {(r.run_id, r.metric_name, r.c): (r.o.step, r.o.k) for r in odd.groupBy("run_id", "metric_name", F.floor(F.col("step") / 64).alias("c")).agg(F.min(F.struct("step", F.when(F.isnan("value"), 1).otherwise(2).alias("k"))).alias("o")).collect()}
    got = {(r.run_id, r.metric_name, r.cell): (r.odd.step, r.odd.kind) for r in wide.where("odd IS NOT NULL").collect()}
    assert want and got == want
