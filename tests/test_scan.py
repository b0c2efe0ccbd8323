"""Segmented scans against plain windows, and the rows that their tasks hold."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import points as P
from runlens.plans import scan


def table(spark, n=20_000):
    """A series of nine tenths of all rows, a few small ones, one of a single row; values with nulls and ties."""
    i = F.col("id")
    key = F.when(i % 10 < 9, "hot").when(i == 19, "one").otherwise(F.concat(F.lit("k"), (i % 7).cast("string")))
    return spark.range(n).select(key.alias("k"), ((i * 7919) % n).alias("t"), F.when(i % 5 != 0, (i * 31) % 97).alias("v"))


def test_scans_equal_windows(spark):
    df = table(spark)
    w = Window.partitionBy("k").orderBy("t")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = scan.dealt(df, ["k"], ["t"], bits=6)
    ops = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v") - F.col("t")), "lo": ("min", F.col("v"))}
    for incl, win in ((False, upto), (True, before)):
        got = scan.undealt(scan.running(d, ["k"], ops, before=incl))
        want = df.select("*", F.sum("v").over(win).alias("s"), F.max(F.col("v") - F.col("t")).over(win).alias("hi"), F.min("v").over(win).alias("lo"))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    got = scan.undealt(scan.last_before(d, ["k"], {"last": F.col("v")}))
    want = df.withColumn("last", F.last("v", True).over(before))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    got, want = scan.previous(df, ["k"], ["t"], {"p": F.col("v")}, bits=5), df.withColumn("p", F.lag("v").over(w))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    got, want = scan.place(df, ["k"], ["t"], "n", bits=5), df.withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_no_task_holds_a_series(spark):
    """One series of nine tenths of 400,000 rows: each task of the dealing and of the windows holds at most twice the mean."""
    df = table(spark, 400_000)
    d = scan.dealt(df, ["k"], ["t"], bits=10)
    sizes = [r["count"] for r in d.groupBy(scan.RANGE).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * 400_000 / 4
    got = scan.running(d, ["k"], {"s": ("sum", F.lit(1))})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    # the window's tasks, as dealt by the same keys
    tasks = [r["count"] for r in d.repartition(4, "k", scan.BLOCK).groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) <= 2 * 400_000 / 4


@pytest.mark.parametrize("n", [0, 1])
def test_scans_of_almost_nothing(spark, n):
    df = table(spark, 1).limit(n)
    assert scan.previous(df, ["k"], ["t"], {"p": F.col("v")}).count() == n
    assert scan.place(df, ["k"], ["t"], "n").count() == n


def test_asof_of_a_hot_key(spark):
    """All rows of one key, in blocks: each left row meets the last right row at or before it."""
    left = spark.range(3000).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("t"), F.col("id").alias("l"))
    right = spark.range(900).select(F.lit("k").alias("k"), (F.col("id") * 10 + 5).alias("t"), F.col("id").alias("r"))
    got = {r.l: r.r for r in P.asof(left, right, ["k"], "t", ["r"]).collect()}
    assert got == {i: max(j for j in range(900) if j * 10 + 5 <= i * 3) if i * 3 >= 5 else None for i in range(3000)}


@pytest.mark.parametrize("most", [3, 100_000])
def test_range_join_of_a_dense_stretch(spark, most):
    """Half of the samples in a hundredth of the span: the same pairs with cells cut into parts, none of which is large."""
    rows = [("k", float(i)) for i in range(0, 1000, 10)] + [("k", 500 + i / 50) for i in range(100)] + [("j", 5.0)]
    right = spark.createDataFrame(rows, "k string, t double").withColumn("v", F.monotonically_increasing_id())
    left = spark.createDataFrame([("k", float(x)) for x in (0, 499, 501, 999)] + [("j", 7.0), ("none", 1.0)], "k string, t double")
    got = sorted((r.k, r.t, r.r_t) for r in P.range_join(left, right, ["k"], "t", 3.0, most).collect())
    assert got == sorted((a.k, a.t, b[1]) for a in left.collect() for b in rows if a.k == b[0] and abs(a.t - b[1]) <= 3.0)
