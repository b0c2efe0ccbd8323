"""Queries on tables whose keys begin elsewhere, have odd values in a zoomed range, or hold long texts."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from runlens import queries
from runlens.functions.expressions import truncate_bytes
from runlens.sources import imports as I

from test_queries import SF, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def compared(spark, folder, name, **tables):
    """A query's rows and those of its SQL, on the test tables with some of them (SQL of their rows) replaced."""
    con = duckdb.connect()
    for t in TABLES:
        if t in tables:
            con.execute(f"COPY ({tables[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    return rows(df.columns, df.collect()), rows(columns, cur.fetchall())


@pytest.mark.parametrize("key, customer", [("o_orderkey + 1000000000000000", "o_custkey"), ("nullif(o_orderkey, o_orderkey // 50 * 50)", "nullif(o_custkey, o_custkey // 3 * 3)")])
def test_jsonl_lines_of_large_and_missing_keys(spark, tmp_path, key, customer):
    """Whole seconds past 2^53 milliseconds are exact; an order without a key gives nothing, one without a run keeps its text."""
    got, want = compared(spark, tmp_path, "SRC_12_jsonl_history", orders=f"SELECT * REPLACE ({key} AS o_orderkey, {customer} AS o_custkey) FROM '{SF}/orders.parquet'")
    assert want and got == want


def test_jsonl_lines_of_odd_statuses(spark, tmp_path):
    status = """CASE o_orderkey % 4 WHEN 0 THEN 'a"b' WHEN 1 THEN '\\' WHEN 2 THEN chr(10) || 'NaN' || chr(9) || 'é' ELSE '' END"""
    got, want = compared(spark, tmp_path, "SRC_12_jsonl_history", orders=f"SELECT * REPLACE ({status} AS o_orderstatus) FROM '{SF}/orders.parquet'")
    assert want and got == want


@pytest.mark.parametrize("name", ["CH_3_log_ladder", "CH_9_11_ladder_smoothed"])
def test_ladder_whose_first_step_is_not_zero(spark, tmp_path, name):
    got, want = compared(spark, tmp_path, name, events=f"SELECT * REPLACE (event_id + 37 AS event_id) FROM '{SF}/events.parquet'")
    assert want and got == want


def test_zoom_with_a_step_that_only_has_markers(spark, tmp_path):
    # 303 is a multiple of 101: its only value is infinite
    got, want = compared(spark, tmp_path, "PF_3_5_in_range", events=f"SELECT * REPLACE (CASE WHEN event_id = 303 THEN 'click' ELSE event_type END AS event_type) FROM '{SF}/events.parquet'")
    assert want and got == want


def test_jsonl_lines_of_long_texts(spark):
    """A bare NaN beside a long text is read, however long the text."""
    long = "x\\\\" * 100_000
    lines = spark.createDataFrame([("r", 0, '{"a":NaN,"t":"' + long + '","b":-Infinity,"n":"NaN","s":{"Max":2,"Inf":NaN},"u":{"_type_a":null,"_type_b":"7"}}'), ("r", 1, "[NaN]"), ("r", 2, "{broken")], "run_id string, n int, line string")
    got = {r.metric_name: r.text_data or repr(r.value) for r in I.jsonl_points(lines, ["run_id"], ["n"], 5).collect()}
    assert got == {"a": "nan", "b": "-inf", "s/max": "2.0", "s/inf": "nan", "u": "7.0", "n": "NaN\n", "t": "x\\" * 31_999 + "x\n"}


def test_long_names_are_cut_without_a_fold(spark):
    """Names are cut by a look at the bytes around the limit, not character by character."""
    texts = ["é" * 1100, "a" + "é" * 1100, "日" * 700, "a" + "日" * 700, "\U0001f600" * 600, "ab\U0001f600" * 600, "x" * 3000]
    cut = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", truncate_bytes(F.col("s"), 2048).alias("t"))
    assert [r.t for r in cut.orderBy("i").collect()] == [t.encode()[:2048].decode("utf-8", "ignore") for t in texts]
    assert "aggregate" not in cut._jdf.queryExecution().optimizedPlan().toString()
