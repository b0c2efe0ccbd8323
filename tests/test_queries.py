"""Every registered engine query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from runlens import queries
from runlens.operators import media

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name in queries.ORACLES:
        cur = duck.execute(queries.ORACLES[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, cur.fetchall())


def test_gallery_of_flat_rows(spark):
    """Flat rows need no array of a run's items, and give the places that arrays give."""
    runs = [(0, "a", ["x0", "x1", "x2"]), (1, "b", ["y0"]), (2, "c", ["z0", "z1"])]
    nested = spark.createDataFrame(runs, "run_order long, run_id string, items array<string>")
    flat = spark.createDataFrame([(o, r, i, x) for o, r, items in runs for i, x in enumerate(items)], "run_order long, run_id string, i int, item string")
    for layout in ("run", "index", "interleaved"):
        assert sorted(media.gallery(flat, layout).collect()) == sorted(media.gallery(nested, layout).collect())
    assert [r.item for r in media.gallery(flat, "interleaved").orderBy("place").collect()] == ["x0", "y0", "z0", "x1", "z1", "x2"]
