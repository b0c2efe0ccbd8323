"""The pipeline's stages one after the other, and the registered queries on the smallest tables."""

import os
import zlib

import duckdb
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import neardup, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cur = con.execute(queries.ORACLES[name])
        columns = [c[0] for c in cur.description]
        key = lambda r: repr([r[c] for c in sorted(columns)])
        assert sorted(map(key, got)) == sorted(key(dict(zip(columns, r, strict=True))) for r in cur.fetchall())


def test_held_out_is_by_crc(spark):
    for name, n, r in (("op7_toxicity", 5, 0), ("op10_language", 3, 1)):
        for row in queries.QUERIES[name](spark, SF).collect():
            assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % n == r) and 0 <= row.score <= 1


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert out.columns == docs.columns
            before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
            assert after.items() <= before.items()
            docs = out
        ids.append(out.count())
    assert ids == sorted(ids, reverse=True) and ids[-1] == ids[-2] > 0
    assert all(r.lossless for r in corpus_pipeline.run(spark, SF).collect())


EMPTY = [(1, None), (2, ""), (3, "..."), (None, "the river and the stone with some water over there")]


@pytest.fixture
def odd_tables(spark, tmp_path):
    """Documents with clashing columns, null and repeated ids and empty texts, beside the smallest tables."""
    small = spark.read.parquet(f"{SF}/documents.parquet")
    schema = small.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in EMPTY], schema)
    docs = small.unionAll(small.limit(3)).unionAll(more)
    docs = docs.withColumns({"score": F.lit("s"), "Lang_Pred": F.lit("l"), "predicted": F.lit("p"), "toxic_predicted": F.lit("t"), "_kept": F.lit("k"), "_digest": F.lit("d"), "a.b": F.lit("dot")})
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"file://{tmp_path}/{t}.parquet")
    return f"file://{tmp_path}"


def test_pipeline_keeps_columns_and_odd_rows(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, odd_tables), name)
        assert docs.columns == names and 0 < docs.count() <= before.count()
        fixed = docs.select("score", "Lang_Pred", "predicted", "toxic_predicted", "_kept", "_digest", "`a.b`").distinct().collect()
        assert [tuple(r) for r in fixed] == [("s", "l", "p", "t", "k", "d", "dot")]
        if name == "language_id":
            assert before.count() - docs.count() >= 3 and docs.where("doc_id IS NULL").count() == 1
    assert docs.groupBy("doc_id", "text").count().where("count > 1").isEmpty()


def test_pipeline_of_no_documents(spark, odd_tables, tmp_path):
    spark.read.parquet(f"{odd_tables}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"file://{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_stages_take_what_they_should(spark):
    """Each filtering stage against a plain statement of its rule on the smallest tables."""

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name: sorted(r.doc_id for r in stages[name](spark, docs, SF).collect())
    assert kept("language_id") == sorted(r.doc_id for r in rows if any(map(str.isalpha, r.text or "")))
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert kept("near_duplicates") == sorted(i for i, c in classes.items() if i == c)
    hits = {r.doc_id: r.n_hit for r in queries.QUERIES["op3_decontaminate"](spark, SF).collect()}
    assert kept("decontamination") == sorted(i for i, n in hits.items() if not n)
