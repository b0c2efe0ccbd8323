"""Line deduplication against a plain count of lines, with its edge cases and an interrupted index."""

import pytest
from pyspark.sql import functions as F

from runlens.llm import linededup

BLANK = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(texts, threshold, least=1):
    split = [(t or "").split("\n") for t in texts]
    n = {}
    for doc in split:
        for k in {key(x) for x in doc}:
            n[k] = n.get(k, 0) + 1
    drop = {k for k, v in n.items() if v >= threshold and len(k) >= least}
    return [(len(d), sum(key(x) in drop for x in d), "\n".join(x for x in d if key(x) not in drop)) for d in split]


TEXTS = [None, "", "\n\n", "Same line\nown 0", " same LINE\t\nown 1\nSAME line", "same line\r\nown 2\v", "É x\né x", "É x", "é x\n" * 3, " same line", *["twice\nonce %d" % (i // 2) for i in range(4)], "y" * 100_000 + "\nsame line"]


@pytest.mark.parametrize("threshold", [1, 2, 3, 5])
def test_lines_as_counted_plainly(spark, threshold):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = sorted(linededup.line_dedup(docs, threshold, batches=5, fanout=2).collect())
    assert [(r.n_lines, r.n_dropped, r.kept) for r in got] == brute(TEXTS, threshold)


def test_clashing_names_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "a\nb", 1, "z"), (None, "a\nb", 1, "z"), (7, "a\nc", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_ long, `KEPT` string").withColumn("odd.name", F.lit(3))
    got = linededup.line_dedup(docs, 3, batches=2)
    assert got.columns == ["doc_id", "text", "row_", "odd.name", "n_lines", "n_dropped", "kept"]
    assert sorted((r.doc_id or 0, r.n_dropped, r.kept) for r in got.collect()) == [(0, 1, "b"), (0, 1, "b"), (7, 1, "c")]
    assert linededup.line_dedup(docs.limit(0), 3).collect() == []


def test_index_settles_reopens_and_survives_an_unfinished_batch(spark, tmp_path):
    path = f"file://{tmp_path}/index"

    def batch(*texts):
        return linededup.count_lines(spark.createDataFrame([(t,) for t in texts], "text string"))

    index = linededup.LineIndex(spark, path, threshold=3, fanout=3)
    index.add(batch("a", "a", "a", "b"))
    index.add(batch("a", "b"))
    assert sum(r.n for r in index.counts().collect()) == 5  # the settled line isn't counted on
    index._write(index._dealt(batch("b", "b")))  # a run that no manifest names
    again = linededup.LineIndex(spark, path, threshold=3, fanout=3)
    assert again.runs == index.runs and again.frequent().count() == 1
    again.add(batch("b", "c"))
    assert [level for level, _ in again.runs] == [1]
    assert sorted(r.n for r in again.counts().collect()) == [1, 3, 3]
    plan = again._dealt(batch("b")).join(again._run(again.runs[0][1]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    run_side = plan[plan.index("SortMergeJoin") :].rsplit("Sort [", 1)[1]
    assert "Bucketed: true" in run_side and "Exchange" not in run_side  # a run is not shuffled
    again.release()
