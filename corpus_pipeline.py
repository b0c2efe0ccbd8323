"""The corpus pipeline: documents in, tokenised clean documents out.

Each stage works on all that the one before it kept. ``run`` writes every stage's rows as Parquet into the shared folder
and reads them again as the next stage's documents. All columns of the documents pass through the filtering stages
unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontaminate, langid, neardup, sptok, toxicity
from runlens.llm.common import columns, discard, free_names, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text or no letter) go."""
    langs, log_p = langid.train(docs)
    names = tuple(free_names(docs, "lang_pred", "lang_score"))
    return langid.predict(docs, langs, log_p, names=names).where(F.col(names[0]) != "und").select(*columns(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    names = tuple(free_names(docs, "toxic_score", "toxic_predicted"))
    return toxicity.predict(docs, toxicity.train(docs, labels), names=names).where(F.col(names[1]) == 0).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest doc_id."""
    return neardup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; documents without are untouched."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of each document, and whether they decode to its text."""
    return sptok.round_trip(docs)


STAGES = [("language_id", language_id), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("sentencepiece", sentencepiece)]

#: The stages are learnt, hashed or sampled, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
