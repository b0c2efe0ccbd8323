"""Helpers shared by the corpus operators: shared scratch tables and Arrow batch handling."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
_WORDS = re.compile(r"[^\W\d_]+")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. A temporary one only in local mode without that
    setting; elsewhere its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="runlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_folder", None)):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't hold, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in range(len(taken) + 1) if (n := name + "_" * i).lower() not in taken) for name in names]


def with_results(df: DataFrame, maker, results: list[tuple[str, str]]) -> DataFrame:
    """``df`` through the Arrow function ``maker(kept)`` makes, which yields the columns ``kept`` and then those of ``results``
    (name and type). Columns named like a result, in any case, are replaced; others may have any name (names with dots, which
    ``mapInArrow`` can't take, have others meanwhile)."""
    taken = {n.lower() for n, _ in results}
    safe = [c if re.fullmatch(r"\w+", c) else f"odd{i}_" for i, c in enumerate(df.columns)]
    kept = [(c, s, f.dataType) for c, s, f in zip(df.columns, safe, df.schema.fields, strict=True) if c.lower() not in taken]
    schema = T.StructType([T.StructField(s, t) for _, s, t in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in results])
    return df.toDF(*safe).mapInArrow(maker([s for _, s, _ in kept]), schema).toDF(*[c for c, _, _ in kept], *[n for n, _ in results])


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it, for Python code inside tasks."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri)


def read_bytes(path: str) -> bytes:
    """A small driver-side file (a tokenizer's vocabulary, a few MB at most)."""
    with open(path, "rb") as f:
        return f.read()


def release() -> None:
    """Gives memory that a task's arrays left free back to the system: Python workers are reused, and what each keeps of its
    largest task would stand beside the next ones' needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes in each; one larger text makes a batch by itself. Before the
    first and behind the last one free memory is given back."""
    release()
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(column)
            sizes = np.cumsum(np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)))
            start = 0
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
                yield batch.slice(start, end - start)
                start = end
    finally:
        release()


def letter_runs(text: str) -> list[str]:
    """Maximal runs of letters. The pattern also takes numerals that are no decimal digits, such as superscripts and
    fractions; the few words with any are cut at them."""
    found = _WORDS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply), in place where it can be."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
