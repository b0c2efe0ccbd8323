"""Token counts by separator scan of flat, unindexed token files.

A file is nothing but token ids in a fixed little-endian width, documents one after the other, each closed by the
end-of-document id. Files are cut into blocks of ``block`` tokens that are read by offset and searched by a vectorised
comparison, each block a task's work by itself. A prefix scan over one small row for each block (separators before it, place of the
last one) then stitches documents that cross blocks, however many they cross.

Edge cases: an empty document is two separators in a row and counts 0; tokens behind the last separator are one more
document with ``closed`` false; an empty file has no documents; a file whose size is no multiple of the width raises an
error. For the writer: null and empty texts are empty documents, texts are tokenised whole, the end-of-document string
in a text is ordinary text, repeated rows are repeated documents, extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZERS, file_system, new_path, read_bytes, slices, stored

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
EOD = 50256
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _writer(folder: str, ranks: bytes, eod: int, dtype: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (store, path) = encoding(ranks), file_system(folder)
        store.create_dir(path, recursive=True)
        out, name, n, size = None, "", 0, 0
        for batch in slices(batches, "text"):
            names, ordinals = [], []
            for text in batch.column("text").to_pylist():
                if out is None:
                    name, n, size = f"{folder}/{uuid.uuid4().hex}.bin", 0, 0
                    out = store.open_output_stream(f"{path}/{name.rpartition('/')[2]}", compression=None)
                ids = np.array([*(enc.encode_ordinary(text) if text else ()), eod], dtype)
                out.write(ids.tobytes())
                names.append(name)
                ordinals.append(n)
                n, size = n + 1, size + ids.nbytes
                if size >= roll:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ordinals, pa.int64()), batch.column("doc_id")], ["path", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    return run


def write_token_files(docs: DataFrame, folder: str | None = None, ranks_path: str = RANKS, eod: int = EOD, dtype: str = "<u2", roll: int = 64 << 20) -> DataFrame:
    """Tokenises whole texts into flat files in the shared folder and returns what stands where: path, ordinal, doc_id.

    A file has a random name and counts only if the task that wrote it is the one whose rows were kept, so leftovers of
    lost executors are never read."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_writer(folder, read_bytes(ranks_path), eod, dtype, roll), "path string, ordinal long, doc_id long"), "token-list")


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for uri in batch.column("path").to_pylist():
                store, path = file_system(uri)
                sizes.append(store.get_file_info(path).size)
                if sizes[-1] % width:
                    raise ValueError(f"{uri}: {sizes[-1]} bytes are no whole tokens of {width} bytes")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([s // width for s in sizes], pa.int64())], ["path", "tokens"])

    return run


def _scanner(eod: int, dtype: str, block: int):
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, k in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                store, path = file_system(uri)
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(block * width, k * block * width), dtype)
                ends = np.flatnonzero(ids == eod).astype(np.int64) + k * block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri]), pa.array([k], pa.int64()), pa.array([k * block + len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends[-1] if len(ends) else None], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    ["path", "block", "stop", "n", "last", "ends"],
                )

    return run


def count_tokens(files: DataFrame, eod: int = EOD, dtype: str = "<u2", block: int = 1 << 20) -> DataFrame:
    """path, ordinal, start, n_tokens, closed for each document of the listed files (``path``)."""
    sized = files.select("path").distinct().mapInArrow(_sizes(np.dtype(dtype).itemsize), "path string, tokens long")
    blocks = sized.where("tokens > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block))).alias("block"))
    scanned = stored(blocks.repartition("path", "block").mapInArrow(_scanner(eod, dtype, block), "path string, block long, stop long, n long, last long, ends array<long>"), "scanned")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    slim = scanned.select("path", "block", "stop", "n", "last")
    carried = slim.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"), (F.col("block") == F.max("block").over(whole)).alias("final"))
    stitched = scanned.join(carried, ["path", "block"])
    inner = stitched.select("path", "done", "carry", "ends", F.posexplode("ends").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    closed = inner.select("path", (F.col("done") + F.col("i")).alias("ordinal"), start.alias("start"), "stop", F.lit(True).alias("closed"))
    rest = F.coalesce("last", "carry") + 1
    tail = stitched.where("final").where(F.col("stop") > rest).select("path", (F.col("done") + F.col("n")).alias("ordinal"), rest.alias("start"), "stop", F.lit(False).alias("closed"))
    return closed.unionAll(tail).select("path", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")
