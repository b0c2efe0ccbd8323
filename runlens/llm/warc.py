"""WARC archives: one gzip member a record, written in tasks and read back sequentially.

``write_archives`` puts a record for each page into archive files in the shared folder. Of rows with equal payloads of
at least ``MIN_REVISIT`` bytes exactly one is a response, the first by page_id and url; the others are revisit records that
refer to its page_id and hold only the HTTP headers. ``read_archives`` reads each archive as a stream: bytes are inflated
a chunk at a time, a record's header ends at the empty line, its block is framed by Content-Length, and block and
payload digests are verified.

A task's file has a random name and only files that a finished task reports are read, so a lost executor's leftovers
are never seen. A task starts a new file after ``roll`` payload bytes, so each archive is bounded.

Edge cases: null html is an empty payload; an empty table gives no archive and an empty result; null urls are written
as ``about:blank``; of rows that repeat the first in page_id and url too, one is the response and the others are revisits of
their own page_id; null page_ids sort last, and revisits of a response without page_id refer to nothing. Extra columns are
ignored. Damaged members raise ``WarcError``, never pass silently.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, new_path, slices, stored

MIN_REVISIT = 100
_COPIES = 10_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that breaks the format or a digest that doesn't hold."""


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null in revisits), payload_bytes, payload_digest, revisit, refers_to.

    Rows are counted by digest, page_id and url, then by digest, with map-side partial sums; only digests that occur twice or
    more are joined back, in a join whose large partitions Spark can split."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    counted = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    firsts = counted.groupBy("payload_digest").agg(F.sum("copies").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "url", "copies")).alias("first"))
    firsts = stored(firsts.where("n > 1").select(F.col("payload_digest").alias("_digest"), "first"), "warc-firsts")
    joined = rows.join(firsts, rows.payload_digest == firsts._digest, "left")
    leads = F.col("first.page_id").eqNullSafe(F.col("page_id")) & (F.col("first.url") == F.col("url"))
    told = joined.withColumn("revisit", F.col("first").isNotNull() & ~F.coalesce(leads, F.lit(False))).withColumn("refers_to", F.when(F.col("revisit"), F.col("first.page_id")))
    columns = ["page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "revisit", "refers_to"]
    if firsts.where("first.copies > 1").isEmpty():
        return told.select(*columns)
    # a first row that is repeated: its copies are alike, so one response and the right number of revisits stand for them
    several = F.coalesce(~F.col("revisit") & (F.col("first.copies") > 1), F.lit(False))
    once = told.where(several).groupBy("page_id", "url", "payload_bytes", "payload_digest").agg(F.any_value("payload").alias("payload"), F.count(F.lit(1)).alias("copies"))
    response = once.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.lit(False), F.lit(None).cast("long"))
    parts = once.select("page_id", "url", "payload_bytes", "payload_digest", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 2) / _COPIES))).alias("part")).repartition("payload_digest", "part")
    size = F.least(F.lit(_COPIES).cast("long"), F.col("copies") - 1 - F.col("part") * _COPIES).cast("int")
    again = parts.select("page_id", "url", "payload_bytes", "payload_digest", F.explode(F.array_repeat(F.lit(True), size)).alias("revisit"))
    again = again.select("page_id", "url", F.lit(None).cast("binary"), "payload_bytes", "payload_digest", "revisit", F.col("page_id"))
    return told.where(~several).select(*columns).unionAll(response).unionAll(again)


def record(page_id: int | None, url: str, payload: bytes | None, payload_bytes: int, payload_digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{payload_digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, n = None, "", 0, 0
        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                out.write(member(record(**row)))
                size, n = size + (0 if row["revisit"] else row["payload_bytes"]), n + 1
                if size >= roll:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, roll: int = 64 << 20) -> DataFrame:
    """Writes the archives and returns their list: path, records, bytes (of payload)."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return stored(classify(pages).mapInArrow(_writer(folder, roll), "path string, records long, bytes long"), "warc-list")


class _Stream:
    """Inflates gzip members one after the other, ``step`` compressed bytes at a time."""

    def __init__(self, raw, step: int = 1 << 16):
        self.raw, self.step, self.rest = raw, step, b""
        self.z, self.buffer, self.ended = None, bytearray(), False

    def next_member(self) -> bool:
        if not self.rest:
            self.rest = self.raw.read(self.step)
        self.z, self.buffer, self.ended = zlib.decompressobj(31), bytearray(), False
        return bool(self.rest)

    def more(self) -> bool:
        if self.ended:
            return False
        if not self.rest:
            self.rest = self.raw.read(self.step)
            if not self.rest:
                raise WarcError("the file ends inside a gzip member")
        try:
            self.buffer += self.z.decompress(self.rest, 1 << 20)
        except zlib.error as e:
            raise WarcError(f"damaged gzip member: {e}") from None
        self.ended = self.z.eof
        self.rest = self.z.unused_data if self.ended else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                raise WarcError("a header has no end")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise WarcError(f"a block of {n} bytes ends after {len(self.buffer)}")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def finish(self) -> None:
        while not self.ended:
            self.more()
        if bytes(self.buffer) != b"\r\n\r\n":
            raise WarcError("a record doesn't end in two line breaks with its member")


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def records(raw) -> Iterator[dict]:
    """The records of one archive, in order: type, page_id, refers_to, payload (None in a revisit), payload_bytes, digest."""
    s = _Stream(raw)
    while s.next_member():
        head = s.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise WarcError("a member doesn't start with a WARC version")
        f = _fields(head)
        block = s.exactly(int(f["content-length"]))
        s.finish()
        if f["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise WarcError(f"block digest of {f['warc-record-id']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(_fields(http)["content-length"])
        digest = f["warc-payload-digest"].removeprefix("sha256:")
        revisit = f["warc-type"] == "revisit"
        if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise WarcError(f"payload digest of {f['warc-record-id']}")
        ident = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        yield {"page_id": ident(f["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": f["warc-type"], "refers_to": ident(f["warc-refers-to"]) if revisit else None, "target": f["warc-target-uri"], "payload": None if revisit else payload}


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target", pa.string()), ("payload", pa.binary())])


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, path = file_system(uri)
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as raw:
                    for r in records(raw):
                        size += r["payload_bytes"] * payloads + 500
                        held.append(r if payloads else r | {"payload": None})
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, _READ)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _READ)

    return run


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the listed archives; an archive is one task's sequential work."""
    spread = archives.select("path").repartition(max(1, archives.count()))
    return spread.mapInArrow(_reader(payloads), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, payload binary")
