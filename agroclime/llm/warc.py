"""WARC archives as a chunked record table.

A record is a run of rows (record_key, chunk_no, data); their data joined in order is a standard WARC 1.1 record
with an HTTP response block. Writer and reader go through a record chunk by chunk with an incremental SHA-1, so no
step builds a second copy of a large payload.
"""

from __future__ import annotations

import base64
import hashlib
import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroclime.llm.store import stored

CHUNK_BYTES = 256 << 10
_FLUSH = 4 << 20
CHUNK_SCHEMA = "record_key long, chunk_no int, data binary"
_CRLF = b"\r\n"


def digest_text(raw: bytes) -> str:
    return base64.b32encode(raw).decode("ascii")


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to): refers_to is the largest page with the same payload, null for that page itself.

    Payloads under ``min_bytes`` and pages without an id refer to nothing. Digests and ids are shuffled, not payloads.
    """
    facts = pages.select("page_id", F.sha1("html").alias("sha1"), F.octet_length("html").alias("n")).distinct()
    last = facts.filter((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha1", "n").agg(F.max("page_id").alias("top"))
    known = facts.join(last, ["sha1", "n"], "left")
    target = F.when(F.col("page_id").isNotNull() & (F.col("n") >= min_bytes) & (F.col("page_id") < F.col("top")), F.col("top"))
    return known.select("page_id", "sha1", target.alias("refers_to"))


def _head(page_id, url: str, digest: str, size: int, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = len(http) + (size if refers_to is None else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + _CRLF * 2 + http


def write_records(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of one record per page (page_id, url, html); a null html is an empty payload, a null url empty.

    A page row repeated whole gives a record each time. Other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # Only revisits are joined: a stored table of ids and digests, so that Spark's size check decides whether payloads move.
    marks = stored(decide(pages, min_bytes).filter("refers_to is not null"), "revisits").select(F.col("page_id").alias("id"), F.col("sha1").alias("same"), "refers_to")
    keyed = pages.withColumn("sha1", F.sha1("html"))
    joined = keyed.join(marks, (F.col("page_id") == F.col("id")) & (F.col("sha1") == F.col("same")), "left")
    # A revisit has no payload: only its size and digest go on.
    joined = joined.select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "refers_to", F.unhex("sha1").alias("sha1"), F.octet_length("html").alias("n"))

    def run(batches):
        key = TaskContext.get().partitionId() << 40
        rows: list[tuple[int, int, bytes]] = []
        held = 0

        def flush():
            keys, numbers, data = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["record_key", "chunk_no", "data"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, refers_to = (batch.column(c)[i].as_py() for c in (0, 1, 3))
                payload = memoryview(batch.column(2)[i].as_buffer() or b"") if refers_to is None else memoryview(b"")
                stated, size = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                if refers_to is None:
                    digest = hashlib.sha1()
                    for at in range(0, len(payload), chunk_bytes):
                        digest.update(payload[at : at + chunk_bytes])
                    stated = digest.digest()
                rows.append((key, 0, _head(page_id, url, digest_text(stated), size, refers_to)))
                number = 1
                for at in range(0, len(payload), chunk_bytes):
                    rows.append((key, number, bytes(payload[at : at + chunk_bytes])))
                    held += len(rows[-1][2])
                    number += 1
                    if held >= _FLUSH:
                        yield flush()
                        held = 0
                rows.append((key, number, _CRLF * 2))
                key += 1
                if len(rows) > 4000:
                    yield flush()
                    held = 0
        if rows:
            yield flush()

    return joined.mapInArrow(run, CHUNK_SCHEMA)


class Record:
    """What a reader learns of one record while its chunks pass by."""

    def __init__(self, head: bytes):
        warc, _, rest = head.partition(_CRLF * 2)
        version, *lines = warc.decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:20]!r}")
        self.headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        http, gap, start = rest.partition(_CRLF * 2)
        self.http = {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode("utf-8").split("\r\n")[1:])}
        self.left = int(self.headers["content-length"]) - len(http) - len(gap)
        self.seen, self.digest, self.tail = 0, hashlib.sha1(), b""
        self.feed(start)

    def feed(self, data: bytes) -> None:
        view = memoryview(data)[: self.left]
        self.digest.update(view)
        self.seen += len(view)
        self.left -= len(view)
        self.tail += data[len(view) :]

    def complete(self) -> bool:
        return not self.left and self.tail == _CRLF * 2

    def result(self) -> tuple:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to), checked against the bytes that passed."""
        kind = self.headers["warc-type"]
        stated = self.headers["warc-payload-digest"].removeprefix("sha1:")
        if not self.complete() or kind == "response" and stated != digest_text(self.digest.digest()):
            raise ValueError(f"damaged record {self.headers['warc-record-id']}")
        number = lambda name: int(x) if (x := self.headers.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
        return number("warc-record-id"), int(self.http["content-length"]), stated, kind, number("warc-refers-to")


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _records(batches, whole: bool):
    """Records whose chunks come in order, as rows (record_key, done, ...).

    Unless all chunks are there (``whole``), a record that begins or ends elsewhere gives a row that is not done.
    """
    names = ["record_key", "done", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    now, number, record, rows = None, -1, None, []

    def close():
        if now is None:
            return
        if record is not None and (whole or record.complete()):
            rows.append((now, True, *record.result()))
        elif whole:
            raise ValueError(f"record {now} has no head")
        else:
            rows.append((now, False, None, None, None, None, None))

    for batch in batches:
        keys, numbers, data = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for i, (key, at) in enumerate(zip(keys, numbers, strict=True)):
            if key != now or at == 0:
                close()
                now, number, record = key, -1, None
            if at == 0:
                record = Record(data[i].as_py())
            elif record is not None and at == number + 1:
                record.feed(data[i].as_buffer().to_pybytes())
            else:  # a chunk before this one is elsewhere
                record = None
            number = at
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_records(chunks: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record of a chunk table.

    A record's chunks lie together in its file, so each split is read in order without a shuffle. Records that a split
    cuts, or whose chunks lie anywhere else, are read again: only their chunks are brought together by record.
    """
    rows = chunks.select("record_key", "chunk_no", "data")
    kind = "record_key long, done boolean, " + _RECORD
    seen = stored(rows.mapInArrow(lambda batches: _records(batches, False), kind), "records")
    cut = seen.filter("not done").select("record_key").distinct()
    found = seen.join(cut, "record_key", "left_anti") if not cut.isEmpty() else seen
    if not cut.isEmpty():
        again = rows.join(cut, "record_key", "left_semi").repartition("record_key").sortWithinPartitions("record_key", "chunk_no")
        found = found.unionByName(again.mapInArrow(lambda batches: _records(batches, True), kind))
    return found.drop("record_key", "done")


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The stored archive of a page table, as chunk rows in the shared folder."""
    return stored(write_records(pages, min_bytes), "warc")


def export_files(chunks: DataFrame, folder: str) -> None:
    """Plain ``.warc`` files, one per partition, in a folder that every executor has mounted.

    On a cluster that is a folder under ``spark.checkpoint.dir``; another one is an error, as a local disk loses parts.
    """
    spark = chunks.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", "").removeprefix("file://").rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local" and not (shared and os.path.abspath(folder).startswith(shared + "/")):
        raise ValueError(f"{folder} is not under spark.checkpoint.dir, which all executors share")
    ordered = chunks.select("record_key", "chunk_no", "data").repartition("record_key").sortWithinPartitions("record_key", "chunk_no")

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc"
        n = 0
        with open(f"{name}.{TaskContext.get().taskAttemptId()}", "wb") as out:
            for batch in batches:
                for x in batch.column(2):
                    n += out.write(x.as_buffer())
        os.replace(out.name, name)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["bytes"])

    ordered.mapInArrow(run, "bytes long").agg(F.sum("bytes")).collect()
