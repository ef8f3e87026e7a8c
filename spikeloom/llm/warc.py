"""WARC archives as streams of payload chunks (operator 5).

Writing: a payload becomes rows (record, chunk number, bytes) of bounded size; a task turns
its rows into one `.warc.gz` file of one gzip member a record, chunk by chunk, with a running
SHA-1. Reading: a file is parsed as a stream into the same kind of rows, each with the
digest so far, and a record's digest and length are held against its header at its end.
No step but the row that a table hands over holds a whole record.

Of records with equal payloads of at least `min_bytes` bytes, the one with the largest id
is a `response`, the others are `revisit` records without payload that refer to it.
Null payloads are empty ones. Rows with a null id are never referred to unless all are null;
rows that share the largest id are all responses. Files are named by task attempt, and only
those of attempts that Spark committed are read, so a lost executor leaves no double records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, partitions, stored

CHUNK = 1 << 18
URN = "urn:spikeloom:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str, mode: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_output_stream(path, compression=None) if mode == "w" else where.open_input_stream(path, compression=None)


def _b32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Every row with its record type: (id, url, payload, payload_bytes, sha1, record_type, refers_to)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("key", F.sha2("payload", 256))
    lone = F.octet_length("payload") < F.lit(min_bytes)
    # one row for each payload that occurs more than once; written, so that the join below shuffles both sides plainly and Spark splits a hot payload
    best = stored(rows.filter(~lone).groupBy("key").agg(F.max("id").alias("best"), F.count("*").alias("n")).filter("n > 1").select("key", "best"), "warc-best")
    seen = rows.join(best, "key", "left")
    again = F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.col("id"))
    return seen.select(
        "id", "url", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha1("payload")).alias("sha1"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("best")).alias("refers_to"))


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: each record's rows follow each other, an empty one has one row.

    Chunk numbers are exploded, and each row then takes its own bytes of the payload, in one
    stage of generated code: no array of chunks is made, and no row but the source's is whole.
    """
    keep = [c for c in records.columns if c != "payload"]
    numbered = records.select("*", F.explode(F.expr(f"sequence(0, greatest(octet_length(payload) - 1, 0) div {chunk})")).alias("chunk_no"))
    return numbered.select(*keep, "chunk_no", F.expr(f"substring(payload, cast(chunk_no as int) * {chunk} + 1, {chunk})").alias("chunk"))


def write_archives(records: DataFrame, date: str = "1970-01-01T00:00:00Z", chunk: int = CHUNK) -> DataFrame:
    """Writes `plan`'s records; returns the stored list of files (uri, records)."""
    base = fresh_path(records.sparkSession, "warc")
    rows = chunk_rows(records, chunk).select("id", F.coalesce("url", F.lit("")).alias("url"), "payload_bytes", "sha1", "record_type", "refers_to", "chunk_no", "chunk")

    def run(batches):
        ctx, out, uri, n = TaskContext.get(), None, "", 0
        pack = crc = None
        left = 0
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for ident, url, size, sha, kind, refers, no, data in zip(*cols, strict=True):
                if out is None:
                    uri = f"{base}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
                    out = _open(uri, "w")
                if no == 0:
                    if pack is not None:
                        _close(out, pack, left, crc)
                    pack, crc, left = zlib.compressobj(1, zlib.DEFLATED, 31), (sha, hashlib.sha1()), size if kind == "response" else 0
                    out.write(pack.compress(_header(ident, url, size, sha, kind, refers, date)))
                    n += 1
                crc[1].update(data)
                left -= len(data)
                out.write(pack.compress(data))
        if out is not None:
            _close(out, pack, left, crc)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["uri", "records"])

    return stored(map_arrow(rows, run, "uri string, records long"), "warc-files")


def _header(ident, url: str, size: int, sha: bytes, kind: str, refers, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if ident is None else ident}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url.translate({10: ' ', 13: ' '})}", f"WARC-Payload-Digest: sha1:{_b32(sha)}", f"X-Payload-Length: {size}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers}>"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + http


def _close(out, pack, left: int, digest) -> None:
    if left or (digest[1].digest() != digest[0] and left == 0 and digest[1].digest() != hashlib.sha1().digest()):
        raise ValueError("a record's chunks don't match its digest")
    out.write(pack.compress(b"\r\n\r\n") + pack.flush())


def parse(stream, chunk: int = CHUNK) -> Iterator[tuple[dict, int, bytes, bytes, bool]]:
    """(headers, chunk number, bytes, SHA-1 so far, whether last) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head = _fields(stream)
        left = int(head["content-length"])
        if head["warc-type"] == "response":
            left -= len(stream.readline())
            left -= _fields(stream, True)
        sha, no = hashlib.sha1(), 0
        while True:
            data = stream.read(min(chunk, left))
            if left and not data:
                raise ValueError("a record is cut short")
            left -= len(data)
            sha.update(data)
            if not left and head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{_b32(sha.digest())}":
                raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
            yield head, no, data, sha.digest(), not left
            no += 1
            if not left:
                break


def _fields(stream, count: bool = False):
    head, n = {}, 0
    while line := stream.readline():
        n += len(line)
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip().lower()] = value.strip()
    return n if count else head


def _files(files: DataFrame) -> DataFrame:
    return files.select("uri").repartition(max(partitions(files.sparkSession), 1), "uri")


def _id(value: str) -> str | None:
    return value.strip("<>").removeprefix(URN) or None


def read_chunks(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(record_id, record_type, refers_to, chunk_no, chunk, sha1_so_far) of all records of the listed files."""

    def run(batches):
        for uri in (u for b in batches for u in b.column(0).to_pylist()):
            with _open(uri, "r") as raw, gzip.GzipFile(fileobj=raw) as stream:
                for head, no, data, sha, _ in parse(stream, chunk):
                    row = {"record_id": _id(head["warc-record-id"]), "record_type": head["warc-type"], "refers_to": _id(head.get("warc-refers-to", "")), "chunk_no": no, "chunk": data, "sha1_so_far": sha}
                    yield pa.RecordBatch.from_pylist([row], _CHUNKS)

    return map_arrow(_files(files), run, "record_id string, record_type string, refers_to string, chunk_no long, chunk binary, sha1_so_far binary")


_CHUNKS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("sha1_so_far", pa.binary())])
_RECORDS = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])


def read_records(files: DataFrame) -> DataFrame:
    """One row a record, after its payload has been streamed and verified."""

    def run(batches):
        rows = []
        for uri in (u for b in batches for u in b.column(0).to_pylist()):
            with _open(uri, "r") as raw, gzip.GzipFile(fileobj=raw) as stream:
                size = 0
                for head, no, data, _, last in parse(stream):
                    size = len(data) if no == 0 else size + len(data)
                    if not last:
                        continue
                    if head["warc-type"] == "response" and size != int(head["x-payload-length"]):
                        raise ValueError("a payload's length doesn't match its header")
                    rows.append({
                        "record_id": _id(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": int(head["x-payload-length"]),
                        "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"), "record_type": head["warc-type"], "refers_to": _id(head.get("warc-refers-to", "")),
                    })
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                        rows = []
        yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    return map_arrow(_files(files), run, "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
