"""Content-defined document fingerprints (operator 8).

A text's UTF-8 bytes are normalised (A-Z to a-z, each run of ASCII white space to one
space) and cut where a gear hash over the last 32 bytes says so, with normalised chunking:
few cuts before the usual size, more after it. The fingerprint is the set of the chunks'
64-bit digests with their lengths as weights; an insertion changes the chunks near it and
no others. Likeness is containment: the weight of the chunks of A that B has too, over the
weight of A; 1 if both are empty, 0 if only A is.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, cut_points, gear_hash, gear_values, map_arrow, partitions, sort_buckets

#: Bytes a chunk has at least, usually and at most, and the bits that a cut needs clear.
LEAST, USUAL, MOST, STRICT, LOOSE = 32, 96, 1024, 0xFE000000, 0xF8000000
_GEAR = gear_values(8, 256)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def normalise(text: bytes) -> bytes:
    return b" ".join(text.translate(_LOWER).split())


def fingerprints(texts: list[bytes]) -> list[dict[int, int]]:
    """Digest -> length of each text's distinct chunks, in order of first occurrence."""
    texts = [normalise(t) for t in texts]
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts]).tolist()
    hashes = gear_hash(_GEAR[np.frombuffer(data, np.uint8)])
    out, start = [], 0
    for end, cuts in zip(ends, cut_points(hashes, ends, LEAST, USUAL, MOST, STRICT, LOOSE), strict=True):
        found, s = {}, start
        for c in cuts:
            found[xxhash.xxh64_intdigest(data[s:c])] = c - s
            s = c
        out.append(found)
        start = end
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    whole = sum(a.values())
    if not whole:
        return 1.0 if not b else 0.0
    return sum(n for d, n in a.items() if d in b) / whole


def written(found: dict[int, int]) -> str:
    """Digest in 16 hex digits and length in hex, comma-joined by ascending digest."""
    return ",".join([f"{d:016x}{n:x}" for d, n in sorted(found.items())])


def read(fingerprint: str) -> dict[int, int]:
    return {int(x[:16], 16): int(x[16:], 16) for x in fingerprint.split(",")} if fingerprint else {}


def edited(text: str, following: str) -> str:
    """The last half (rounded down) gives way to as many first code points of the other text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, id, text, copy) rows dealt and sorted so that each row's successor follows it.

    Rows are dealt by ranges of id; a range's first row is also sent, as a copy, to the end
    of the range before it, and the first of all to the last. Equal ids are ordered by text,
    null ids come first. One shuffle of the texts; of each range the driver sees one id.
    """
    n = 4 * partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.withColumn("bucket", bucket_of("id", sort_buckets(base, "id", n)))
    heads = sorted((r["bucket"], r["nulls"] > 0, r["id"]) for r in base.groupBy("bucket").agg(F.min("id").alias("id"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).collect())
    if not heads:
        return base.select("bucket", "id", "text", F.lit(False).alias("copy"))
    before = {b: heads[i - 1][0] for i, (b, _, _) in enumerate(heads)}
    is_head = F.lit(False)
    target = F.lit(None).cast("int")
    by_bucket = F.create_map(*[F.lit(x) for b, nulls, i in heads if not nulls for x in (b, i)]) if any(not x[1] for x in heads) else None
    null_head = heads[0][1]
    targets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    if by_bucket is not None:
        is_head = F.coalesce(F.col("id") == by_bucket[F.col("bucket")], F.lit(False))
    if null_head:
        is_head = F.when(F.col("id").isNull(), True).otherwise(is_head & (F.col("bucket") != heads[0][0]))
    target = targets[F.col("bucket")]
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    sent = F.explode(F.when(is_head, F.array(own, F.struct(target.alias("bucket"), F.lit(True).alias("copy")))).otherwise(F.array(own)))
    rows = base.select("id", "text", sent.alias("to")).select("to.bucket", "id", "text", "to.copy")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "copy", F.col("id").asc_nulls_first(), "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    Null texts are empty and have an empty fingerprint. The only document is its own
    successor. A partition is streamed; it keeps one row back.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pairs(batches):
        """Groups of (id, text, next text)."""
        held = None
        for b in batches:
            out = []
            for bucket, ident, text, copy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[0] == bucket:
                    out.append((held[1], held[2], text))
                # of the copies of a range, the first is the successor
                held = None if copy else (bucket, ident, text)
            yield out, b.schema.field(1).type
        if held is not None:
            raise AssertionError("a range has no successor")

    def run(batches):
        for group, id_type in pairs(batches):
            for i in range(0, len(group), 128):
                part = group[i : i + 128]
                texts = [t for _, t, _ in part]
                changed = [edited(t, x) for _, t, x in part]
                # a row's successor is mostly the next row: hashed once
                wanted, at = [], {}
                for t in chain(texts, changed, (x for _, _, x in part)):
                    if t not in at:
                        at[t] = len(wanted)
                        wanted.append(t)
                prints = fingerprints([t.encode("utf-8", "surrogatepass") for t in wanted])
                own, new, nxt = ([prints[at[t]] for t in ts] for ts in (texts, changed, [x for _, _, x in part]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in part], id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array(changed, pa.string()),
                        pa.array([written(x) for x in own], pa.string()), pa.array([written(x) for x in new], pa.string()),
                        pa.array([containment(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
                        pa.array([containment(a, b) for a, b in zip(own, nxt, strict=True)], pa.float64()),
                    ],
                    names,
                )

    return map_arrow(with_next(docs, id_col, text_col), run, schema)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
