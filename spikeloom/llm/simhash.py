"""SimHash near-duplicates by covering locality-sensitive hashing (operator 9).

Each of 31 bit masks keeps the bits whose 5-bit code has odd parity with the mask's number.
Four differing bits put four linear conditions on a number of five bits, so some mask but
the zero one drops them all: every pair within radius 4 agrees under some mask. Tables hold
distinct fingerprints, so copies of a text cost one entry. A bucket's entries are compared
by a search that takes linked entries out as it finds them and gives a spanning forest, not
all pairs. Buckets over `bucket_rows` go another exact way: two fingerprints within four
bits have a word within two bits of both in common, and all that share such a word are
linked, so each is joined to the words around it.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resemblance
from .common import bytes_of, map_arrow, partitions, stored
from .graph import components

RADIUS = 4
SHINGLE = 4
BUCKET_ROWS = 20_000


def masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask (as signed) for each non-zero number of radius+1 bits."""
    top = 2 ** (radius + 1) - 1
    codes = [1 + i % top for i in range(64)]
    out = [sum(1 << i for i, c in enumerate(codes) if bin(c & v).count("1") % 2) for v in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash (unsigned) of a text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, 42)]
    else:
        ends = list(accumulate([len(w) + 1 for w in words]))
        hashes = [digest(line[a:b], 42) for a, b in zip([0, *ends], [e - 1 for e in ends[shingle - 1 :]], strict=False)]
    n, total = len(hashes), np.zeros(64, np.int64)
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(raw[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) of every whole text; null and wordless texts: 0."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t) for t in bytes_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["id", "fingerprint"])

    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, fingerprint long")


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the values (distinct uint64) within `radius` bits of each other."""
    left, out = values, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                front += list(found)
                left = left[~near]
    return out


def _bucket_edges(radius: int, bucket_rows: int):
    """Of rows (table, key, fingerprint) sorted by them: edges, and the members of too large buckets (b null)."""

    def groups(batches):
        """(values, whether too large); a bucket is never held beyond bucket_rows."""
        held, key, large = [], None, False
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            t, k, v = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            v = v.view(np.uint64)
            cuts = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), len(v)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                now = (t[s], k[s])
                if now != key:
                    if size > 1 and held:
                        yield np.concatenate(held) if len(held) > 1 else held[0], large
                    held, key, large, size = [], now, False, 0
                held.append(v[s:e])
                size += e - s
                if size > bucket_rows:
                    large = True
                    yield np.concatenate(held), True
                    held = []
        if size > 1 and held:
            yield np.concatenate(held) if len(held) > 1 else held[0], large

    def run(batches):
        a, b = [], []
        for values, large in groups(batches):
            if large:
                a += values.view(np.int64).tolist()
                b += [None] * len(values)
            elif len(values) == 2:
                if int(values[0] ^ values[1]).bit_count() <= radius:
                    x, y = values.view(np.int64).tolist()
                    a.append(x)
                    b.append(y)
            else:
                pairs = np.array(forest(values, radius), np.uint64).reshape(-1, 2).view(np.int64)
                a += pairs[:, 0].tolist()
                b += pairs[:, 1].tolist()
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _midpoint_edges(members: DataFrame, radius: int) -> DataFrame:
    """(a, b) edges that link members within `radius` through the words halfway between them."""
    half = (radius + 1) // 2
    flips = [0] + [sum(1 << i for i in c) for k in range(1, half + 1) for c in combinations(range(64), k)]
    flips = [f - (1 << 64) if f >> 63 else f for f in flips]
    near = members.select(F.col("a"), F.explode(F.array(*[F.lit(f) for f in flips])).alias("f")).select("a", F.col("a").bitwiseXOR(F.col("f")).alias("w"))
    least = stored(near.groupBy("w").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").select("w", "b"), "midpoints", "lz4")
    return near.join(least, "w").filter("a != b").select("a", "b").distinct()


def links(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, whose components are those of all pairs within `radius`."""
    n = partitions(prints.sparkSession)
    tables = F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(radius))])
    rows = prints.select("fingerprint", F.explode(tables).alias("x")).select("x.t", "x.k", "fingerprint")
    prints.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    found = stored(map_arrow(rows.repartition(n, "t", "k").sortWithinPartitions("t", "k", "fingerprint"), _bucket_edges(radius, bucket_rows), "a long, b long"), "links", "lz4")
    edges = found.filter("b is not null").distinct()
    large = found.filter("b is null").select("a").distinct()
    if large.isEmpty():
        return edges
    return edges.unionByName(_midpoint_edges(stored(large, "large"), radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fingerprint long, component_id) of every row: the smallest id reachable over links.

    Rows with a null id are linked like others and never give the component's id, unless no
    member has one (then null). Repeated rows stay.
    """
    rows = stored(fingerprint_documents(docs, id_col, text_col), "simhash")
    prints = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("id")), "prints", "lz4")
    roots = components(links(prints, radius, bucket_rows))
    at = prints.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "id")
    # a hot root has one row for each of its fingerprints: its least id is summed up before the join back, which Spark can split
    least = stored(at.groupBy("root").agg(F.min("id").alias("component_id")), "least", "lz4")
    known = stored(at.join(least, "root").select("fingerprint", "component_id"), "classes", "lz4")
    return rows.join(known, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def classes(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fingerprint, root): the least fingerprint that each of the distinct fingerprints can reach within `radius` bits a step."""
    roots = components(links(prints, radius, bucket_rows))
    return stored(prints.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root")), "classes", "lz4")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """docs with exactly one row of each component: that of its smallest id, null ids last.

    All columns pass. Of rows with one id, the one with the least text stays, and of those the first.
    `similarity` (0.8 at least) asks for all pairs of five-word shingle sets of that Jaccard
    similarity: fingerprints of such shingles, their masks, buckets and components give classes,
    whose members `resemblance` holds against each other's whole sets; as the radius holds few
    pairs at 0.8, it adds candidates beyond it by bands. Null, empty and wordless texts are one
    group; an empty table gives none.
    """
    if similarity is not None:
        return resemblance.keep_one(docs, id_col, text_col, similarity, fingerprint=lambda t: fingerprint(t, resemblance.SHINGLE), classes=lambda prints: classes(prints, radius))
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "numbered")
    rows = numbered.select("row", F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{text_col}").alias("text"))
    found = near_duplicates(rows.select("row", "text"), "row", "text", radius).select("row", "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text", "row"))
    kept = stored(found.join(rows, "row").groupBy("component_id").agg(first.alias("x")).select(F.col("x.row").alias("kept")), "kept", "lz4")
    # hashed at every size: the kept rows grow with the documents, and the texts needn't be sorted to meet them
    return numbered.join(kept.hint("shuffle_hash"), F.col("row") == F.col("kept"), "left_semi").select("doc.*")


def hex_print(col: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
