"""Content-addressed store of token ids (operator 3).

A gear hash rolling over a document's ids cuts its stream into chunks where the content
says so, so that equal passages give equal chunks. A unique chunk is stored once, under
its digest; a document is a recipe: the digests of its chunks in order, and their Merkle
root. Recipes lie in ascending id order with each document's start in the whole stream;
a manifest row for each segment of recipes holds the root over its documents.

Format (version 2), as Parquet:
- `chunks/kind=chunk/` (digest binary(16), n long, data binary): each unique chunk.
- `recipes/block=B/` (segment int, key, id, start, n_tokens, digests binary, root binary):
  blocks and the rows of their files in ascending id order, null ids first.
- `manifests/` (block, segment, first_id, last_id, docs, start, tokens, root).
Data: little-endian unsigned integers of the store's width, 2 or 4 bytes; digests: BLAKE2b
of 16 bytes over the ids as 4-byte integers. key: a number of the row, as ids may repeat.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, coalesced, cut_points, gear_hash, gear_values, map_arrow, partitions, remove_path, sort_buckets
from .tokenize import PART_BYTES, encoder

DIGEST = 16
#: Ids a chunk has at least, usually and at most, and the bits that a cut needs clear.
LEAST, USUAL, MOST, STRICT, LOOSE = 64, 512, 4096, 0xFFC00000, 0xFF000000
_GEAR = gear_values(3, 1 << 16)
#: Documents of a segment, whose roots are hashed in one row.
SEGMENT = 1 << 16
#: Digests that a task remembers to leave out chunks it has sent; beyond them repeats are sent, and dropped where they meet.
REMEMBERED = 1_000_000


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests: pairs are hashed level by level, an odd last one moves up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        up = [digest(b"\x01" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = [*up, level[-1]] if len(level) % 2 else up
    return level[0]


def chunk_ends(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, counted from the start of the batch's ids."""
    return cut_points(gear_hash(_GEAR[ids & 0xFFFF]), ends.tolist(), LEAST, USUAL, MOST, STRICT, LOOSE)


def _rows(docs: DataFrame, path: str, kind: str, end_id: int | None, width: int, id_col: str, text_col: str) -> DataFrame:
    """One recipe row a document, and a row for each chunk new to its task."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        seen: set = set()
        key = TaskContext.get().partitionId() << 33
        for b in coalesced(batches, PART_BYTES):
            ids, ends = encoder(path, kind).encode(b.column(1), end_id)
            if width == 2 and len(ids) and ids.max() >= 1 << 16:
                raise ValueError("ids don't fit in two bytes")
            full = ids.tobytes()
            data, w = (full, 4) if width == 4 else (ids.astype("<u2").tobytes(), 2)
            digests, roots = [], []
            chunk_d, chunk_n, chunk_b = [], [], []
            s = 0
            for cuts in chunk_ends(ids, ends):
                own = []
                for e in cuts:
                    d = digest(full[4 * s : 4 * e])
                    own.append(d)
                    if d not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(d)
                        chunk_d.append(d)
                        chunk_n.append(e - s)
                        chunk_b.append(data[w * s : w * e])
                    s = e
                digests.append(b"".join(own))
                roots.append(merkle(own))
            n, m = len(digests), len(chunk_d)
            kinds = ["recipe"] * n + ["chunk"] * m
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kinds, pa.string()),
                    pa.concat_arrays([pa.array(range(key, key + n), pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([b.column(0), pa.nulls(m, b.column(0).type)]),
                    pa.array(np.diff(ends, prepend=0).tolist() + chunk_n, pa.int64()),
                    pa.array(digests + chunk_d, pa.binary()),
                    pa.array(roots + chunk_b, pa.binary()),
                ],
                ["kind", "key", "id", "n", "digest", "data"],
            )
            key += n

    return map_arrow(docs.select(id_col, text_col), run, f"kind string, key long, id {id_type}, n long, digest binary, data binary")


def _blocks(recipes: DataFrame, n: int) -> DataFrame:
    """recipes with a block number that ascends with the id, for n tasks; a hot id has blocks of its own, dealt by key."""
    found = sort_buckets(recipes, "id", n, distinct=False)
    hot = {c: found.count(c) for c in found if found.count(c) > 1}
    cuts = sorted({*found, *[c + 1 for c in hot]})
    block = bucket_of("id", cuts)
    shift = F.lit(0)  # blocks that hot ids before this one have more than one
    for c, k in hot.items():
        shift += F.when(F.col("id") > c, k - 1).when(F.col("id") == c, F.pmod(F.xxhash64("key"), F.lit(k))).otherwise(0)
    return recipes.withColumn("block", (block + F.when(F.col("id").isNull(), 0).otherwise(shift)).cast("int"))


def write_store(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int | None = None, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text (null: empty) and writes the store at `path`; ids of documents are integers.

    Texts are encoded once. Chunks are dealt by digest, after each task has dropped its own
    repeats, so a chunk that is in every document is one row of each task; recipes are dealt
    by key. Rows with a null id come first, repeated rows are documents, an empty text
    without end id is a recipe without chunks. Ids that don't fit the width raise ValueError.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = _rows(docs, tokenizer, kind, end_id, width, id_col, text_col)
    # a chunk's rows meet under its digest, a recipe's under its key; the window's order serves the folders too
    dealt = rows.withColumn("name", F.when(F.col("kind") == "chunk", F.col("digest")).otherwise(F.encode(F.col("key").cast("string"), "UTF-8"))).repartition(n, "name")
    first_of = F.row_number().over(Window.partitionBy("kind", "name").orderBy("name"))
    dealt.withColumn("nth", first_of).filter("nth = 1").drop("nth", "name").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/chunks")

    # drafts: recipes without their place
    drafts = spark.read.schema(rows.drop("kind").schema).option("recursiveFileLookup", "true").parquet(_made(spark, f"{path}/chunks/kind=recipe"))
    drafts = _blocks(drafts, n)
    first = Window.partitionBy("block").orderBy("id", "digest", "key")
    # a row for each block on the driver: as many as the tasks of a stage
    sizes = sorted((r["block"], r["n"]) for r in drafts.groupBy("block").agg(F.sum("n").alias("n")).collect())
    base, total = [], 0
    for block, size in sizes:
        base.append((block, total))
        total += size
    starts = F.create_map(*[F.lit(x) for pair in base for x in pair]) if base else F.create_map(F.lit(0), F.lit(0))
    recipes = drafts.select(
        "block", F.floor((F.row_number().over(first) - 1) / SEGMENT).cast("int").alias("segment"), "key", "id",
        (starts[F.col("block")].cast("long") + F.sum("n").over(first) - F.col("n")).alias("start"),
        F.col("n").alias("n_tokens"), F.col("digest").alias("digests"), F.col("data").alias("root"),
    )
    recipes.sortWithinPartitions("block", "id", "start").write.partitionBy("block").option("compression", "zstd").parquet(f"{path}/recipes")
    _manifests(_recipes(spark, path, dict(rows.dtypes)["id"])).write.parquet(f"{path}/manifests")
    remove_path(spark, f"{path}/chunks/kind=recipe")


def _made(spark: SparkSession, path: str) -> str:
    """The folder, also if no row was written to it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return path


def _manifests(found: DataFrame) -> DataFrame:
    """One row a segment of recipes, with the Merkle root over its documents' roots in order."""
    rows = found.groupBy("block", "segment").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("docs"), F.min("start").alias("start"),
        F.sum("n_tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("start", "key", "root"))).alias("roots"),
    )

    def root(batches):
        for b in batches:
            made = [merkle([x["root"] for x in r]) for r in b.column(7).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(made, pa.binary())], [*b.schema.names[:7], "root"])

    id_type = dict(found.dtypes)["id"]
    return map_arrow(rows, root, f"block int, segment int, first_id {id_type}, last_id {id_type}, docs long, start long, tokens long, root binary")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, ids) of every unique chunk."""
    # an empty store has no files to take a schema from
    found = spark.read.schema("n long, digest binary, data binary").parquet(_made(spark, f"{path}/chunks/kind=chunk"))
    return found.select("digest", F.col("n").cast("int").alias("n"), F.col("data").alias("ids"))


def _recipes(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    schema = f"segment int, key long, id {id_type}, start long, n_tokens long, digests binary, root binary, block int"
    return spark.read.schema(schema).parquet(_made(spark, f"{path}/recipes"))


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """(block, segment, key, id, start, n_tokens, digests, root) of every document, after the manifests are verified.

    Every manifest is computed anew from the recipes; one that differs, is missing or has no
    recipes raises ValueError.
    """
    kept = spark.read.parquet(f"{path}/manifests")
    found = _recipes(spark, path, dict(kept.dtypes)["first_id"])
    made = _manifests(found)
    both = made.select("block", "segment", F.struct(*made.columns).alias("a")).join(kept.select("block", "segment", F.struct(*made.columns).alias("b")), ["block", "segment"], "full")
    wrong = both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("block", "segment").head(1)
    if wrong:
        raise ValueError(f"recipes of block {wrong[0]['block']}, segment {wrong[0]['segment']} don't match their manifest")
    return found


def _checked(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(digest, n, crc) of each stored chunk, after its bytes are held against its digest."""

    def run(batches):
        for b in batches:
            ns, crcs = [], []
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                full = raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                if digest(full) != d:
                    raise ValueError(f"chunk {d.hex()} doesn't match its digest")
                ns.append(len(full) // 4)
                crcs.append(zlib.crc32(full))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int32()), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    return map_arrow(chunks(spark, path).select("digest", "ids"), run, "digest binary, n int, crc long")


_shifts: dict[int, np.ndarray] = {}


def _times(mat: list[int], vec: int) -> int:
    out = i = 0
    while vec:
        if vec & 1:
            out ^= mat[i]
        vec >>= 1
        i += 1
    return out


def _shift_tables(n: int) -> np.ndarray:
    """Four byte tables of the linear map that appends n zero bytes to a CRC-32."""
    if n not in _shifts:
        mat = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
        for _ in range(3):
            mat = [_times(mat, m) for m in mat]
        out, k = [1 << i for i in range(32)], n
        while k:
            if k & 1:
                out = [_times(mat, m) for m in out]
            mat = [_times(mat, m) for m in mat]
            k >>= 1
        _shifts[n] = np.array([[_times(out, b << (8 * j)) for b in range(256)] for j in range(4)], np.uint32)
    return _shifts[n]


def crc_joins(crcs: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """CRC-32 of each concatenation, from the CRCs and bytes of its parts; counts: parts of each concatenation, one after the other.

    Each part's CRC is moved past the bytes behind it, all parts at once, a power of two of bytes after another.
    """
    crcs, sizes = crcs.astype(np.uint32), sizes.astype(np.int64)
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(sizes)])
    behind = np.repeat(total[ends], counts) - total[1:]
    bit = 1
    while len(behind) and bit <= behind.max():
        at = np.flatnonzero(behind & bit)
        t, c = _shift_tables(bit), crcs[at]
        crcs[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        bit <<= 1
    out = np.zeros(len(counts), np.uint32)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(crcs, (ends - counts)[some])
    return out


def _places(found: DataFrame) -> DataFrame:
    """(key, seq, digest, doc) of each place of a chunk; doc is the recipe, on its first place. A recipe without chunks has one place."""
    digests = F.expr(f"transform(sequence(0, greatest(length(digests), {DIGEST}) div {DIGEST} - 1), i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")
    rows = found.select("key", F.struct("id", "start", "n_tokens", "root").alias("doc"), F.posexplode(digests).alias("seq", "digest"))
    return rows.select("key", "seq", "digest", F.when(F.col("seq") == 0, F.col("doc")).alias("doc"))


def read_store(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back and verified.

    Manifests are verified against the recipes at once. Every stored chunk is read and held
    against its digest; only (digest, n, crc) meets the recipes, so no ids are shuffled. A
    document's CRC is joined from its chunks', its Merkle root is computed anew; a missing
    chunk, a wrong root or length raises ValueError.
    """
    found = recipes(spark, path)
    kind = dict(found.dtypes)["id"]
    # both sides of the join are plain shuffles, so that Spark splits a hot digest's rows
    parts = _places(found).join(_checked(spark, path, width), "digest", "left").groupBy("key").agg(
        F.max("doc").alias("doc"), F.array_sort(F.collect_list(F.struct("seq", "digest", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc")))).alias("parts"))
    rows = parts.select("doc.id", "doc.start", "doc.n_tokens", "doc.root", "parts.digest", "parts.n", "parts.crc")

    def run(batches):
        for b in batches:
            counts = pc.list_value_length(b.column(4)).to_numpy().astype(np.int64)
            digests = b.column(4).flatten().to_numpy(zero_copy_only=False).tolist()
            sizes, crcs = b.column(5).flatten().to_numpy(), b.column(6).flatten().to_numpy()
            hollow = np.array([d == b"" for d in digests], bool)  # the place of a recipe without chunks
            sizes, crcs = np.where(hollow, 0, sizes), np.where(hollow, 0, crcs)
            ends = np.cumsum(counts)
            whole = np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends], prepend=0)
            wrong = (sizes < 0).any() or (whole != b.column(2).to_numpy()).any()
            for root, s, e in zip(b.column(3).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                wrong = wrong or merkle([] if digests[s] == b"" else digests[s:e]) != root
            if wrong:
                raise ValueError("a document can't be rebuilt from the store")
            joined = crc_joins(crcs, 4 * sizes, counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(joined)], ["id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(rows, run, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """(id, start, ids array<long>) of every document, put together from its chunks and held against its root."""
    found = recipes(spark, path)
    kind = dict(found.dtypes)["id"]
    rows = _places(found).join(chunks(spark, path).select("digest", "ids"), "digest", "left").groupBy("key").agg(
        F.max("doc").alias("doc"), F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))
    rows = rows.select("doc.id", "doc.start", "doc.root", "parts.ids")

    def run(batches):
        for b in batches:
            out = []
            for root, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ids = [np.frombuffer(p, "<u2" if width == 2 else "<u4") for p in parts if p is not None]
                if merkle([digest(p.astype("<u4").tobytes()) for p in ids]) != root:
                    raise ValueError("a document can't be rebuilt from the store")
                out.append([int(x) for p in ids for x in p])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["id", "start", "ids"])

    return map_arrow(rows, run, f"id {kind}, start long, ids array<long>")
