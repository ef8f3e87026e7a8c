"""What the text operators share: shared storage, Arrow plumbing and word splitting.

Rules that hold for every operator here: a null text is an empty text unless the
docstring says otherwise; only the named columns are read, so extra columns, also
ones whose names equal an output's, change nothing; repeated rows are separate rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python, so that a batch of very long texts still fits.
BATCH_ROWS = "512"

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """This session's own folder under spark.checkpoint.dir.

    Where that is unset: a local folder if driver and executors are one process, else ValueError.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="spikeloom-")
        _roots[app] = f"{base.rstrip('/')}/spikeloom-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # the JVM may be gone at exit; the folder then stays
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to shared storage and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(fn, schema)


def coalesced(batches: Iterable[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of `size` bytes or more put together of smaller ones (the last one may be smaller)."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.concat_batches(held) if len(held) > 1 else b
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives b''."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def _table(keep: Callable[[int], bool]) -> bytes:
    return bytes((b + 32 if 65 <= b <= 90 else b) if keep(b) else 32 for b in range(256))


#: Byte map: A-Z to a-z and everything outside a word to a space.
WORDS_ALNUM = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def words_alnum(text: bytes) -> list[bytes]:
    """Words [0-9a-z and all beyond ASCII]+ after lower-casing A-Z."""
    return text.translate(WORDS_ALNUM).split()


def sort_buckets(df: DataFrame, col: str, n: int, distinct: bool = True) -> list:
    """At most n-1 ascending cut values of an integer column, from its approximate quantiles.

    They only balance work, so that an approximation is enough; results never depend on them.
    Without `distinct`, a value that holds several parts of the rows comes as often.
    """
    if n <= 1:
        return []
    qs = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(F.col(col), qs, 10_000).alias("q")).first()["q"]
    return sorted(set(found or []) if distinct else found or [])


def bucket_of(col: str, cuts: list):
    """Number of cuts that are <= the value; nulls are in bucket 0 (they sort first)."""
    c = F.col(col)
    if not cuts:
        return F.lit(0)
    arr = F.array(*[F.lit(int(x)) for x in cuts])
    return F.coalesce(F.size(F.filter(arr, lambda x: x <= c)), F.lit(0)) if len(cuts) < 2 else _search(c, cuts)


def _search(c, cuts: list):
    """A balanced CASE tree: log2(cuts) comparisons a row, all in generated code."""
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c >= F.lit(int(cuts[mid])), tree(mid + 1, hi)).otherwise(tree(lo, mid))
    return F.when(c.isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def gear_values(seed: int, n: int, dtype=np.uint32) -> np.ndarray:
    """n fixed pseudo-random words from the splitmix64 sequence."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(dtype)


def gear_hash(values: np.ndarray) -> np.ndarray:
    """Gear hash (h<<1)+v of each position over its last 32 values, by doubling, in five vector steps."""
    h = values.astype(np.uint32, copy=True)
    step = 1
    while step < 32:
        # h2[i] = h[i] + (h[i-step] << step)
        shifted = h[:-step] << np.uint32(step) if len(h) > step else h[:0]
        h = h.copy()
        h[step:] += shifted
        step *= 2
    return h


def cut_points(h: np.ndarray, ends: Iterable[int], least: int, usual: int, most: int, strict: int, loose: int) -> list[list[int]]:
    """Chunk ends within each document of a batch, by normalised chunking.

    h: gear hashes of the batch; ends: where its documents end. A chunk ends at the first
    position after `least` whose hash has no bit of `strict`, after `usual` at the first
    without a bit of `loose`, and at `most` at the latest.
    """
    hard = np.flatnonzero((h & np.uint32(strict)) == 0) + 1
    soft = np.flatnonzero((h & np.uint32(loose)) == 0) + 1
    out, start = [], 0
    for end in ends:
        cuts, s = [], start
        while end - s > least:
            lo, mid, hi = s + least, min(s + usual, end), min(s + most, end)
            i = int(np.searchsorted(hard, lo))
            if i < len(hard) and hard[i] < mid:
                s = int(hard[i])
            else:
                i = int(np.searchsorted(soft, max(mid, lo)))
                s = int(soft[i]) if i < len(soft) and soft[i] < hi else hi
            cuts.append(s)
        if not cuts or cuts[-1] != end:
            if end > start:
                cuts.append(end)
        out.append(cuts)
        start = end
    return out
