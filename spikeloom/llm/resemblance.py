"""Near-duplicates by word shingles: one row of each group of texts that resemble each other.

Texts resemble each other if the Jaccard similarity of their sets of five-word shingles is
`least` or more, 0.8 unless a higher one is asked for; groups are the components of all such pairs. Candidates are texts that agree in
one of 32 bands of four min-hashes: of a pair at 0.8, (1 - 0.8**4)**32 = 5e-8 is missed, of
a closer one less. Each candidate is held against the whole sets, so no other pair is linked.
Texts with equal sets are one entry of the tables. `simhash.keep_one` brings its classes of
near fingerprints as candidates of their own; the bands add the pairs that lie beyond its radius.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, gear_values, map_arrow, partitions, stored
from .graph import components

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Entries of a band's bucket that are compared as pairs; larger buckets are compared in blocks of so many entries and shingles.
PAIRED, BLOCK_ENTRIES, BLOCK_SHINGLES = 16, 2000, 1_000_000
_FACTORS = gear_values(5, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of fewer words, one of all of them."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate([len(w) + 1 for w in words]))
    return np.unique(np.array([digest(line[a : b - 1], 7) for a, b in zip([0, *ends], ends[min(k, len(words)) - 1 :], strict=False)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A key (as signed) for each band of min-hashes; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, i : i + 2048]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        key = (key ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64).tolist()


#: The least similarity that the bands are made for.
LEAST = 0.8


def alike(common, a, b, least: float = LEAST):
    """Whether so many common shingles of sets of sizes a and b are a similarity of `least` or more."""
    return (1 + least) * common >= least * (a + b) - 1e-9


def forest(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges (places) of a spanning forest of the sets that resemble each other."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark, left, out = np.zeros(flat.max() + 1, np.int64), np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if not left[i]:
            continue
        front, left[i] = [i], False
        while front and left.any():
            x = front.pop()
            own = flat[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            near = np.flatnonzero(left & alike(np.add.reduceat(mark[flat], starts), sizes[x], sizes, least))
            mark[own] = 0
            left[near] = False
            out += [(x, int(y)) for y in near]
            front += near.tolist()
    return out


def _candidates(paired: int, least: float):
    """Of rows (t, k, entry, n) sorted by (t, k): pairs (a, b), and blocks (block, a) of larger buckets."""

    def of(key, members):
        if len(members) <= paired:
            for (a, n), (b, m) in combinations(members, 2):
                if min(n, m) >= least * max(n, m) - 1e-9:
                    yield (min(a, b), max(a, b), None)
            return
        blocks, size = [[]], 0
        for a, n in members:
            if blocks[-1] and (len(blocks[-1]) >= BLOCK_ENTRIES or size + n > BLOCK_SHINGLES):
                blocks.append([])
                size = 0
            blocks[-1].append(a)
            size += n
        for i, j in combinations(range(len(blocks)), 2) if len(blocks) > 1 else [(0, 0)]:
            name = f"{key[0]}/{key[1]}/{i}/{j}"
            yield from ((a, None, name) for x in sorted({i, j}) for a in blocks[x])

    def run(batches):
        key, members, out = None, [], []

        def flush():
            cols = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["a", "b", "block"])

        for batch in batches:
            for t, k, a, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (t, k) != key:
                    if len(members) > 1:
                        out += of(key, members)
                    key, members = (t, k), []
                members.append((a, n))
            if len(out) > 10_000:
                yield flush()
                out = []
        if len(members) > 1:
            out += of(key, members)
        yield flush()

    return run


def _pairs(least: float):
    """Of rows (a, b, set of a, set of b): those that resemble each other."""

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in batch.column(i).to_pylist()] for i in (2, 3))
            keep = [bool(alike(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), least)) for s, t in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(least: float):
    """Of rows (block, a, set) sorted by block: edges of each block's forest."""

    def edges(ids, sets):
        found = forest(sets, least) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])

    def run(batches):
        key, ids, sets = None, [], []
        for batch in batches:
            for block, a, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block != key:
                    yield edges(ids, sets)
                    key, ids, sets = block, [], []
                ids.append(a)
                sets.append(np.frombuffer(s, np.uint64))
        yield edges(ids, sets)

    return run


def _sketches(fingerprint: Callable[[bytes], int] | None):
    def run(batches):
        for b in batches:
            texts = bytes_of(b.column(1))
            sets = [shingles(t) for t in texts]
            prints = np.array([fingerprint(t) if fingerprint else 0 for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(prints, pa.int64())],
                ["row", "digest", "n", "bands", "fingerprint"])

    return run


def _sets(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in bytes_of(b.column(1))], pa.binary())], ["entry", "shingles"])


def links(texts: DataFrame, entries: DataFrame, paired: int = PAIRED, least: float = LEAST, classes: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between entries whose components are those of all pairs that resemble each other.

    texts: (row, text); entries: (entry, n, bands, fingerprint), one for each distinct set, named by
    a row; classes: (fingerprint, root) of near fingerprints, whose entries are candidates like those of a band.
    """
    n = partitions(texts.sparkSession)
    rows = entries.select("entry", "n", F.posexplode("bands").alias("t", "k")).select("t", "k", "entry", "n")
    if classes is not None:
        rows = rows.unionByName(entries.filter("n > 0").join(classes, "fingerprint").select(F.lit(BANDS).alias("t"), F.col("root").alias("k"), "entry", "n"))
    found = stored(map_arrow(rows.repartition(n, "t", "k").sortWithinPartitions("t", "k", "entry"), _candidates(paired, least), "a long, b long, block string"), "candidates", "lz4")
    pairs, blocks = found.filter("block is null").select("a", "b").distinct(), found.filter("block is not null").select("block", "a")
    named = found.select(F.explode(F.array("a", "b")).alias("entry")).filter("entry is not null").distinct()
    chosen = texts.join(named.hint("shuffle_hash"), F.col("row") == F.col("entry"), "left_semi").select("row", "text")
    sets = stored(map_arrow(chosen, _sets, "entry long, shingles binary"), "sets", "lz4")
    of = lambda c: sets.select(F.col("entry").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_set", "b_set")
    met = blocks.join(of("a"), "a").select("block", "a", "a_set")
    edges = map_arrow(both, _pairs(least), "a long, b long").unionByName(map_arrow(met.repartition(n, "block").sortWithinPartitions("block"), _blocks(least), "a long, b long"))
    return stored(edges, "links", "lz4")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, paired: int = PAIRED, fingerprint: Callable[[bytes], int] | None = None, classes: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with exactly one row of each group: that of the smallest id, null ids last.

    fingerprint: an unsigned 64-bit number of a text; classes: (fingerprint, root) of a table of
    distinct fingerprints (as signed), whose classes are candidates; without both, the bands' only.

    All columns pass. Of rows with one id, the one with the least digest of its shingles
    stays, and of those the first. Texts without words, also null ones, are one group.
    """
    if not LEAST <= least <= 1:
        raise ValueError(f"the bands find similarities from {LEAST} on")
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "numbered")
    texts = numbered.select("row", F.col(f"doc.{text_col}").alias("text"), F.col(f"doc.{id_col}").alias("id"))
    seen = stored(map_arrow(texts.select("row", "text"), _sketches(fingerprint), "row long, digest binary, n int, bands array<long>, fingerprint long"), "sketches", "lz4")
    entries = stored(seen.groupBy("digest").agg(F.min_by(F.struct("row", "n", "bands", "fingerprint"), "row").alias("x")).select("digest", F.col("x.row").alias("entry"), "x.n", "x.bands", "x.fingerprint"), "entries", "lz4")
    near = classes(stored(entries.select("fingerprint").distinct(), "prints", "lz4")) if fingerprint and classes else None
    roots = components(links(texts, entries, paired, least, near))
    at = entries.select("digest", "entry").join(roots, F.col("entry") == F.col("node"), "left").select("digest", F.coalesce("root", "entry").alias("root"))
    # summed up by digest first, so that copies don't meet in one task
    best = seen.select("row", "digest").join(numbered.select("row", F.col(f"doc.{id_col}").alias("id")), "row").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "row")).alias("x"))
    kept = stored(best.join(at, "digest").groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.row").alias("kept")), "kept", "lz4")
    # hashed at every size, so that the texts needn't be sorted to meet the rows
    return numbered.join(kept.hint("shuffle_hash"), F.col("row") == F.col("kept"), "left_semi").select("doc.*")
