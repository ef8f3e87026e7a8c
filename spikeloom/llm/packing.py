"""Harmonic packing of token streams into fixed-length sequences (operator 6).

Lengths in (C/(k+1), C/k] form class k, whose bins hold exactly k pieces of at most C//k
tokens. A document is cut into whole sequences of C and a rest; a rest that would leave
much of its slot empty gives up a piece that fills a slot of the next class, and goes on.
A class's bins are filled independently: each task numbers its own pieces of a class, and
the counts of (task, class), not the pieces, are summed to place them. What is left of each
class, fewer than k pieces, is packed first-fit decreasing: a number of pieces that depends
on C alone.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import coalesced, map_arrow, stored
from .tokenize import PART_BYTES, encoder

CAPACITY = 2048


def cut_rest(rest: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a rest below the capacity."""
    out = []
    while rest > 0:
        k = capacity // rest
        slot = capacity // k
        if slot - rest <= max(slot // 32, 3):
            return [*out, (rest, k)]
        part = capacity // (k + 1)
        out.append((part, k + 1))
        rest -= part
    return out


def pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored pieces (id, start, length, doc_tokens, class, task, nth, ids) of every whole text; null is empty.

    ids: little-endian unsigned 32-bit. nth counts a task's pieces of a class; the table is
    written, so that its numbers hold for every later read, whatever is lost meanwhile.
    """
    kind_of_id = dict(docs.dtypes)[id_col]
    fields = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int32()), ("task", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())]

    def run(batches):
        task, counts = TaskContext.get().partitionId(), {}
        rests: dict[int, list] = {}
        for b in coalesced(batches, PART_BYTES):
            ids, ends = encoder(tokenizer, kind).encode(b.column(1), end_id)
            raw, begin = ids.tobytes(), 0
            rows, take = [], []
            for i, end in enumerate(ends.tolist()):
                total, at = end - begin, 0
                rest = total % capacity
                cut = rests.get(rest)
                if cut is None:
                    cut = rests[rest] = cut_rest(rest, capacity)
                for n, k in [(capacity, 1)] * (total // capacity) + cut:
                    nth = counts.get(k, 0)
                    counts[k] = nth + 1
                    rows.append((at, n, total, k, task, nth, raw[4 * (begin + at) : 4 * (begin + at + n)]))
                    take.append(i)
                    at += n
                begin = end
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)]], ["id", *[n for n, _ in fields]])

    return stored(map_arrow(docs.select(id_col, text_col), run, f"id {kind_of_id}, start long, length long, doc_tokens long, class int, task long, nth long, ids binary"), "pieces")


def first_fit_decreasing(batches, capacity: int, first: int, names: list[str]):
    rows = [r for b in batches for r in b.to_pylist()]
    room: list[int] = []
    for r in sorted(rows, key=lambda r: (-r["length"], r["class"], r["place"])):
        i = next((i for i, x in enumerate(room) if x >= r["length"]), len(room))
        if i == len(room):
            room.append(capacity)
        r["offset"], r["sequence_id"] = capacity - room[i], first + i
        room[i] -= r["length"]
    if rows:
        yield rows


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (rows of `pieces`, other columns pass) with sequence_id and offset.

    Shuffles the rows given, so leave out `ids`. No text, empty table or repeated row is
    special: an empty table has no sequences.
    """
    sizes = found.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("task")
    base = sizes.select("class", "task", (F.sum("n").over(before) - F.col("n")).alias("base"))
    totals = sorted((r["class"], r["n"]) for r in sizes.groupBy("class").agg(F.sum("n").alias("n")).collect())  # at most a row for each class
    first, seq = {}, 0
    for k, n in totals:
        first[k] = (seq, n // k)
        seq += n // k
    if not first:
        return found.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).drop("class", "task", "nth")
    of = F.create_map(*[F.lit(x) for k, (a, _) in first.items() for x in (k, a)])
    full = F.create_map(*[F.lit(x) for k, (_, a) in first.items() for x in (k, a)])
    rows = found.join(base, ["class", "task"]).withColumn("place", F.col("base") + F.col("nth")).withColumn("bin", F.floor(F.col("place") / F.col("class")))
    whole = F.col("bin") < full[F.col("class")]
    in_bin = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    names = [c for c in found.columns if c not in ("class", "task", "nth")]
    packed = rows.filter(whole).withColumn("sequence_id", (of[F.col("class")] + F.col("bin")).cast("long")).select(*names, "sequence_id", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).cast("long").alias("offset"))
    left = rows.filter(~whole).select(*names, "class", "place")
    out = packed.schema
    last = seq

    def run(batches):
        for found_rows in first_fit_decreasing(batches, capacity, last, names):
            for i in range(0, len(found_rows), 1000):
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in [*names, "sequence_id", "offset"]} for r in found_rows[i : i + 1000]], schema=_arrow(out))

    return packed.unionByName(map_arrow(left.repartition(1), run, out))


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pack(docs: DataFrame, tokenizer: str, kind: str, end_id: int | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(placed pieces with ids_crc32, the stored pieces with their ids).

    The pieces' CRCs are taken from the stored ids by a native scan; only they are shuffled.
    A sequence shorter than the capacity is padded to it unless its length is a power of two.
    """
    table = pieces(docs, tokenizer, kind, end_id, capacity, id_col, text_col)
    return place(table.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity), table
