"""Benchmark decontamination with a generalised suffix automaton (operator 2).

The automaton holds every run of words of every item. A document's words are streamed
through it; at each word the length of the longest matching run is known, so that every
occurrence of a window (13 words of an item; a shorter item whole) is found where it ends.
Documents without any short run in common with an item can't hold a window and aren't
streamed: every window covers one of the regularly spaced places that are looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, map_arrow, stored, words_alnum

WINDOW = 13
#: Words of items in one automaton; more items are dealt over several automata.
BLOCK_WORDS = 400_000


@dataclass
class SuffixAutomaton:
    """Of several word sequences. items: the items with a window that ends in a state."""

    window: int = WINDOW
    step: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    items: dict[int, frozenset] = field(default_factory=dict)
    whole: dict[int, list] = field(default_factory=dict)
    runs: set = field(default_factory=set)
    least: int = 0
    probe: int = 1

    def _extend(self, last: int, w: bytes) -> int:
        step, link, size = self.step, self.link, self.size
        if w in step[last]:
            q = step[last][w]
            if size[q] == size[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = cur
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        new = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = new
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    @classmethod
    def build(cls, items: Iterable[tuple], window: int = WINDOW) -> SuffixAutomaton:
        """items: (id, words); those without words have no window."""
        self = cls(window)
        kept = [(i, w) for i, w in items if w]
        for _, words in kept:
            last = 0
            for w in words:
                last = self._extend(last, w)
        ending: dict[int, set] = {}
        for ident, words in kept:
            state = n = 0
            for w in words:
                state, n = self.step[state][w], n + 1
                if n >= window:
                    ending.setdefault(self._shortened(state, window), set()).add(ident)
            if n < window:
                self.whole.setdefault(n, []).append((self._shortened(state, n), ident))
        self.items = {s: frozenset(x) for s, x in ending.items()}
        by_size: dict = {}
        for n, pairs in self.whole.items():
            for s, ident in pairs:
                by_size.setdefault((s, n), set()).add(ident)
        self.whole = {n: {s: frozenset(x) for (s, m), x in by_size.items() if m == n} for n in self.whole}
        self.least = min((min(len(w), window) for _, w in kept), default=0)
        self.probe = max(1, self.least // 2)
        p = self.probe
        self.runs = {tuple(w[i : i + p]) for _, w in kept for i in range(len(w) - p + 1)}
        return self

    def _shortened(self, state: int, n: int) -> int:
        """The state of the last n words of a state's longest run."""
        while self.link[state] >= 0 and self.size[self.link[state]] >= n:
            state = self.link[state]
        return state

    def possible(self, words: list[bytes]) -> bool:
        """False only if no window can occur: each one covers a looked-up place whole."""
        p, n = self.probe, len(words)
        if not self.runs or n < self.least:
            return False
        gap, runs = self.least - p + 1, self.runs
        return any(x in runs for x in zip(*[words[k::gap] for k in range(p)], strict=False))

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [start, end) spans of hit words, and the items whose windows occur."""
        found, items, spans = set(), set(), []
        step, link, size, window = self.step, self.link, self.size, self.window
        state = n = 0
        for j, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                n = size[state]
            nxt = step[state].get(w)
            if nxt is None:
                state = n = 0
                continue
            state, n = nxt, n + 1
            hit = 0
            if n >= window:
                s = self._shortened(state, window)
                if s in self.items:
                    hit = n
                    found.add(s)
            for m, ends in self.whole.items():
                if n >= m and (who := ends.get(self._shortened(state, m))):
                    items |= who
                    hit = max(hit, m)
            if hit:
                lo = j + 1 - hit
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, j + 1))
        for s in found:
            items |= self.items[s]
        return spans, items - {None}


def _automata(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """An automaton of each group of items of bounded size; one group at a time is streamed to the driver and held there.

    Without items there is one empty automaton.
    """
    block, n, made = [], 0, False
    for row in items.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        words = words_alnum((row[1] or "").encode())
        if not words:
            continue
        if block and n + len(words) > block_words:
            yield SuffixAutomaton.build(block, window)
            block, n, made = [], 0, True
        block.append((None if row[0] is None else str(row[0]), words))
        n += len(words)
    if block or not made:
        yield SuffixAutomaton.build(block, window)


def _scan(docs: DataFrame, automaton, id_col: str, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(automaton)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        auto = sent.value
        for b in batches:
            rows = []
            for t in bytes_of(b.column(1)):
                words = words_alnum(t)
                spans, items = auto.spans(words) if auto.possible(words) else ([], set())
                rows.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(items)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.list_(pa.int32())) for c in cols[1:3]], pa.array(cols[3], pa.list_(pa.string()))],
                ["id", "n_words", "starts", "ends", "items"],
            )

    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, n_words long, starts array<int>, ends array<int>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, starts, ends, items): each row's merged hit spans in words, and item ids found.

    Null or empty texts have no words and no hits; items without words have no window. Words
    that stand in an item with a null id are hit, but such an item isn't among the items; repeated rows stay rows. Up to `block_words` item words make one automaton of
    bounded size, which is broadcast, and the scan has no shuffle. More items make several
    automata, one scan each, whose spans are merged by row number and id.
    """
    autos = _automata(items, item_id, item_text, window, block_words)
    auto = next(autos)
    another = next(autos, None)
    if another is None:
        return _scan(docs, auto, id_col, text_col).withColumnRenamed("id", id_col)
    base = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(id_col).alias("key"), text_col), "decon")
    parts = None
    while auto is not None:
        part = stored(_scan(base, auto, "row", text_col), "spans")
        parts = part if parts is None else parts.unionByName(part)
        auto, another = another, next(autos, None)
    merged = parts.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # spans sorted by start; one that begins within the last one prolongs it
    start = F.expr("cast(array() as array<struct<starts:int,ends:int>>)")
    joined = F.aggregate(
        "spans", start,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= x["starts"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], x["ends"]).alias("ends")))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    merged = merged.select(F.col("id").alias("row"), "n_words", joined.alias("spans"), "items")
    return base.select("row", "key").join(merged, "row").select(
        F.col(f"key.{id_col}").alias(id_col), "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")


def hit_words():
    """Number of hit words from `starts` and `ends`."""
    total = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return total


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_share: float = 0.05, cut_spans: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without contaminated rows: those of which hit words are `max_share` or more.

    cut_spans: such rows stay, without the bytes from the first to the last word of each hit
    span. Rows below the share stay as they are, and so do null and empty texts and repeated
    rows; an empty table gives none. All columns pass through unchanged, whatever their names.
    """
    autos = _automata(items, "item_id", "text", window, block_words)
    auto = next(autos)
    if next(autos, None) is None:
        return _filter(docs, auto, text_col, max_share, cut_spans)
    rows = stored(docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "decon")
    found = contamination(rows, items, "row", "text", window=window, block_words=block_words)
    bad = found.filter((hit_words() > 0) & (hit_words() >= max_share * F.col("n_words")))
    if not cut_spans:
        return rows.join(bad.select("row"), "row", "left_anti").select("doc.*")
    return _cut(rows.join(bad.select("row", "starts", "ends"), "row", "left"), docs.schema, text_col)


def _cut(rows: DataFrame, schema, text_col: str) -> DataFrame:
    names = schema.fieldNames()

    def run(batches):
        at = names.index(text_col)
        for b in batches:
            cols = b.column(0).flatten()
            spans = [list(zip(s, e, strict=True)) if s else [] for s, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            text = [o if not s else _without((o or "").encode(), s).decode("utf-8", "replace") for o, s in zip(cols[at].to_pylist(), spans, strict=True)]
            cols[at] = pa.array(text, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(rows.select("doc", "starts", "ends"), run, schema)


def _filter(docs: DataFrame, automaton, text_col: str, max_share: float, cut_spans: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        auto = sent.value
        for b in batches:
            at = b.schema.get_field_index(text_col)
            keep, new = [], []
            for t in bytes_of(b.column(at)):
                words = words_alnum(t)
                spans = auto.spans(words)[0] if auto.possible(words) else []
                hit = sum(e - s for s, e in spans)
                bad = hit > 0 and hit >= max_share * len(words)
                keep.append(cut_spans or not bad)
                new.append(_without(t, spans) if bad and cut_spans else None)
            if cut_spans and any(x is not None for x in new):
                old = b.column(at).to_pylist()
                col = pa.array([o if x is None else x.decode("utf-8", "replace") for o, x in zip(old, new, strict=True)], b.column(at).type)
                b = pa.RecordBatch.from_arrays([col if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    import re

    at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, text[last:]])


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
