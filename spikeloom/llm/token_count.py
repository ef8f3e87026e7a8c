"""Count-only Viterbi token counts under a unigram vocabulary (operator 1).

An Aho-Corasick automaton enumerates every vocabulary match of a segment; dynamic
programming over its characters carries the best score and the number of pieces of the
best path, and no path. Ties follow the `tokenizers` unigram model: of equal scores the
path whose last piece starts first wins, an unknown character costs the least score minus
10, and is then spelled in its UTF-8 bytes if the vocabulary has byte pieces (else a run
of unknown characters is one piece).

A text is the model's whole input: spaces become space marks, with one before the text if
it has none. It is cut only where no piece can cross, before the first mark of a run (and
before a line end, if that can be no part of a piece); a vocabulary with pieces that cross
such places is run over the whole text. With `split`, text is cut at every space first, as
the Metaspace splitter of `tokenizers` does by default, so that pieces of several marks
never match. A segment's count doesn't depend on its neighbours; the counts of short
segments are kept in a bounded cache.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import coalesced, map_arrow
from .tokenize import WordCache

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters of a segment that the automaton is run over at a time.
STRIDE = 1 << 16
#: Segments of each of the two cache generations of a Python worker.
CACHE_SEGMENTS = 250_000
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in id order with their scores, and the unknown piece's id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    unk_id: int = 0

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        import sentencepiece as sp

        m = sp.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        return cls(tuple(m.id_to_piece(i) for i in ids), tuple(float(m.get_score(i)) for i in ids), m.unk_id())


class UnigramCounter:
    """count(texts) -> (pieces, scores) of the best paths of whole texts."""

    def __init__(self, vocab: Vocabulary, split: bool = False):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocab.pieces, vocab.scores, strict=True):
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(map(len, vocab.pieces))
        self.unk = min(vocab.scores) - UNKNOWN_PENALTY
        have = set(vocab.pieces)
        self.bytes = all(f"<0x{b:02X}>" in have for b in range(256))
        self.split = split
        #: Whether no piece has a mark after another character; whether a line end is in no piece and joins no unknown run.
        self.cuttable = split or not any(SPACE in p.lstrip(SPACE) for p in vocab.pieces)
        self.lines = self.bytes and not any("\n" in p for p in vocab.pieces)
        self.cache = WordCache(CACHE_SEGMENTS)

    def path(self, segment: str) -> tuple[int, float]:
        """Pieces and score of the best path of one segment."""
        best, count, unknown = [0.0], [0], [False]
        for a in range(0, len(segment), STRIDE):
            lo = max(0, a - self.longest)
            best, count, unknown = best[lo - a - 1 :], count[lo - a - 1 :], unknown[lo - a - 1 :]
            self._advance(segment[lo : a + STRIDE], a - lo, best, count, unknown)
        return count[-1], best[-1]

    def _advance(self, text: str, at: int, best: list, count: list, unknown: list) -> None:
        """Goes on from position `at` to the text's end; the lists hold the best path to each position of the text.

        unknown: whether that path ends with an unknown character.
        """
        n, unk = len(text), self.unk
        more = n - at
        best += [float("-inf")] * more
        count += [0] * more
        unknown += [False] * more

        def close(i: int) -> None:
            value = best[i] + unk
            if value > best[i + 1]:
                size = len(text[i].encode("utf-8", "surrogatepass")) if self.bytes else not unknown[i]
                best[i + 1], count[i + 1], unknown[i + 1] = value, count[i] + size, True

        single, skip = False, at
        for end, (size, score) in self.automaton.iter(text):  # of one end the longest first, so the earliest start first
            if end < skip:
                continue
            while at < end:
                if not single:
                    close(at)
                single = False
                at += 1
            s = end + 1 - size
            value = best[s] + score
            if value > best[end + 1]:
                best[end + 1], count[end + 1] = value, count[s] + 1
            if size == 1:
                single = True
        while at < n:
            if not single:
                close(at)
            single = False
            at += 1

    def _segments(self, text: str) -> list[str]:
        """A text's segments, with their marks."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        text = text if text.startswith(SPACE) else SPACE + text
        if self.split:
            return [SPACE + w for w in text[1:].split(SPACE)]
        return _RUNS.findall(text) if self.cuttable else [text]

    def _values(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.cache.values(segments, lambda new: [self.path(segments[i]) for i in new])
        return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.float64)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts if pa.types.is_string(texts.type) else texts.cast(pa.string()), "")
        n, s = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.float64)
        # most texts have single spaces only: they are cut by Arrow, and each distinct word is looked up once
        plain = np.zeros(len(texts), bool)
        if self.cuttable:
            runs = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE))
            plain = ~pc.or_(runs, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        if plain.any():
            own = texts.filter(pa.array(plain))
            own = pc.if_else(pc.starts_with(own, " "), pc.utf8_slice_codeunits(own, 1), own)
            cuts = pc.split_pattern(pc.replace_substring(own, "\n", " \n") if self.lines else own, " ")
            coded = cuts.flatten().dictionary_encode()
            words = coded.dictionary
            opened = pc.binary_join_element_wise(SPACE, words, "")
            words = pc.if_else(pc.starts_with(words, "\n"), words, opened) if self.lines else opened
            at, count, score = coded.indices.to_numpy(), *self._values(words.to_numpy(zero_copy_only=False).tolist())
            of = np.repeat(np.flatnonzero(plain), np.diff(cuts.offsets.to_numpy()))
            n += np.bincount(of, count[at], len(texts)).astype(np.int64)
            s += np.bincount(of, score[at], len(texts))
        for i in np.flatnonzero(~plain).tolist():
            segments = self._segments(texts[i].as_py())
            if segments:
                names = list(dict.fromkeys(segments))
                found = dict(zip(names, zip(*(x.tolist() for x in self._values(names)), strict=True), strict=True))
                n[i], s[i] = sum(found[w][0] for w in segments), sum(found[w][1] for w in segments)
        return n, s


_counters: dict[tuple[Vocabulary, bool], UnigramCounter] = {}


def count_tokens(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", split: bool = False) -> DataFrame:
    """(id, n_tokens long, score double) of each row's whole text; empty or null: 0 and 0.

    One scan without a shuffle. The vocabulary (tens of thousands of pieces, whatever the
    corpus) is a broadcast variable; a worker keeps at most a bounded number of segments.
    Null ids and repeated rows stay rows of their own, an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        v = sent.value
        if (v, split) not in _counters:
            _counters[v, split] = UnigramCounter(v, split)
        for b in coalesced(batches):
            n, s = _counters[v, split].count(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s)], [id_col, "n_tokens", "score"])

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, score double")
