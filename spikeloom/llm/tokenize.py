"""Exact token ids at word-cache speed, from a `tokenizers` file.

Both tokenizer kinds used here split a text into pre-tokens before merging, and a space or
a line end between two other characters always starts a new pre-token. So texts are cut
there, by Arrow, a part of bounded size at a time; the distinct cuts of a part are parted
into letters and closing ASCII marks, which are pre-tokens of their own; each distinct run
of letters goes once to the library's model, past normalizing and splitting, and its ids
are kept in a bounded cache. A part's ids are then gathered by word number in NumPy. Cuts
of another shape go through the whole library, and so do texts for which the cut isn't
known to be exact (runs of white space in a byte-level model, special-token strings).
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each of the two cache generations of a Python worker, for cuts, and for closing marks.
CACHE_WORDS = 600_000
CACHE_TAILS = 50_000
#: Longer cuts are encoded, but not kept.
CACHE_CHARS = 40
#: UTF-8 bytes of texts that are cut and gathered at a time.
PART_BYTES = 8 << 20
#: A longer text is taken in slices of about so many characters.
LONG_CHARS = 1 << 21

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A cut of letters that no normalizer here composes, and that lower-case to one letter each; perhaps after a line end.
LETTERS = "^\\n?[A-Za-zÀ-ÖØ-öø-įĲ-ɏ]+$"
#: White space at an edge of a cut, where runs across cuts could be split otherwise.
EDGE_SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]$|^\n[\s\p{Z}\x{85}\x1c-\x1f]"
#: A space that lies between two other characters.
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Byte-level models spell each byte as a printable character: itself, or the next one from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_NEXT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
BYTE_LETTERS = [chr(_NEXT.get(b, b)).encode() for b in range(256)]


class WordCache:
    """Two generations of a dict: when the young one is full it becomes the old one."""

    def __init__(self, size: int = CACHE_WORDS):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, words: set) -> list:
        """The words without an entry; entries found in the old generation move up."""
        young, old, out = self.room(len(words)), self.old, []
        for w in words.difference(young):  # less the dict itself: its keys would be walked
            if w in old:
                young[w] = old[w]
            else:
                out.append(w)
        return out

    def room(self, n: int) -> dict:
        """The young generation, with room for n more words (unless one part alone has more than it holds)."""
        if len(self.young) + n > self.size:
            self.old, self.young = self.young, {}
        return self.young

    def values(self, words: list[str], new) -> list:
        """The value of each distinct word; new(places) gives those of the unknown ones."""
        young, old = self.room(len(words)), self.old
        out = list(map(young.get, words))
        none = [i for i, v in enumerate(out) if v is None]
        if old and none:
            again = list(map(old.get, [words[i] for i in none]))
            for i, v in zip(none, again, strict=True):
                if v is not None:
                    out[i] = young[words[i]] = v
            none = [i for i, v in zip(none, again, strict=True) if v is None]
        if none:
            lost, found = [words[i] for i in none], new(none)
            for i, v in zip(none, found, strict=True):
                out[i] = v
            if max(map(len, lost)) <= CACHE_CHARS:
                young.update(zip(lost, found, strict=True))
            else:
                young.update([(w, v) for w, v in zip(lost, found, strict=True) if len(w) <= CACHE_CHARS])
        return out


class Runs:
    """Runs of ids, one after the other, that can be gathered by number."""

    def __init__(self, flat: np.ndarray, lens: np.ndarray):
        self.flat, self.lens = flat, lens
        self.starts = np.cumsum(lens) - lens

    @classmethod
    def of(cls, parts: list[bytes]) -> Runs:
        return cls(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4)

    def take(self, at: np.ndarray) -> Runs:
        lens = self.lens[at]
        out = Runs(self.flat, lens)
        shift = np.repeat(self.starts[at] - out.starts, lens)
        shift += np.arange(len(shift))
        out.flat = self.flat[shift]
        return out

    @classmethod
    def paired(cls, a: Runs, b: Runs) -> Runs:
        """Each run of a followed by the run of b of the same number."""
        n = len(a.lens)
        both = cls(np.concatenate([a.flat, b.flat]), np.concatenate([a.lens, b.lens]))
        order = np.empty(2 * n, np.int64)
        order[::2], order[1::2] = np.arange(n), np.arange(n, 2 * n)
        return cls(both.take(order).flat, a.lens + b.lens)


#: The UTF-8 bytes of each byte's spelling.
_SPELLED = Runs(np.frombuffer(b"".join(BYTE_LETTERS), np.uint8), np.array([len(x) for x in BYTE_LETTERS]))


def _bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, where each text begins, and where the last one ends)."""
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), at


def _list(texts: pa.StringArray) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes six times as long


def _strings(data: np.ndarray, lens: np.ndarray) -> pa.StringArray:
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


def _tails(words: pa.StringArray, cores: pa.StringArray) -> pa.StringArray:
    """What each word has after its core."""
    data, at = _bytes_of(words)
    begin = at[:-1] + pc.binary_length(cores).to_numpy()
    found = Runs(data, at[1:] - begin)
    found.starts = begin
    return _strings(found.take(np.arange(len(words))).flat, found.lens)


def spelled(texts: pa.StringArray) -> pa.StringArray:
    """Texts with each byte in its printable spelling."""
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:  # letters spell themselves
        return texts
    data, at = _bytes_of(texts)
    found = _SPELLED.take(data[at[0] : at[-1]])
    return _strings(found.flat, np.diff(np.concatenate([[0], np.cumsum(found.lens)])[at - at[0]]))


class Encoder:
    """encode(texts): ids of each whole text, one after the other.

    kind "byte": byte-level, cut before single spaces and line ends. kind "word": white
    space is dropped by the model, cut at spaces and line ends. A cut that stands after a
    line end, or opens a text, begins with a line end here and has no space before it.
    Words of other shapes are encoded in one call, joined by a mark with an id of its own,
    at which the ids are split.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_file(path), kind
        self.batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        #: What joins words: a pre-token of one id that none of them holds.
        self.mark = "\n" if kind == "byte" else " |"
        (self.mark_id,) = self.tok.encode(self.mark, add_special_tokens=False).ids
        self.newline = np.array([self.mark_id], "<u4").tobytes() if kind == "byte" else b""
        self.alone = re.compile(r"\s|^$" if kind == "byte" else r"[\s|]|^$")
        self.model, self.cores, self.tails = self.tok.model, WordCache(), WordCache(CACHE_TAILS)
        #: Whether the file splits as its kind should; if not, all cuts go through the whole library.
        probe = ["the", "Straße", "Ünglück", "naïve", "it"]
        self.direct = self._letters(probe) == self._whole([" " + w for w in probe])
        if kind == "byte":
            self.direct &= self._letters(["\n" + w for w in probe]) == self._whole(["\n" + w for w in probe])
        self.direct &= self._whole([" the!!,"]) == [self._letters(["the"])[0] + self._whole(["!!,"])[0]]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.batch(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of any shape, with `before` before each."""
        out: dict[str, bytes] = {}
        odd = [w for w in words if self.alone.search(w)]
        plain = [w for w in words if not self.alone.search(w)] if odd else words
        out.update(zip(odd, self._whole([before + w for w in odd]), strict=True))
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.batch([before + (self.mark + before).join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(part) - 1:
                out.update(zip(part, self._whole([before + w for w in part]), strict=True))
                continue
            raw, starts, stops = ids.tobytes(), [0, *((ends + 1) * 4).tolist()], [*(ends * 4).tolist(), 4 * len(ids)]
            out.update(zip(part, [raw[a:b] for a, b in zip(starts, stops, strict=True)], strict=True))
        return [out[w] for w in words]

    def _letters(self, cores: list[str]) -> list[bytes]:
        """Ids of cuts of letters, from the model alone."""
        texts = pa.array(cores, pa.string())
        first = None
        if self.kind == "word":
            texts = spelled(pc.utf8_lower(texts))
        else:
            line = pc.starts_with(texts, "\n")
            texts = spelled(pc.ascii_ltrim(texts, characters="\n"))
            texts = pc.binary_join_element_wise(pc.if_else(line, "", "Ġ"), texts, "")
            first = line.to_numpy(zero_copy_only=False).tolist()
        tokenize = self.model.tokenize
        found = [[x.id for x in tokenize(t)] for t in _list(texts)]
        stops = (4 * np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))).tolist()
        raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        out = [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return [self.newline + x if f else x for x, f in zip(out, first, strict=True)] if first else out

    def _others(self, words: list[str]) -> list[bytes]:
        if self.kind == "word":
            return self._joined(words, " ")
        out: dict[str, bytes] = {}
        lines = [w[1:] for w in words if w[:1] == "\n"]
        out.update(zip(lines, self._joined(lines, ""), strict=True))
        found = {"\n" + w: self.newline + b for w, b in out.items()}
        spaced = [w for w in words if w[:1] != "\n"]
        found.update(zip(spaced, self._joined(spaced, " "), strict=True))
        return [found[w] for w in words]

    def _new(self, cores: list[str], letters: list[bool]) -> list[bytes]:
        """Ids of new cuts, of letters or not."""
        own = iter(self._letters([c for c, x in zip(cores, letters, strict=True) if x]))
        rest = iter(self._others([c for c, x in zip(cores, letters, strict=True) if not x]))
        return [next(own if x else rest) for x in letters]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end); null is an empty text, end_id closes each text."""
        texts = pc.fill_null(texts if pa.types.is_string(texts.type) else texts.cast(pa.string()), "")
        size = pc.binary_length(texts).to_numpy()
        opens = np.ones(len(texts), bool)
        owner = np.arange(len(texts))
        if len(size) and size.max() > LONG_CHARS:
            slices = [self._slices(t) for t in texts.to_pylist()]
            owner = np.repeat(owner, [len(s) for s in slices])
            opens = np.concatenate([[True] + [False] * (len(s) - 1) for s in slices])
            texts = pa.array([x for s in slices for x in s], pa.string())
            size = pc.binary_length(texts).to_numpy()
        flat, lens, i = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0
        total = np.cumsum(size)
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + PART_BYTES, "right")))
            found = self._part(texts.slice(i, j - i), opens[i:j])
            flat.append(found.flat)
            lens.append(found.lens)
            i = j
        ids = np.concatenate(flat)
        ends = np.cumsum(np.bincount(owner, np.concatenate(lens), int(owner[-1]) + 1 if len(owner) else 0).astype(np.int64))
        if end_id is None:
            return ids, ends
        ends += np.arange(1, len(ends) + 1)
        last = np.zeros(len(ids) + len(ends), bool)
        last[ends - 1] = True
        out = np.empty(len(last), "<u4")
        out[last], out[~last] = end_id, ids
        return out, ends

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text."""
        ids, ends = self.encode(pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _slices(self, text: str) -> list[str]:
        """A long text's slices; each but the first is what follows a single space."""
        out, s = [], 0
        while len(text) - s > LONG_CHARS and (m := SINGLE_SPACE.search(text, s + LONG_CHARS)):
            out.append(text[s : m.start()])
            s = m.end()
        return [*out, text[s:]]

    def _part(self, texts: pa.StringArray, opens: np.ndarray) -> Runs:
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        byte = self.kind == "byte"
        cut = pc.replace_substring(texts, "\n", " \n" if byte else " ")
        if byte:
            cut = pc.binary_join_element_wise(pa.array(np.where(opens, "\n", "").tolist(), pa.string()), cut, "")
        cuts = pc.split_pattern(cut, " ")
        coded = cuts.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        ends = cuts.offsets.to_numpy()[1:].astype(np.int64) - cuts.offsets[0].as_py()
        if byte:
            odd = pc.and_(pc.match_substring_regex(words, EDGE_SPACE), pc.not_equal(words, "\n"))
            odd = pc.or_(odd, pc.equal(words, "")).to_numpy(zero_copy_only=False)[at]
            line = pc.index(words, "\n").as_py()
            odd[1:] |= (at[1:] == line) & (at[:-1] == line)
            whole |= np.diff(np.concatenate([[0], np.cumsum(odd)])[ends], prepend=0) > 0
        found = self._words(words).take(at)
        ids, lens = found.flat, np.diff(np.concatenate([[0], np.cumsum(found.lens)])[ends], prepend=0)
        if byte:  # the line end put before an opening cut is none of the text's own
            keep = np.ones(len(ids), bool)
            keep[(np.cumsum(lens) - lens)[opens]] = False
            ids, lens = ids[keep], lens - opens
        if not whole.any():
            return Runs(ids, lens)
        places = np.flatnonzero(whole).tolist()
        alone = self._whole([("" if opens[i] else " ") + texts[i].as_py() for i in places])
        stops, parts, s = np.cumsum(lens), [], 0
        for i, raw in zip(places, alone, strict=True):
            parts += [ids[s : stops[i] - lens[i]], np.frombuffer(raw, "<u4")]
            s = stops[i]
            lens[i] = len(raw) // 4
        return Runs(np.concatenate([*parts, ids[s:]]), lens)

    def _words(self, words: pa.StringArray) -> Runs:
        """The ids of each distinct cut."""
        cores = words
        plain = np.zeros(len(words), bool)
        if self.direct:
            cores = pc.ascii_rtrim(words, characters=MARKS)
            mask = pc.match_substring_regex(cores, LETTERS)
            cores, plain = pc.if_else(mask, cores, words), mask.to_numpy(zero_copy_only=False)
        cored, tailed = cores.dictionary_encode(), _tails(words, cores).dictionary_encode()
        at = cored.indices.to_numpy()
        names, letters = _list(cored.dictionary), np.zeros(len(cored.dictionary), bool)
        letters[at] = plain
        a = Runs.of(self.cores.values(names, lambda new: self._new([names[i] for i in new], letters[new].tolist())))
        marks = _list(tailed.dictionary)
        b = Runs.of(self.tails.values(marks, lambda new: self._whole([marks[i] for i in new])))
        return Runs.paired(a.take(at), b.take(tailed.indices.to_numpy()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker process's own encoder."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
