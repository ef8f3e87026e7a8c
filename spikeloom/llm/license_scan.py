"""License scan by an exact set-similarity join against template texts (operator 4).

A text block is a line, or as many consecutive words over line ends as the template has; the
latter counts where it holds more of the template than each of its lines, so that wrapped
sentences are found. A block meets a template if it holds at least `threshold` of the
template's distinct words (containment). Words are ordered by their global frequency,
rarest first. Prefix filter: a block that meets the threshold shares a word with the
template's first |T| - ceil(t|T|) + 1 words of that order, so only blocks with such a word
are candidates. Length filter: the block needs ceil(t|T|) distinct words. Positional
filter: after the i-th word of the order is found missing, too many misses end the count.
Every block of every text is looked at; all templates are fixed values of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, map_arrow, words_alnum

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Sentences that name or open a licence, then whole notices, and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    *[(" ".join(text.split()), label) for text, label in (
        ("""licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
         you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
         software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
         see the license for the specific language governing permissions and limitations under the license""", "apache"),
        ("""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
         to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
         copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
         the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software""", "mit"),
        ("""redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
         redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
         redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
         in the documentation and or other materials provided with the distribution""", "bsd"),
        ("""this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
         the free software foundation either version 3 of the license or at your option any later version
         this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability
         or fitness for a particular purpose see the gnu general public license for more details""", "gpl"),
        ("""this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by
         the free software foundation either version 2 1 of the license or at your option any later version""", "lgpl"),
        ("""permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
         provided that the above copyright notice and this permission notice appear in all copies""", "isc"),
        ("""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
         this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""", "unlicense"),
    )],
)
THRESHOLD = 0.8


class Scanner:
    """Templates with their words in global frequency order, rarest first."""

    def __init__(self, templates, threshold: float, counts: dict[bytes, int]):
        self.threshold, self.index, self.templates, self.sizes = threshold, {}, [], []
        for k, (text, label) in enumerate(templates):
            words = sorted(set(text.encode().split()), key=lambda w: (counts.get(w, 0), w))
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            self.templates.append((words, need, label))
            self.sizes.append(len(text.split()))
            for w in words[: len(words) - need + 1]:
                self.index.setdefault(w, []).append(k)
        self.prefix = frozenset(self.index)

    def block(self, words: set) -> list[tuple[int, float]]:
        """(template, containment) of each template that the block meets."""
        out = []
        for k in sorted({k for w in words & self.prefix for k in self.index[w]}):
            order, need, _ = self.templates[k]
            if len(words) < need:
                continue
            misses = len(order) - need
            have = 0
            for w in order:
                if w in words:
                    have += 1
                else:
                    misses -= 1
                    if misses < 0:
                        break
            if have >= need and misses >= 0:
                out.append((k, have / len(order)))
        return out


    def wrapped(self, lines: list[list[bytes]], met: dict[tuple[int, int], float]) -> list[tuple[int, int, float]]:
        """(line of the first word, template, containment) of the blocks over line ends.

        met: containment by (line, template). Each block of a template's length is looked at;
        of blocks that overlap the fullest one is given, the first of equals.
        """
        here = set().union(*lines)
        if len(lines) < 2 or self.prefix.isdisjoint(here):
            return []
        out, words, line = [], None, None
        for k in sorted({k for w in here & self.prefix for k in self.index[w]}):
            order, need, _ = self.templates[k]
            wanted = here.intersection(order)
            if len(wanted) < need:
                continue
            if words is None:
                words, line = [w for x in lines for w in x], [i for i, x in enumerate(lines) for _ in x]
            at = [i for i, w in enumerate(words) if w in wanted]
            have, lo, found = Counter(), 0, []
            for i in at:
                have[words[i]] += 1
                while at[lo] <= i - self.sizes[k]:
                    w = words[at[lo]]
                    have[w] -= 1
                    if not have[w]:
                        del have[w]
                    lo += 1
                first, last, c = line[at[lo]], line[i], len(have) / len(order)
                if len(have) < need or first == last or c <= max(met.get((x, k), 0) for x in range(first, last + 1)):
                    continue
                if not found or at[lo] > found[-1][2]:
                    found.append((c, first, i))
                elif c > found[-1][0]:
                    found[-1] = (c, first, i)
            out += [(first, k, c) for c, first, _ in found]
        return out


def places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        needle, at = b" " + phrase.encode() + b" ", -1
        while (at := line.find(needle, at + 1)) >= 0:
            out.append((line.count(b" ", 0, at), label))
    return out


def word_counts(docs: DataFrame, words, text_col: str = "text") -> dict[bytes, int]:
    """In how many lines of all texts each of a fixed set of words stands; summed map-side first."""
    wanted = frozenset(words)

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for t in bytes_of(b.column(0)):
                for line in t.split(b"\n"):
                    total.update(wanted.intersection(words_alnum(line)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = map_arrow(docs.select(text_col), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}  # at most one row a template word


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: n_words, base_places (word, label), blocks (line, template, label, containment).

    Null or empty texts have no words, places or blocks. Two scans, one for the word
    frequencies and one for the join; nothing but template words' counts is shuffled.
    """
    counts = word_counts(docs, {w for t, _ in templates for w in t.encode().split()}, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(templates, threshold, counts))
    kind = dict(docs.dtypes)[id_col]
    place_t = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    block_t = pa.list_(pa.struct([("line", pa.int32()), ("template", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))

    def run(batches):
        s = sent.value
        for b in batches:
            n, base, found = [], [], []
            for t in bytes_of(b.column(1)):
                lines = [words_alnum(x) for x in t.split(b"\n")]
                words = [w for x in lines for w in x]
                n.append(len(words))
                base.append([{"word": i, "label": x} for i, x in sorted(places(words, phrases))])
                blocks = []
                for i, x in enumerate(lines):
                    if not s.prefix.isdisjoint(x):
                        blocks += [(i, k, c) for k, c in s.block(set(x))]
                blocks = sorted(blocks + s.wrapped(lines, {(i, k): c for i, k, c in blocks}))
                found.append([{"line": i, "template": k, "label": s.templates[k][2], "containment": c} for i, k, c in blocks])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(base, place_t), pa.array(found, block_t)], [id_col, "n_words", "base_places", "blocks"])

    return map_arrow(
        docs.select(id_col, text_col), run,
        f"`{id_col}` {kind}, n_words long, base_places array<struct<word: long, label: string>>, blocks array<struct<line: int, template: int, label: string, containment: double>>")
