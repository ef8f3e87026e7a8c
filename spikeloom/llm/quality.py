"""Quality classifier from weak labels (operator 10).

Eight heuristics vote junk, good or nothing on every text. Expectation-maximisation over the
counts of their vote patterns, taken over all documents, estimates the share of junk, each
heuristic's accuracy in both classes and how often it abstains (of which the class is
independent: most abstain on short texts), and so the posterior of every pattern. A bounded
sample of distinct texts, with their posteriors as labels, trains a linear scorer over
hashed words, word shapes and two repetition measures; the scorer judges every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, gear_values, map_arrow

HEURISTICS = ("symbols", "shouting", "repeats", "variety", "letters", "bursts", "separators", "compression")
JUNK, ABSTAIN, GOOD = 0, 1, 2
#: Hash buckets of words and of shapes, and the last two columns for the measures.
WORD_BUCKETS, SHAPE_BUCKETS = 2048, 512
FEATURES = WORD_BUCKETS + SHAPE_BUCKETS + 2
#: Distinct texts that train the scorer, at most.
SAMPLE_ROWS = 3000

#: Words that a text's shares are taken over beside its own, so that a few words say little.
SHRINK = 8
#: Words in which variety is counted, so that long texts are held against the same limits; words of a run that may not come again.
WINDOW, RUN = 2000, 8

_SYMBOLS = b"*%&$#!|@{}<>=_~^\\"
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_MARKS = bytes([b for b in range(33, 127) if not chr(b).isalnum()])
_BURST = re.compile(rb"[!-/:-@\[-`{-~]{2,}")


def repetition(words: list[bytes]) -> float:
    """Share of words that aren't new where they stand, over a whole text.

    A word is new in its window of 2000 if it stands there for the first time and isn't part
    of a run of 8 words that began earlier in the text. Windows follow each other; the last
    one ends with the text and counts by the words that no other has. Up to 2000 words this
    is 1 - distinct words / words, as a run that came before has no new word.
    """
    n = len(words)
    if n <= WINDOW:
        return 1 - len(set(words)) / n
    known: dict[bytes, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    mark = gear_values(0, len(known), np.uint64)[at]
    runs = np.zeros(n - RUN + 1, np.uint64)
    for i in range(RUN):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + mark[i : i + len(runs)]
    _, first, which = np.unique(runs, return_index=True, return_inverse=True)
    begun = np.zeros(n + 1, np.int64)
    again = np.flatnonzero(first[which] < np.arange(len(runs)))
    np.add.at(begun, again, 1)
    np.add.at(begun, again + RUN, -1)
    fresh = np.cumsum(begun[:n]) == 0
    new = 0.0
    for e in [*range(WINDOW, n, WINDOW), n]:
        s, counts = e - WINDOW, (e - 1) % WINDOW + 1
        new += len(np.unique(at[s:e][fresh[s:e]])) * counts / WINDOW
    return 1 - new / n


def votes(text: bytes) -> tuple[int, ...]:
    """Each heuristic's vote on a whole text; none votes on a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (ABSTAIN,) * len(HEURISTICS)
    size = sum(map(len, words))
    symbols = 1 - len(text.translate(None, _SYMBOLS)) / len(text)
    letters = len(text) - len(text.translate(None, _LETTERS))
    upper = (len(text) - len(text.translate(None, _UPPER))) / max(letters, 1)
    again = sum(map(eq, words, words[1:])) / n
    bursts = len(_BURST.findall(text)) / n
    marks = n - len(text.translate(None, _MARKS).split())
    long = n >= 20

    def vote(x: float, good: float, junk: float) -> int:
        return JUNK if x >= junk else GOOD if x <= good else ABSTAIN

    return (
        vote(symbols, 0.005, 0.03), vote(upper, 0.1, 0.35) if long else ABSTAIN, vote(again, 0.02, 0.1) if long else ABSTAIN,
        vote(repetition(words), 0.45, 0.65) if n >= 50 else ABSTAIN, vote(1 - letters / size, 0.08, 0.2) if long else ABSTAIN, vote(bursts, 0.02, 0.15) if long else ABSTAIN,
        vote(marks / n, 0.02, 0.2) if long else ABSTAIN, vote(-len(zlib.compress(text, 1)) / len(text), -0.36, -0.3) if n >= 50 else ABSTAIN,
    )


@dataclass(frozen=True)
class LabelModel:
    """prior of junk, and chances[c][heuristic][vote] of class c (0 junk, 1 good)."""

    prior: float
    chances: np.ndarray

    def junk(self, pattern: tuple[int, ...]) -> float:
        logs = [math.log(p) + sum(math.log(self.chances[c][j][v]) for j, v in enumerate(pattern)) for c, p in ((0, self.prior), (1, 1 - self.prior))]
        return 1 / (1 + math.exp(max(-700, min(700, logs[1] - logs[0]))))

    def accuracies(self) -> dict[str, tuple[float, float, float]]:
        """Of each heuristic: share of junk found, share of good text left alone, share of texts it votes on."""
        votes = 1 - self.chances[0, :, ABSTAIN]
        return {h: (self.chances[0, j, JUNK] / votes[j], self.chances[1, j, GOOD] / votes[j], votes[j]) for j, h in enumerate(HEURISTICS)}


def fit_labels(counts: dict[tuple[int, ...], int], rounds: int = 500) -> LabelModel:
    """Expectation-maximisation on pattern counts; one pattern stands for all its documents.

    Starts at heuristics that find 0.4 of the junk and call 0.02 of good text junk. Of the
    two classes found, junk is the one in which the majority of heuristics call junk more often.
    """
    m = len(HEURISTICS)
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    onehot = np.zeros((len(patterns), m, 3))
    for i, p in enumerate(patterns):
        onehot[i, range(m), p] = 1
    total = weight.sum()
    silent = (np.tensordot(weight, onehot, 1)[:, ABSTAIN] + 0.01) / (total + 0.02)

    def chances(junk: np.ndarray) -> np.ndarray:
        return np.stack([np.stack([x * (1 - silent), silent, (1 - x) * (1 - silent)], 1) for x in junk])

    model = LabelModel(0.15, chances(np.array([[0.4] * m, [0.02] * m])))
    for _ in range(rounds if patterns else 0):
        p = np.array([model.junk(x) for x in patterns])
        found = []
        for q in (p, 1 - p):
            seen = np.tensordot(q * weight, onehot, 1) + 0.01
            found.append(seen[:, JUNK] / (seen[:, JUNK] + seen[:, GOOD]))
        prior = float((p @ weight + 0.01) / (total + 0.02))
        new = LabelModel(prior, chances(np.array(found)))
        done = abs(prior - model.prior) < 1e-9 and np.allclose(new.chances, model.chances, rtol=0, atol=1e-9)
        model = new
        if done:
            break
    if 2 * (model.chances[0, :, JUNK] < model.chances[1, :, JUNK]).sum() > m:
        model = LabelModel(1 - model.prior, model.chances[::-1].copy())
    return model


def _shape(word: bytes) -> bytes:
    """Case and class pattern of a word with its last three marks."""
    letters = word.strip(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\")
    case = b"U" if letters.isupper() and len(letters) > 1 else b"T" if letters[:1].isupper() else b"l"
    return case + (b"d" if letters[:1].isdigit() else b"a") + word[len(word.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\")) :][-3:]


def columns_of(word: bytes) -> tuple[int, int]:
    return zlib.crc32(word) % WORD_BUCKETS, WORD_BUCKETS + zlib.crc32(_shape(word)) % SHAPE_BUCKETS


def _measures(words: list[bytes]) -> tuple[float, float]:
    n = len(words)
    return sum(map(eq, words, words[1:])) / n, max(0.0, repetition(words) - 0.4)


def sparse(text: bytes) -> tuple[list[int], list[float]]:
    words = text.split()
    if not words:
        return [], []
    total: dict[int, float] = {}
    for w in words:
        for c in columns_of(w):
            total[c] = total.get(c, 0) + 1
    n = len(words) + SHRINK
    a, b = _measures(words)
    return [*total, FEATURES - 2, FEATURES - 1], [*[x / n for x in total.values()], a, b]


#: How much a feature's unit counts: single words vary and get little, measures much.
SCALE = np.concatenate([np.full(WORD_BUCKETS, 0.1), np.full(SHAPE_BUCKETS, 4.0), [8.0, 4.0]])


def fit_scorer(rows: list[tuple[list[int], list[float], float]], rounds: int = 200, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (chance of good), classes weighted alike, by full-batch gradient steps."""
    if not rows:
        return np.zeros(FEATURES), 1.0
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, (at, values, _) in enumerate(rows):
        x[i, at] = values
    x *= SCALE.astype(np.float32)
    y = np.array([r[2] for r in rows])
    weight = np.where(y < 0.5, 0.5 / max((y < 0.5).sum(), 1), 0.5 / max((y >= 0.5).sum(), 1))
    weight /= weight.sum()
    w, b, sq, sqb = np.zeros(FEATURES, np.float32), 0.0, np.full(FEATURES, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - y) * weight
        gw, gb = x.T @ g.astype(np.float32) + decay * w, float(g.sum())
        sq += gw**2
        sqb += gb**2
        w = (w - 0.5 * gw / np.sqrt(sq)).astype(np.float32)
        b -= 0.5 * gb / math.sqrt(sqb)
    return w.astype(float) * SCALE, b


class Scorer:
    """Chance of good for whole texts; a bounded number of words' weights is kept."""

    def __init__(self, model: Model):
        self.w, self.b, self.wordless, self.known = model.weights, model.bias, 1 - model.labels.prior, {}

    def __call__(self, text: bytes) -> float:
        words = text.split()
        if not words:
            return self.wordless
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for x in [x for x in set(words) if x not in known]:
            i, j = columns_of(x)
            known[x] = float(self.w[i] + self.w[j])
        a, r = _measures(words)
        z = self.b + math.fsum(map(known.__getitem__, words)) / (len(words) + SHRINK) + self.w[-2] * a + self.w[-1] * r
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@dataclass(frozen=True)
class Model:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Label model over all documents' votes; scorer on a sample of `sample_rows` distinct texts by a hash of the text.

    To the driver come the pattern counts (at most 3**8 rows) and the sample's features.
    Copies of a text count once in the sample, so that a large group takes no other's place.
    An empty table gives a model that calls everything good.
    """

    def count(batches):
        seen: dict = {}
        for b in batches:
            for t in bytes_of(b.column(0)):
                v = votes(t)
                seen[v] = seen.get(v, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    found = map_arrow(texts, count, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    counts = {tuple(r["votes"]): r["n"] for r in found}
    total = sum(counts.values())
    labels = fit_labels(counts)
    order = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    share = min(1.0, 1.3 * sample_rows / max(total, 1))
    drawn = texts.withColumn("order", order).filter(F.col("order") <= int(share * (1 << 40))).groupBy("order").agg(F.min("text").alias("text")).select("text", "order")
    sent = docs.sparkSession.sparkContext.broadcast(labels)

    def features(batches):
        for b in batches:
            rows = [(*sparse(t), 1 - sent.value.junk(votes(t))) for t in bytes_of(b.column(0))]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.float64())],
                ["order", "at", "value", "good"])

    sample = map_arrow(drawn, features, "order long, at array<int>, value array<double>, good double").orderBy("order", "good").limit(sample_rows)
    rows = [(list(r["at"]), list(r["value"]), r["good"]) for r in sample.collect()]
    weights, bias = fit_scorer(rows)
    # training weighs both classes alike; the bias is set back to the share of junk
    return Model(labels, weights, bias + math.log((1 - labels.prior) / labels.prior))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, votes string, posterior double, score double, keep boolean); both numbers are chances of good.

    A text without words gets the share of good documents; no row is dropped.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        m = sent.value
        scorer, sure = Scorer(m), {}
        for b in batches:
            texts = bytes_of(b.column(1))
            v = [votes(t) for t in texts]
            for p in [p for p in set(v) if p not in sure]:
                sure[p] = 1 - m.labels.junk(p)
            s = [scorer(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(["".join("j-g"[x] for x in p) for p in v]), pa.array([sure[p] for p in v], pa.float64()), pa.array(s, pa.float64()), pa.array([x >= threshold for x in s], pa.bool_())],
                [id_col, "votes", "posterior", "score", "keep"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, votes string, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that the scorer rejects; all columns pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            texts = bytes_of(b.column(b.schema.get_field_index(text_col)))
            yield b.filter(pa.array([scorer(t) >= threshold for t in texts], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
