"""Problem 10: the reading level of each document, from 1 (easiest) to 4 (hardest).

Every sentence of the labelled samples trains a regularised multinomial model on its words and on the character three-grams of
its words (of words in lower case only, so that names don't count); both enter as means over the sentence's words, beside the
sentence's length. A document's sentences are classified one by one, their distributions are averaged, and a second, small model
turns a document's distribution into its level. It is fitted on out-of-fold averages: each sample's sentences are judged by a model
that was trained on the other folds.

At most ``max_samples`` labelled rows (by id) are used for fitting; the sentence matrix is sparse, so 5,000 samples need some
hundred MB on the driver and minutes. Cases: null texts are left out; samples without text or level
are skipped; documents below ``min_words`` words or not in English (any notation; null is out) have no row.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.keys import reject_missing

LEVELS = 4
MAX_SAMPLES = 5_000
MIN_WORDS = 80
FOLDS = 5
MIN_SENTENCE = 4  # shorter pieces are headings and labels, which say little about the text's level
BREAK = re.compile(r"(?<=[.!?])[\s\xa0]+|(?<=[.!?][”\"')])[\s\xa0]+|\n\s*(?=[A-Z0-9•*(\-–])")
WORD = re.compile(r"[A-Za-z0-9]+")


def is_english(lang: Column) -> Column:
    return F.coalesce(F.lower(F.trim(lang)).rlike(r"\A(en|eng|english)([-_].*)?\z"), F.lit(False))


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def sentences(text: str) -> list[list[str]]:
    out = []
    for s in BREAK.split(text.replace("\xad", "").replace("​", "")):
        w = WORD.findall(s)
        if w:
            out.append(w)
    small = sum(w[0].islower() for s in out for w in s)
    if small < 0.3 * sum(map(len, out)):  # capitals or title case throughout: case says nothing about names
        out = [[w.lower() for w in s] for s in out]
    return [w for w in out if len(w) >= MIN_SENTENCE] or out


class Sparse:
    """A matrix by its entries, with what products from both sides need; memory grows with the entries only."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.sides = []
        for of, other, n in ((row, col, shape[0]), (col, row, shape[1])):
            order = np.argsort(of, kind="stable")
            sorted_ = of[order]
            first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(of) else np.zeros(0, np.int64)
            self.sides.append((n, sorted_[first], first, other[order], value[order][:, None]))

    def _times(self, side: int, m: np.ndarray) -> np.ndarray:
        n, at, first, other, value = self.sides[side]
        out = np.zeros((n, m.shape[1]))
        if len(at):
            out[at] = np.add.reduceat(value * m[other], first, axis=0)
        return out

    def __matmul__(self, m: np.ndarray) -> np.ndarray:
        return self._times(0, m)

    def back(self, m: np.ndarray) -> np.ndarray:
        """The transposed matrix times m."""
        return self._times(1, m)

    @staticmethod
    def dense(x: np.ndarray) -> Sparse:
        return Sparse(np.repeat(np.arange(x.shape[0]), x.shape[1]), np.tile(np.arange(x.shape[1]), x.shape[0]), x.ravel(), x.shape)


def _fit(x: Sparse, y: np.ndarray, classes: int, penalty: float, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial regression with an L2 penalty, by accelerated gradient steps over the whole sample."""
    n = x.shape[0]
    v = np.random.default_rng(1).standard_normal((x.shape[1], 1))
    for _ in range(30):  # the largest singular value, squared
        v /= np.sqrt(np.square(v).sum()) or 1.0
        v = x.back(x @ v)
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    onehot = np.eye(classes)[y]
    rate = 1.0 / (0.55 * np.sqrt(np.square(v).sum()) / n + penalty + 0.5)
    vw, vb, t = w.copy(), b.copy(), 1.0
    for _ in range(steps):
        z = x @ vw + vb
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - onehot) / n
        nw, nb = vw - rate * (x.back(g) + penalty * vw), vb - rate * g.sum(0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        still = np.abs(nw - w).max() > 1e-4 * np.abs(nw).max()
        w, b, t = nw, nb, t2
        if not still:
            break
    return w, b


class ReadingModel:
    """word_part, gram_part: weights by word and three-gram; the rest: numpy arrays. Small enough to be broadcast
    (it grows with the bounded sample only)."""

    def __init__(self, samples: list[tuple[str, int]], penalty: float = 2e-4, folds: int = FOLDS):
        texts = [(sentences(t), n - 1) for t, n in samples]
        self._learn(texts, penalty)
        means, labels = [], []
        for k in range(folds if len(texts) >= 2 * folds else 0):  # no sample is judged by a model that has seen it
            part = ReadingModel.__new__(ReadingModel)
            part._learn([x for i, x in enumerate(texts) if i % folds != k], penalty)
            for sents, level in texts[k::folds]:
                means.append(part.distributions(sents).mean(0))
                labels.append(level)
        if not means:  # too few samples to hold any back
            means, labels = [self.distributions(s).mean(0) for s, _ in texts], [n for _, n in texts]
        self.doc_w, self.doc_b = _fit(Sparse.dense(np.stack(means) * 4), np.array(labels), LEVELS, 1e-3)

    def _learn(self, texts: list[tuple[list[list[str]], int]], penalty: float) -> None:
        words, tri, at, row, value, y = {}, {}, [], [], [], []
        for sents, level in texts:
            for s in sents:
                seen: dict[tuple[bool, int], float] = {}
                for w in s:
                    k = (False, words.setdefault(w.lower(), len(words)))
                    seen[k] = seen.get(k, 0.0) + 4 / len(s)
                    if w.islower():
                        for g in grams(w):
                            k = (True, tri.setdefault(g, len(tri)))
                            seen[k] = seen.get(k, 0.0) + 2 / len(s)
                at += seen
                value += seen.values()
                row += [len(y)] * len(seen)
                at.append((True, -1))
                value.append(np.log(len(s)))
                row.append(len(y))
                y.append(level)
        # columns: words, then three-grams, then the length
        col = [i if not is_gram else len(words) + (i if i >= 0 else len(tri)) for is_gram, i in at]
        x = Sparse(np.array(row), np.array(col), np.array(value), (len(y), len(words) + len(tri) + 1))
        w, self.bias = _fit(x, np.array(y), LEVELS, penalty)
        self.words = {k: w[i] * 4 for k, i in words.items()}
        self.grams = {g: w[len(words) + i] * 2 for g, i in tri.items()}
        self.length = w[-1]

    def vector(self, word: str) -> np.ndarray:
        v = self.words.get(word.lower(), np.zeros(LEVELS))
        if word.islower():
            v = v + sum((self.grams[g] for g in grams(word) if g in self.grams), np.zeros(LEVELS))
        return v

    def distributions(self, sents: list[list[str]], ids=None, table=None) -> np.ndarray:
        n = np.array([len(s) for s in sents])
        if ids is None:
            v = np.stack([self.vector(w) for s in sents for w in s])
        else:
            v = table[ids]
        z = np.add.reduceat(v, np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None]
        z = z + np.log(n)[:, None] * self.length + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def levels(self, means: np.ndarray) -> np.ndarray:
        return np.argmax(means * 4 @ self.doc_w + self.doc_b, axis=1) + 1


def train(samples: DataFrame, max_samples: int = MAX_SAMPLES) -> ReadingModel:
    reject_missing(samples, "sample_id", "text", "level_no")
    rows = samples.where(f"text <> '' and level_no between 1 and {LEVELS}").select("sample_id", "text", "level_no").distinct()
    got = [(t, int(n)) for _, t, n in rows.orderBy("sample_id", "text", "level_no").limit(max_samples).collect() if sentences(t)]
    if not got:
        raise ValueError("no labelled sample with text")
    return ReadingModel(got)


def score(docs: DataFrame, model: ReadingModel, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, level_no, difficulty, n_words): English documents of at least min_words words. difficulty is the mean level
    over the sentences' distributions."""
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # with its class, by value
    rows = docs.where(is_english(F.col("lang")) & F.col("doc_id").isNotNull() & (F.col("text") != "")).select("doc_id", "text")

    def run(batches):
        m = pickle.loads(sent.value)
        known: dict[str, int] = {}
        table = np.zeros((1024, LEVELS))
        for batch in batches:
            ids, means, counts = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sents = sentences(t)
                n = len(WORD.findall(t))
                if n < min_words:
                    continue
                flat = []
                for s in sents:
                    for w in s:
                        k = known.get(w)
                        if k is None:
                            k = known[w] = len(known)
                            if k == len(table):
                                table = np.concatenate([table, np.zeros_like(table)])
                            table[k] = m.vector(w)
                        flat.append(k)
                ids.append(d)
                counts.append(n)
                means.append(m.distributions(sents, flat, table).mean(0))
            if not ids:
                continue
            if len(known) > 500_000:  # words kept only for speed
                known, table = {}, np.zeros((1024, LEVELS))
            p = np.stack(means)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(m.levels(p).astype(np.int32)), pa.array(p @ np.arange(1.0, LEVELS + 1)), pa.array(counts, pa.int32())],
                ["doc_id", "level_no", "difficulty", "n_words"],
            )

    return rows.mapInArrow(run, "doc_id bigint, level_no int, difficulty double, n_words int")
