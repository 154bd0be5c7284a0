"""A quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Words are runs of characters between white space. An n-gram is one word or two neighbours, as it stands and as a shape
(the kinds of characters in order, ``Aa.`` for "House."), the latter up to three neighbours; a word that repeats its
left neighbour has an n-gram of its own. Each n-gram is hashed to one of 2^18 weights; its value is its share of the
text's n-grams, scaled. Scores are sparse dot products: the weights of all n-grams of a slice of texts are gathered and
summed by text.

Whole texts are scored, of any length. Null and empty texts have no n-grams: their score is that of the bias. Equal
texts get equal scores. With no labelled row, or one label only, the score is the share of label 1 (0.5 if there are
none). An id with both labels counts as label 1; of an id with several texts the least is learned from. An empty table
gives an empty one; a column named like the score is replaced, others pass through.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import LONG, appended, learned_from, mixed, segment_sums

BITS = 18
MASK = np.uint64((1 << BITS) - 1)
#: The bound of the training sample: labelled rows of lowest hash.
SAMPLE = 3000
#: Values are shares of a text's n-grams times this.
SCALE = 30.0
REPEAT = np.uint64(0x5EED)


#: The low bits of a word's hash are its shape.
SHAPE = np.uint64((1 << 10) - 1)
_runs = re.compile(r"(.)\1+").sub


class Kinds(dict):
    """Character to the character that stands for its kind, for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        got = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return got


_kinds = Kinds()


def shape(word: str) -> str:
    """``word`` with each run of capitals, small letters, digits or one other character written once: "ABC," is "A,"."""
    if word.islower():
        if word.isalpha():
            return "a"
        if word[:-1].isalpha():
            return "a" + word[-1]
    return _runs(r"\1", word.translate(_kinds))


class Words(dict):
    """Word to a 64-bit hash with its shape in the low bits; emptied at ``limit`` words."""

    limit = 100_000

    def __missing__(self, word: str) -> int:
        got = xxh3_64_intdigest(word) & ~1023 | xxh3_64_intdigest(shape(word), 7) & 1023
        if len(word) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[word] = got
        return got


def ngrams(texts: list[str | None], known: Words) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Buckets of the n-grams of all texts: for each kind of n-gram one flat array and where each text begins in it;
    and the number of n-grams of each text."""
    words = [(t or "").split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    word = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, starts[-1])
    form = word & SHAPE
    last = np.zeros(len(word), bool)
    last[starts[1:][counts > 0] - 1] = True
    kinds, begins = [word >> np.uint64(64 - BITS), mixed(form) & MASK], [starts, starts]
    if len(word) > 1:
        two = np.flatnonzero(~last[:-1])
        pair_starts = np.searchsorted(two, starts)
        same = word[two] == word[two + 1]
        pair = mixed(word[two] * np.uint64(3) + word[two + 1])
        kinds.append(np.where(same, REPEAT, pair) & MASK)
        kinds.append(mixed(form[two] * np.uint64(5) + form[two + 1]) & MASK)
        begins += [pair_starts, pair_starts]
        three = two[two + 2 < len(word)]
        three = three[~last[three + 1]]
        kinds.append(mixed(form[three] * np.uint64(7) + form[three + 1] * np.uint64(11) + form[three + 2]) & MASK)
        begins.append(np.searchsorted(three, starts))
    totals = sum(np.diff(b) for b in begins)
    return kinds, begins, totals


class FtrlClassifier:
    """Per-coordinate FTRL-proximal logistic regression."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3):
        self.alpha, self.beta, self.l1, self.l2, self.epochs = alpha, beta, l1, l2, epochs
        self.weights = np.zeros(1 << BITS, np.float32)
        self.bias = 0.0

    def fit(self, texts: list[str | None], labels: list[int]) -> FtrlClassifier:
        y = np.asarray(labels, float)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = float(np.log(share / (1 - share)))
        if len(set(labels)) < 2:
            return self
        known, rows = Words(), []
        for at in range(0, len(texts), 500):
            kinds, begins, totals = ngrams(texts[at : at + 500], known)
            for i, total in enumerate(totals):
                found = np.concatenate([k[b[i] : b[i + 1]] for k, b in zip(kinds, begins, strict=True)])
                index, count = np.unique(found, return_counts=True)
                rows.append((index.astype(np.int64), count * (SCALE / max(total, 1))))
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        bias_sum = 0.0
        order = np.random.Generator(np.random.PCG64(11))
        for _ in range(self.epochs):
            for r in order.permutation(len(rows)):
                index, value = rows[r]
                zi, ni = z[index], n[index]
                root = np.sqrt(ni)
                w = np.where(np.abs(zi) <= self.l1, 0.0, -(zi - np.sign(zi) * self.l1) / ((self.beta + root) / self.alpha + self.l2))
                p = 1 / (1 + np.exp(-np.clip(self.bias + w @ value, -30, 30)))
                g = (p - y[r]) * value
                z[index] = zi + g - (np.sqrt(ni + g * g) - root) / self.alpha * w
                n[index] = ni + g * g
                bias_sum += (p - y[r]) ** 2
                self.bias -= 0.3 / (1 + np.sqrt(bias_sum)) * (p - y[r])
        root = np.sqrt(n)
        self.weights = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + root) / self.alpha + self.l2)).astype(np.float32)
        return self

    def score(self, texts: list[str | None], known: Words) -> np.ndarray:
        kinds, begins, totals = ngrams(texts, known)
        dot = sum(segment_sums(self.weights[k], b) for k, b in zip(kinds, begins, strict=True))
        dot = dot * (SCALE / np.maximum(totals, 1))
        return 1 / (1 + np.exp(-np.clip(self.bias + dot, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", label: str = "quality", text: str = "text") -> FtrlClassifier:
    """A classifier from ``labels`` (key, label), of which the ``sample`` rows of lowest hash are used, up to ``SAMPLE_BYTES`` of text."""
    got = learned_from(docs, labels, key, label, text, sample)
    return FtrlClassifier().fit([t for t, _ in got], [y for _, y in got])


def scored(docs: DataFrame, model: FtrlClassifier, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text: 0 to 1, higher for label 1."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 1 MB, whatever the input

    def make():
        known, m = Words(), FtrlClassifier()
        m.weights, m.bias = held.value
        return lambda texts: [m.score(texts, known)]

    return appended(docs, [(score, T.DoubleType())], make, text)
