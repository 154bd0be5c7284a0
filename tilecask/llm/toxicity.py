"""A toxicity scorer: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features of a text: density, number, highest weight and summed weight of lexicon words; lexicon words within five words
of a second-person word, as share and number; shares of capitals, of words in capitals, of exclamation and question
marks, of other punctuation; share of words that hide letters behind digits or signs, and of those that are lexicon
words once uncovered; length. The lexicon is a short fixed list of insults plus words and word beginnings learned from
labelled rows by their log odds.

The trees are fitted to the logistic loss on 32 quantile bins of each feature; scores then go through a non-decreasing
step function fitted to held-out margins: those of labelled rows under trees and learned words that have not seen the
row. Null and empty texts have all features 0; very long texts are scored whole. Equal texts get equal scores. With no
labelled row, or one label only, the score is the share of label 1 (0 if there are none). An id with both labels counts
as label 1; of an id with several texts the least is learned from. An empty table gives an empty one; a column named
like the score is replaced, others pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, appended, learned_from, segment_sums

#: The bound of the training sample: labelled rows of lowest hash.
SAMPLE = 5000
#: At most so many words are learned.
LEARNED = 400
#: Common insults of public word lists.
INSULTS = "idiot moron scum loser clown stupid disgusting pathetic worthless trash dumb fool jerk imbecile vermin garbage hate kill shut ugly"
#: Second-person words in English, German, French and Spanish.
SECOND = "you your yours yourself u ya du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos usted ustedes tus tú ti vosotros"
#: Signs and the letters that they stand for.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
NEAR = 5
#: Beginnings of so many letters are learned like words, written with a "*".
STEMS = (6, 5)
FEATURES = 14

_signs = str.maketrans(SIGNS)
_hides = re.compile(r"[\w@$!|*.\-][0-9@$!|*.\-][^\W\d_]|^[0-9@$!|*][^\W\d_]").search
_letters = re.compile(r"[^\W\d_]+").findall
_not_letters = re.compile(r"[\W\d_]+").sub


class Words(dict):
    """Word to one row of a table: lexicon weight, second person, capitals, "!" and "?", other signs, hidden, uncovered.

    Rows are kept in a growing array; dictionary and array are emptied together.
    """

    limit = 100_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.second = lexicon, set(SECOND.split())
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.rows: list[tuple] = []
        self.array, self.filled = np.zeros((1024, 9), np.float32), 0

    def weight(self, plain: str) -> float:
        get = self.lexicon.get
        return get(plain, 0.0) or max([get(plain[:n] + "*", 0.0) for n in STEMS if len(plain) > n], default=0.0)

    def __missing__(self, word: str) -> int:
        plain = word.lower().strip(".,;:!?\"'()[]")
        weight = self.weight(plain)
        marks = word.count("!") + word.count("?")
        if word.isalpha():
            other = hidden = uncovered = 0
            upper = len(word) if word.isupper() else sum(map(str.isupper, word))
        else:
            upper = sum(map(str.isupper, word))
            other = sum(not c.isalnum() for c in word) - marks
            hidden = int(not plain.isalpha() and _hides(plain) is not None)
            uncovered = 0
            if hidden and not weight:
                weight = max(self.weight(_not_letters("", x)) for x in (plain.translate(_signs), plain))
                uncovered = int(weight > 0)
        at = self.filled + len(self.rows)
        if len(word) <= LONG:  # longer ones get a row each time, until the table is emptied
            self[word] = at
        self.rows.append((weight, plain in self.second, upper, len(word) > 1 and upper == len(word.strip(".,;:!?")) and upper > 1, marks, other, hidden, uncovered, len(word)))
        return at

    def table(self) -> np.ndarray:
        total = self.filled + len(self.rows)
        if total > len(self.array):
            self.array = np.concatenate([self.array, np.zeros((total, 9), np.float32)])
        if self.rows:
            self.array[self.filled : total] = self.rows
            self.filled, self.rows = total, []
        return self.array


def features(texts: list[str | None], known: Words) -> np.ndarray:
    """One row of dense features for each text."""
    if known.filled > known.limit:
        known.reset()
    words = [(t or "").split() for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    at = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, starts[-1])
    flat = known.table()[at]
    weight = flat[:, 0]
    toxic = (weight > 0).astype(np.float64)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    where = np.flatnonzero(flat[:, 1])  # second-person words
    near = np.zeros(len(at))
    hits = np.flatnonzero(toxic)
    if len(where) and len(hits):
        after = np.searchsorted(where, hits)
        for pick in (np.clip(after, 0, len(where) - 1), np.clip(after - 1, 0, len(where) - 1)):
            close = (np.abs(where[pick] - hits) <= NEAR) & (row[where[pick]] == row[hits])
            near[hits[close]] = 1
    n = np.maximum(np.diff(starts), 1)
    chars = np.maximum(segment_sums(flat[:, 8], starts), 1)
    total = [segment_sums(x, starts) for x in (toxic, weight, near, flat[:, 2], flat[:, 3], flat[:, 4], flat[:, 5], flat[:, 6], flat[:, 7])]
    highest = np.zeros(len(texts))
    np.maximum.at(highest, row[hits], weight[hits])
    return np.stack([total[0] / n, total[0], highest, total[1] / n, total[1], total[2] / n, total[2], total[3] / chars, total[4] / n, total[5] / chars, total[6] / chars, total[7] / n, total[8], np.log1p(np.diff(starts))], 1)


def lexicon_of(texts: list[str | None], labels: np.ndarray) -> dict[str, float]:
    """Words and their weights: the log odds of label 1 by the number of texts that hold them, where they are clear."""
    sides = (Counter(), Counter())
    for t, y in dict(zip(texts, labels, strict=True)).items():  # copies count once
        words = set(_letters((t or "").lower()))
        sides[int(y)].update(words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n})
    ones = max(int(labels.sum()), 1)
    zeros = max(len(labels) - int(labels.sum()), 1)
    found = {}
    for word, n in sides[1].items():
        if n >= 15 and len(word) > 2:
            odds = np.log((n + 0.5) / ones) - np.log((sides[0][word] + 0.5) / zeros)
            if odds > 3.5:
                found[word] = (float(odds) * np.sqrt(n), float(odds))
    best = sorted(found, key=lambda w: (-found[w][0], w))[:LEARNED]
    return {w: 1.5 for w in INSULTS.split()} | {w: found[w][1] for w in best}


class Trees:
    """Gradient-boosted regression trees of depth ``depth`` on binned features, logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 8.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = []
        for j in range(x.shape[1]):
            column = x[:, j]
            busy = column[column != 0] if (column == 0).mean() > 0.5 else column  # zero has a bin of its own
            self.edges.append(np.unique(np.r_[0.0, np.quantile(busy, steps)]) if len(busy) else np.array([0.0]))
        b = self.binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits = []  # for each node of each level: feature, bin
            for level in range(self.depth):
                count = 1 << level
                best_gain, best = np.zeros(count), np.tile([0, self.bins + 1], (count, 1))
                for j in range(x.shape[1]):
                    width = len(self.edges[j]) + 1
                    key = node * width + b[:, j]
                    gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                    hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs * 4 < self.least) | ((ht - hs) * 4 < self.least)] = 0
                    cut = gain.argmax(1)
                    better = gain[np.arange(count), cut] > best_gain + 1e-9
                    best_gain[better] = gain[np.arange(count), cut][better]
                    best[better] = np.stack([np.full(count, j), cut], 1)[better]
                splits.append(best)
                node = node * 2 + (b[np.arange(len(y)), best[node, 0]] > best[node, 1])
            leaves = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + 1)
            self.trees.append((splits, leaves))
            f += leaves[node]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for splits, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for best in splits:
                node = node * 2 + (b[rows, best[node, 0]] > best[node, 1])
            f += leaves[node]
        return f


class Isotonic:
    """A non-decreasing function by pooling adjacent violators, linear between pools."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # sum of y, number, sum of x
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            pools.append([b, 1, a])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                top = pools.pop()
                pools[-1] = [u + v for u, v in zip(pools[-1], top, strict=True)]
        self.x = np.array([p[2] / p[1] for p in pools])
        self.y = np.array([(p[0] + 0.02) / (p[1] + 0.04) for p in pools])
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


def _rows(texts: list[str | None], lexicon: dict[str, float]) -> np.ndarray:
    known = Words(lexicon)
    return np.concatenate([features(texts[i : i + 500], known) for i in range(0, len(texts), 500)])


def _parts(y: np.ndarray, n: int) -> np.ndarray:
    """A part of ``n`` for each row; rows of either label are dealt out evenly."""
    part = np.empty(len(y), np.int64)
    part[np.argsort(y, kind="stable")] = np.arange(len(y)) % n
    return part


def _held_out(x: np.ndarray, y: np.ndarray, part: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The margins of ``rows``, each part under trees fitted to all rows but that part."""
    margins = np.zeros(len(rows))
    for k in np.unique(part):
        seen = np.ones(len(y), bool)
        seen[rows[part == k]] = False
        margins[part == k] = Trees().fit(x[seen], y[seen]).margin(x[rows[part == k]])
    return margins


class ToxicityModel:
    def fit(self, texts: list[str | None], labels: list[int]) -> ToxicityModel:
        y = np.asarray(labels, float)
        self.lexicon, self.trees, self.steps = {}, None, None
        self.share = float(y.mean()) if len(y) else 0.0
        if len(set(labels)) < 2:
            return self
        part = np.random.Generator(np.random.PCG64(3)).permutation(len(y)) % 4
        fit, hold = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
        self.lexicon = lexicon_of([texts[i] for i in fit], y[fit])
        x = _rows(texts, self.lexicon)
        if len(set(y[hold])) == 2:
            # The learned words were picked on the rows of ``fit``: the trees learn how far to trust them from other rows.
            self.trees = Trees().fit(x, y)
            margins = _held_out(x, y, _parts(y[hold], 2), hold)
            self.steps = Isotonic().fit(margins, y[hold])
        else:
            self.trees = Trees().fit(x[fit], y[fit])
            part, margins = _parts(y, 4), np.zeros(len(y))
            for k in np.unique(part):  # no row is free of the learned words: each part gets words of its own
                seen = part != k
                own = _rows(texts, lexicon_of([t for t, s in zip(texts, seen, strict=True) if s], y[seen]))
                margins[~seen] = Trees().fit(own[seen], y[seen]).margin(own[~seen])
            self.steps = Isotonic().fit(margins, y)
        return self

    def score(self, texts: list[str | None], known: Words) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        f = self.trees.margin(features(texts, known))
        # The steps are flat; a thousandth of the margin keeps the order of the trees within a step.
        return np.clip(0.998 * self.steps(f) + 0.002 / (1 + np.exp(-f)), 0, 1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", label: str = "toxic", text: str = "text") -> ToxicityModel:
    """A model from ``labels`` (key, label), of which the ``sample`` rows of lowest hash are used, up to ``SAMPLE_BYTES`` of text."""
    got = learned_from(docs, labels, key, label, text, sample)
    return ToxicityModel().fit([t for t, _ in got], [y for _, y in got])


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text: 0 to 1, higher for toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes, whatever the input

    def make():
        m = held.value
        known = Words(m.lexicon)
        return lambda texts: [m.score(texts, known)]

    return appended(docs, [(score, T.DoubleType())], make, text)
