"""Substring dedup by seed and extend over winnowed anchors.

Words are runs of characters other than ASCII white space. A window is ``size`` consecutive words of one document. Each
word covered by a window whose words also begin somewhere in a document with a smaller id is removed.

Seeds. Of the k-word grams in a window, the one of lowest hash (the leftmost, if equal) is the window's anchor: it
follows from the window's words alone, so equal windows have equal anchors at equal places. Neighbouring windows mostly
share an anchor; one anchor with all windows that chose it is an occurrence, some 22 windows long at 50 words.

Extend. Occurrences meet on their anchor. First they are compared as far as they reach on both sides, by one hash of
all their words: if a smaller document has the same stretch, all its windows are repeats. Only where an anchor has
stretches that differ (at the ends of a repeat, around an edit) is one document per stretch, the smallest, extended
window by window: (anchor, window) meets with the least id. That is enough: the smallest document with a window is also
the smallest with its own stretch around it, so it is among them; and a larger document either shares a whole stretch
with a smaller one or is the smallest with its own.

Maximal repeats are the unions of what was found. Groups are reduced to a least id before rows move, so an anchor in a
third of all documents costs one row per task and is never paired with itself; joins back to the occurrences are
ordinary equi-joins whose large partitions Spark splits. Hashes are pairs of 64 bits.

The extension is by hashes of runs of words, first of a whole stretch, then of its windows: word by word from pair to
pair, an anchor in a third of all documents would make pairs without end.

Null ids count as larger than all ids (they lose words, but take none away). Rows with one id take nothing from each
other. Null and empty texts have no words; very long ones are one row like others. Input rows keep their number; repeated
rows get equal results. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, evenly, forget, hashed, mixed, slices, written

SIZE, GRAM = 50, 8
LAST = (1 << 63) - 1
#: An odd multiplier (fixed value) and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Rolling:
    """Hashes of runs of words by prefix sums modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if n > len(self.up):
            m = 1 << int(n).bit_length()
            for name, base in (("up", BASE), ("down", INVERSE)):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def sums(self, h: np.ndarray) -> np.ndarray:
        self.powers(len(h) + 1)
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mixed(h) * self.up[: len(h)], out=out[1:])
        return out

    def run(self, sums: np.ndarray, begin: np.ndarray, length) -> np.ndarray:
        """The hash of ``length`` words from each of ``begin``; it depends on the words and their number only."""
        return mixed((sums[begin + length] - sums[begin]) * self.down[begin] + np.asarray(length).astype(np.uint64))


def anchors(h: np.ndarray, starts: np.ndarray, rolling: Rolling, size: int, gram: int):
    """For all windows of documents laid end to end: begins, hash sums, the anchor's place and the hashes of grams."""
    sums = rolling.sums(h)
    none = np.zeros(0, np.int64)
    if len(h) < size:
        return none, sums, none, np.zeros(0, np.uint64)
    grams = rolling.run(sums, np.arange(len(h) - gram + 1), gram)
    length = np.diff(starts)
    n = np.maximum(length - size + 1, 0)
    begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[:-1], n)
    views = np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1)
    place = np.empty(len(begin), np.int64)
    for at in range(0, len(begin), 1 << 16):
        some = begin[at : at + (1 << 16)]
        place[at : at + (1 << 16)] = some + views[some].argmin(1)
    return begin, sums, place, grams


def occurrences(begin: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each run of windows with one anchor, and the number of windows of the run."""
    if not len(begin):
        return begin, begin
    new = np.ones(len(begin), bool)
    new[1:] = (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(begin)])


def _flat(part: pa.RecordBatch, known: WordHash):
    words = [words_of(t) for t in part.column("text").to_pylist()]
    return (words, *hashed(words, known))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _by_document(part: pa.RecordBatch, starts: np.ndarray, begin: np.ndarray, a: np.ndarray, h: np.ndarray):
    """Equal (a, h) of one document as one row: columns a, h, doc, th and at (their places in it, in order); and which
    of the given places each row was made from first."""
    doc = np.searchsorted(starts[1:], begin, "right")
    order = np.lexsort((begin, h, a, doc))
    new = np.ones(len(order), bool)
    for x in (doc[order], a[order], h[order]):
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~new[1:]
    edges = np.r_[np.flatnonzero(new), len(order)].astype(np.int32)
    first = order[edges[:-1]]
    at = pa.ListArray.from_arrays(pa.array(edges), pa.array((begin - starts[doc])[order].astype(np.int32)))
    row = pa.array(doc[first])
    return [_signed(a[first]), _signed(h[first]), part.column("doc").take(row), part.column("th").take(row), at], first


def _seeds(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """a, h (anchor and stretch), doc, th (the document row), at (first windows) and n (windows) of the occurrences.

    Occurrences of one stretch in one document are one row: a line that a document repeats makes no more rows.
    """

    def run(batches):
        known, rolling = WordHash(), Rolling()
        for part in slices(batches):
            _, h, starts = _flat(part, known)
            begin, sums, place, grams = anchors(h, starts, rolling, size, gram)
            first, n = occurrences(begin, place)
            b = begin[first]
            stretch = rolling.run(sums, b, n + size - 1)
            columns, of = _by_document(part, starts, b, grams[place[first]], stretch)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n[of].astype(np.int32))], ["a", "h", "doc", "th", "at", "n"])

    return docs.mapInArrow(run, "a long, h long, doc long, th long, at array<int>, n int")


def _windows(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """a, w (anchor and window), doc, th, at of the windows of the occurrences in ``open`` (begins and numbers in turn);
    equal windows of one document are one row."""

    def run(batches):
        known, rolling = WordHash(), Rolling()
        for part in slices(batches):
            _, h, starts = _flat(part, known)
            begin, sums, place, grams = anchors(h, starts, rolling, size, gram)
            spans = part.column("open").to_pylist()
            edge = np.zeros(len(h) + 1, np.int64)
            for d, s in enumerate(spans):
                pairs = np.array(s, np.int64).reshape(-1, 2)
                edge[starts[d] + pairs[:, 0]] += 1
                np.add.at(edge, starts[d] + pairs[:, 0] + pairs[:, 1], -1)
            some = np.cumsum(edge)[begin] > 0
            b, p = begin[some], place[some]
            columns, _ = _by_document(part, starts, b, grams[p], rolling.run(sums, b, size))
            yield pa.RecordBatch.from_arrays(columns, ["a", "w", "doc", "th", "at"])

    return rows.mapInArrow(run, "a long, w long, doc long, th long, at array<int>")


def _kept(rows: DataFrame, size: int) -> DataFrame:
    schema = T.StructType([rows.schema["rest"], rows.schema["text"], *T._parse_datatype_string("n_words long, n_removed long, kept_text string").fields])

    def run(batches):
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            total, removed, kept = [], [], []
            for text, whole, single in zip(texts, part.column("whole").to_pylist(), part.column("single").to_pylist(), strict=True):
                words = words_of(text)
                total.append(len(words))
                if whole or single:
                    edge = np.zeros(len(words) + 1, np.int64)
                    pairs = np.array(whole or [], np.int64).reshape(-1, 2)
                    alone = np.array(single or [], np.int64)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 0] + pairs[:, 1] + size - 1, -1)
                    np.add.at(edge, alone, 1)
                    np.add.at(edge, alone + size, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("rest"), part.column("text"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["rest", "text", "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the kept words joined by one space) of each document; columns of
    these names are replaced.

    ``gram`` is at most ``size``; ids are integers.
    """
    new = ["n_words", "n_removed", "kept_text"]
    own = [c for c in docs.columns if c.lower() not in new]
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own) if c != text))
    keyed = docs.select(rest.alias("rest"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("th"))
    seeds = written(_seeds(evenly(keyed.where(F.col("text").isNotNull()).select("doc", "th", "text")), size, gram))
    # The least document of each stretch, and how many stretches an anchor has; what stands in one document only goes.
    stretches = seeds.groupBy("a", "h").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    of_anchor = stretches.groupBy("a").agg(F.count("*").alias("kinds"), F.min("least").alias("a0"), F.max("most").alias("a1")).where("a0 < a1")
    shared = written(stretches.join(of_anchor, "a").where("least < most or kinds > 1").select("a", "h", "least", (F.col("kinds") > 1).alias("open")))
    met = seeds.join(shared, ["a", "h"]).where("least < doc or open")
    pair = F.flatten(F.transform("at", lambda at: F.array(at, F.col("n"))))
    by_doc = met.groupBy("doc", "th").agg(
        F.flatten(F.collect_set(F.when(F.col("least") < F.col("doc"), pair))).alias("whole"), F.flatten(F.collect_set(F.when(F.col("least") == F.col("doc"), pair))).alias("open")
    )
    by_doc = written(by_doc)
    forget(seeds, shared)
    opened = keyed.select("doc", "th", "text").join(by_doc.where(F.size("open") > 0).select("doc", "th", "open"), ["doc", "th"])
    windows = written(_windows(opened, size, gram), records=2000)
    least = windows.groupBy("a", "w").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    single = windows.join(least, ["a", "w"]).where("least < doc").groupBy("doc", "th").agg(F.flatten(F.collect_set("at")).alias("single"))
    found = by_doc.where(F.size("whole") > 0).select("doc", "th", "whole").join(single, ["doc", "th"], "full_outer")
    out = _kept(keyed.join(found, ["doc", "th"], "left").select("rest", "text", "whole", "single"), size)
    return out.select(*(F.col("text" if c == text else f"rest.c{i}").alias(c) for i, c in enumerate(own)), *new)
