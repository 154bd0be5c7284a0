"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A window is ``size``
consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit.

The words of the items are ordered by rarity: by how many of the documents' words are that word. A window can only
occur where its rarest word does, so that word at its place in the window is the necessary prefix: document words join
windows on it. A candidate must lie within its document (positional and length bounds) and is then verified word by
word. Everything runs over flat arrays of word numbers of a slice of documents.

The index of the windows, flat arrays of some ten times the bytes of the items, is broadcast in blocks of at most
``block_bytes`` of different items' text (a longer item is a block by itself); beyond one block, documents are scanned
once for each block, and the hits of a document are joined before they are counted. The blocks do not change results.
Null texts have no words. Documents without hits, empty texts and an empty table of items give 0 and "". Very long texts
are one row like others. Items with a null id hit words, but are not listed; items that repeat are one, each document
row counts by itself. An empty table of documents gives an empty one. ``marked`` returns its own columns only; ``clean``
looks at no column but the text and passes all through.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import evenly, slices

#: Items of one broadcast index, by the bytes of their texts. A single longer item is a block of its own.
BLOCK_BYTES = 8 << 20

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class Numbers(dict):
    """Word to its number among the items' words, 0 for any other word."""

    def __missing__(self, word: bytes) -> int:
        return 0


def vocabulary(items: list[tuple]) -> list[bytes]:
    return sorted({w for _, text in items for w in words_of(text)})


def frequencies(docs: DataFrame, words: list[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each of ``words`` occurs in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(words)  # within the bound of the block

    def run(batches):
        wanted, n = frozenset(held.value), Counter()
        for part in slices(batches, text):
            n.update(filter(wanted.__contains__, chain.from_iterable(map(words_of, part.column(text).to_pylist()))))
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    got = docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in got}


class Index:
    """The windows of items, by their rarest word: for each length of window its words, sorted by the prefix word."""

    def __init__(self, items: list[tuple], size: int, counts: dict[bytes, int]):
        self.size = size
        words = vocabulary(items)
        self.number = Numbers({w: i + 1 for i, w in enumerate(words)})
        frequency = np.array([0, *(counts.get(w, 0) for w in words)], np.int64)
        texts = [np.array([self.number[w] for w in words_of(text)], np.int32) for _, text in items]
        n = np.array([len(t) for t in texts], np.int64)
        starts, flat = np.cumsum(n) - n, np.concatenate([np.zeros(0, np.int32), *texts])
        self.names = sorted({str(i) for i, _ in items if i is not None})
        rank = {name: i for i, name in enumerate(self.names)}
        owner_of = np.array([-1 if i is None else rank[str(i)] for i, _ in items], np.int64)
        self.parts = []  # one for each length of window: windows, place of the prefix word, windows by prefix word
        owners, base = [np.zeros((0, 2), np.int64)], 0
        for length in np.unique(np.minimum(n[n > 0], size)).tolist():
            own = np.flatnonzero(np.minimum(n, size) == length)
            many = n[own] - length + 1
            item = np.repeat(own, many)
            begin = starts[item] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            seqs, which = np.unique(flat[begin[:, None] + np.arange(length)], axis=0, return_inverse=True)
            place = frequency[seqs].argmin(1)  # the rarest word: the necessary prefix
            prefix = seqs[np.arange(len(seqs)), place]
            order = np.argsort(prefix, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            first = np.searchsorted(prefix[order], np.arange(len(words) + 2))
            self.parts.append((length, seqs[order], place[order], first, base))
            named = owner_of[item] >= 0
            owners.append(np.stack([base + number[which.ravel()[named]], owner_of[item[named]]], 1))
            base += len(seqs)
        pairs = np.unique(np.concatenate(owners), axis=0)
        self.owner = pairs[:, 1]
        self.owner_starts = np.searchsorted(pairs[:, 0], np.arange(base + 1))

    def items_of(self, doc: np.ndarray, window: np.ndarray) -> dict[int, list[str]]:
        """The ids of the items whose windows occur in each document, sorted as strings."""
        pairs = np.unique(doc * np.int64(max(len(self.owner_starts), 1)) + window)
        doc, window = np.divmod(pairs, max(len(self.owner_starts), 1))
        n = self.owner_starts[window + 1] - self.owner_starts[window]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.owner_starts[window], n)
        found: dict[int, list[str]] = {}
        for d, o in np.unique(np.stack([np.repeat(doc, n), self.owner[place]], 1), axis=0).tolist():
            found.setdefault(d, []).append(self.names[o])
        return found

    def hits(self, seq: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in documents laid end to end: begin, length and window, in no order."""
        out = []
        doc_end = starts[1:]
        for length, windows, place, first, base in self.parts:
            here = np.flatnonzero(first[seq + 1] > first[seq])
            here = here[seq[here] > 0]
            for at in range(0, len(here), 1 << 18):
                some = here[at : at + (1 << 18)]
                n = first[seq[some] + 1] - first[seq[some]]
                ends = np.cumsum(n)
                for lo, hi in _chunks(ends, 1 << 20):
                    m = n[lo:hi]
                    total = int(m.sum())
                    if not total:
                        continue
                    window = np.arange(total) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[seq[some[lo:hi]]], m)
                    position = np.repeat(some[lo:hi], m)
                    begin = position - place[window]
                    doc = np.searchsorted(doc_end, position, "right")
                    fits = (begin >= starts[doc]) & (begin + length <= doc_end[doc])
                    begin, window = begin[fits], window[fits]
                    for k in range(length):
                        same = seq[begin + k] == windows[window, k]
                        begin, window = begin[same], window[same]
                    out.append((begin, np.full(len(begin), length), window + base))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _chunks(ends: np.ndarray, most: int):
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The different items that have a text, in as many parts as the bound asks for."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct()
    size = F.octet_length("text") + 64
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = -(-total // block_bytes)
    if n <= 1:
        return [rows] if n else []
    while True:
        n *= 2
        block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        if rows.groupBy(block.alias("b")).agg(F.sum(size).alias("s"), F.count("*").alias("c")).where(f"s > {block_bytes} and c > 1").isEmpty():
            return [rows.where(block == i) for i in range(n)]


FIELDS = "n_words long, n_hit long, n_items long, items string"


def marked(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items and items (ids sorted as strings, comma-joined) of each document."""
    spark = docs.sparkSession
    few = evenly(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kind = few.schema["doc_id"].dataType.simpleString()
    indexes = []
    for block in _blocks(items, item_id, item_text, block_bytes):
        rows = [(r["item"], r["text"]) for r in block.collect()]  # the bound of a block
        indexes.append(spark.sparkContext.broadcast(Index(rows, size, frequencies(few, vocabulary(rows)))))
    if len(indexes) <= 1:
        return _scan(few, indexes[0] if indexes else None, kind)
    spans = None
    for index in indexes:
        found = _spans(few, index)
        spans = found if spans is None else spans.unionByName(found)
    by_text = spans.groupBy("key").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("ids"))
    key = F.sha2(F.col("text"), 256)
    joined = few.withColumn("key", key).join(by_text, "key", "left").select("doc_id", "text", "spans", "ids")
    return _counted(joined, kind)


def _slice(part: pa.RecordBatch, number: dict) -> tuple[np.ndarray, np.ndarray]:
    words = [words_of(t) for t in part.column("text").to_pylist()]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    return np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int32, starts[-1]), starts


def _scan(docs: DataFrame, held, kind: str) -> DataFrame:
    def run(batches):
        index = held.value if held else Index([], 1, {})
        for part in slices(batches):
            seq, starts = _slice(part, index.number)
            begin, length, window = index.hits(seq, starts)
            edge = np.zeros(len(seq) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + length, -1)
            hit = np.r_[0, np.cumsum(np.cumsum(edge)[:-1] > 0)]
            doc = np.searchsorted(starts[1:], begin, "right")
            found = index.items_of(doc, window)
            names = [found.get(d, []) for d in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(starts)), pa.array(hit[starts[1:]] - hit[starts[:-1]]), pa.array([len(n) for n in names], pa.int64()), pa.array([",".join(n) for n in names], pa.string())],
                ["doc_id", "n_words", "n_hit", "n_items", "items"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, {FIELDS}")


def _spans(docs: DataFrame, held) -> DataFrame:
    """For documents that one block's windows hit: the text's digest, spans (begins and ends in turn) and items."""

    def run(batches):
        import hashlib

        index = held.value
        for part in slices(batches):
            seq, starts = _slice(part, index.number)
            begin, length, window = index.hits(seq, starts)
            doc = np.searchsorted(starts[1:], begin, "right")
            keys, spans, names, found = [], [], [], index.items_of(doc, window)
            for d in np.unique(doc):
                own = doc == d
                b = begin[own] - starts[d]
                keys.append(hashlib.sha256(part.column("text")[int(d)].as_py().encode()).hexdigest())
                spans.append(np.unique(np.stack([b, b + length[own]], 1), axis=0).ravel().tolist())
                names.append(found.get(int(d), []))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["key", "spans", "items"])

    return docs.dropDuplicates(["text"]).mapInArrow(run, "key string, spans array<long>, items array<string>")


def _counted(joined: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        for part in slices(batches):
            n_words, n_hit = [], []
            for text, lists in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                n = len(words_of(text))
                edge = np.zeros(n + 1, np.int64)
                for spans in lists or ():
                    pairs = np.array(spans, np.int64).reshape(-1, 2)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
                n_words.append(n)
                n_hit.append(int((np.cumsum(edge)[:-1] > 0).sum()))
            names = [i or [] for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in names], pa.int64()), pa.array([",".join(i) for i in names], pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items"])

    return joined.mapInArrow(run, f"doc_id {kind}, {FIELDS}")


def clean(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item; columns as they are.

    One scan: rows are judged by their own text and dropped where they stand.
    """
    blocks = _blocks(items, item_id, item_text, BLOCK_BYTES)
    out = docs
    for block in blocks:
        rows = [(r["item"], r["text"]) for r in block.collect()]  # the bound of a block
        held = docs.sparkSession.sparkContext.broadcast(Index(rows, size, frequencies(docs.select(F.col(text).alias("text")), vocabulary(rows))))

        def run(batches, held=held):
            index = held.value
            for part in slices(batches, text):
                seq, starts = _slice(pa.RecordBatch.from_arrays([part.column(text)], ["text"]), index.number)
                begin, _, _ = index.hits(seq, starts)
                bad = np.zeros(part.num_rows, bool)
                bad[np.searchsorted(starts[1:], begin, "right")] = True
                yield part.filter(pa.array(~bad))

        out = out.mapInArrow(run, out.schema)
    return out


def digest(items: str = "items"):
    return F.sha2(F.col(items).cast("binary"), 256)


