"""Byte-pair encoding and decoding of whole texts with a public vocabulary.

A text is cut at special tokens, then at single spaces between other characters, where no pre-token can span; pieces
met before come from a bounded memory. New pieces are cut by the public pattern and go through batched numpy rounds:
the symbols of many words lie in one flat array; in each round every word's lowest-ranked neighbouring pair, found by
binary search over the sorted pair keys, is joined wherever it stands. No word waits for another; each round works on
the words that still have a pair.

Null texts count as empty: no ids, decoded text "". Equal rows get equal results; a very long text is one row of one
slice, and its memory is a small multiple of its size. Pieces of more than ``LONG`` characters (texts without spaces,
encoded data) are forgotten after their slice, so that memories have a bound in bytes. An empty table gives an empty
one; a column named like the result is replaced, others pass through.
"""

from __future__ import annotations

import gc
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

from .common import LONG, appended

#: The public byte-level pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class BytePairCodec:
    """Encodes and decodes with a vocabulary file of the ``tokenizers`` JSON form (byte level, no normaliser)."""

    memory = 150_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.base = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left * size + right
        self.rank_of = np.argsort(keys, kind="stable")  # place in the sorted keys -> rank
        self.keys = keys[self.rank_of]
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.no_rank = len(pairs)
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.by_pattern = regex.compile(PATTERN).findall
        self.common = re.compile("[\\0-\u052f]*").fullmatch
        self.by_library = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.at_spaces = re.compile(r"(?<=\S) (?=\S)").split
        #: ids by piece: pieces that begin a text, pieces after a space; the same for texts with odd white space.
        self.plain: tuple[dict, dict] = ({}, {})
        self.odd: tuple[dict, dict] = ({}, {})
        self.words: dict[str, bytes] = {}
        self.passing: list[tuple[dict, str]] = []  # memories and what they hold for the current slice only
        first = self.ranks((self.base[:, None] * size + self.base[None, :]).ravel())
        self.first_ranks = first.reshape(256, 256)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank_of[at], self.no_rank)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit bytes, by batched merge rounds. Words are not empty."""
        out: list[bytes] = [b""] * len(words)
        if not words:
            return out
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.base[raw]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        which = np.arange(len(words))
        ranks = np.full(len(symbols), self.no_rank, np.int64)  # of each symbol with the next one of its word
        ranks[:-1] = self.first_ranks[raw[:-1], raw[1:]]
        ranks[np.cumsum(lengths) - 1] = self.no_rank
        while len(which):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(ranks, starts)
            over = best == self.no_rank
            word = np.repeat(np.arange(len(which)), lengths)
            over_here = over[word]
            done = symbols[over_here].astype("<u4").tobytes()
            at = 0
            for i, n in zip(which[over].tolist(), (lengths[over] * 4).tolist(), strict=True):
                out[i] = done[at : at + n]
                at += n
            if over.all():
                break
            hit = np.flatnonzero((ranks == best[word]) & ~over_here)
            # In a run of overlapping hits (a pair of equal symbols) every other one counts, from the left.
            new_run = np.ones(len(hit), bool)
            new_run[1:] = hit[1:] != hit[:-1] + 1
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            symbols[hit] = self.joined[ranks[hit]]
            keep = ~over_here
            keep[hit + 1] = False
            stale = np.zeros(len(symbols), bool)
            stale[hit] = True
            before = hit - 1
            before = np.where(keep[before], before, before - 1)  # what stands before may have been joined just now
            stale[before[hit > 0]] = True
            lengths = np.bincount(word[keep], minlength=len(which))[~over]
            symbols, which, ranks, stale = symbols[keep], which[~over], ranks[keep], stale[keep]
            last = np.cumsum(lengths) - 1
            ranks[last] = self.no_rank
            stale[last] = False
            again = np.flatnonzero(stale)
            ranks[again] = self.ranks(symbols[again] * self.size + symbols[again + 1])
        return out

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a piece. Beyond U+052F the classes of letters differ between versions of Unicode, so the
        library's own pattern engine cuts such pieces."""
        return self.by_pattern(text) if self.common(text) else [text[a:b] for _, (a, b) in self.by_library(text)]

    def learn(self, pieces: set[str], into: dict[str, bytes], lead: str) -> None:
        """Puts the ids of each piece into a memory."""
        known = self.words
        if len(known) > self.memory:
            known.clear()
        self.passing += [(into, p) for p in pieces if len(p) > LONG]
        plans = []
        for piece in pieces:
            if piece.isalpha() and self.common(piece):
                plans.append((piece, (lead + piece,)))
            elif piece[-1:] in (",", ".") and piece[:-1].isalpha() and self.common(piece):
                plans.append((piece, (lead + piece[:-1], piece[-1])))
            else:
                plans.append((piece, self.pretokens(lead + piece)))
        new = list({w for _, cuts in plans for w in cuts}.difference(known))
        known.update(zip(new, self.merge([w.encode() for w in new]), strict=True))
        self.passing += [(known, w) for w in new if len(w) > LONG]
        for piece, cuts in plans:
            into[piece] = known[cuts[0]] if len(cuts) == 1 else b"".join([known[w] for w in cuts])

    def pieces_of(self, part: str, odd: bool) -> list[str]:
        return self.at_spaces(part) if odd else part.split(" ")

    def encode_parts(self, parts: list[str], odd: bool = False) -> list[bytes]:
        """The ids of texts that are not empty and hold no special token.

        A space between two characters that are no white space always begins a pre-token, so that texts are cut there
        and pieces looked up. A cut beside other white space shows as a piece with white space at an end; such texts
        are cut anew (``odd``), with memories of their own.
        """
        first, after = self.odd if odd else self.plain
        for memory in (first, after):
            if len(memory) > self.memory:
                memory.clear()
        split = [self.pieces_of(p, odd) for p in parts]
        heads = [s.pop(0) for s in split]
        new_heads = set(heads).difference(first)
        new = set().union(*split).difference(after)
        again: dict[int, bytes] = {}
        if not odd:
            bad = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
            bad_heads = {p for p in new_heads if not p or p[0].isspace() or p[-1].isspace()}
            if bad or bad_heads:
                where = [i for i, s in enumerate(split) if heads[i] in bad_heads or not bad.isdisjoint(s)]
                again = dict(zip(where, self.encode_parts([parts[i] for i in where], odd=True), strict=True))
                new -= bad
                new_heads -= bad_heads
        self.learn(new_heads, first, "")
        self.learn(new, after, " ")
        get = after.__getitem__
        return [again[i] if i in again else first[h] + b"".join(map(get, s)) for i, (h, s) in enumerate(zip(heads, split, strict=True))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        collects = gc.isenabled()
        gc.disable()  # many small objects that all live on; searching them for cycles would take a quarter of the time
        try:
            return self._encode(texts)
        finally:
            for memory, piece in self.passing:
                memory.pop(piece, None)
            self.passing.clear()
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.cut:
            cuts = [[t] for t in texts]
        else:
            cuts = [self.cut.split(t) if any(x in t for x in self.special) else [t] for t in texts]
        parts = [p for c in cuts for p in c[::2] if p]
        ids = iter(self.encode_parts(parts))
        special = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        return [b"".join([special[p] if k % 2 else next(ids) if p else b"" for k, p in enumerate(c)]) for c in cuts]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec for each path and Python process."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``: the ids of each whole text as binary, little-endian unsigned 32-bit integers."""

    def make():
        c = codec(path)
        return lambda texts: [pa.array(c.encode([t or "" for t in texts]), pa.binary())]

    return appended(docs, [(ids, T.BinaryType())], make, text)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of binary ``ids`` (null: "")."""

    def make():
        c = codec(path)
        return lambda all_ids: [[c.decode(i or b"") for i in all_ids]]

    return appended(docs, [(text, T.StringType())], make, ids, spread=False)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each whole text, as by ``encode``, and the text that decoding those ids gives, as by ``decode``.

    Both are made in one Python worker. ``decode(encode(docs))`` has two of them in each task, each with a vocabulary and
    Arrow batches of its own, and Spark keeps idle workers beside those of later tasks.
    """

    def make():
        c = codec(path)

        def both(texts):
            encoded = c.encode([t or "" for t in texts])
            return [pa.array(encoded, pa.binary()), [c.decode(i) for i in encoded]]

        return both

    return appended(docs, [(ids, T.BinaryType()), (decoded, T.StringType())], make, text)
