"""Language identification by compression.

For each language a raw-content zstandard dictionary holds known text. Texts are made plain first: small letters, one
space for anything else in ASCII, a word that repeats the one before left out. A text is cut into chunks; every chunk is
compressed with each dictionary and the sizes are summed: the language of the smallest sum wins. The score is the share
of the winner in a softmax of the saved bytes per chunk; ``reliable`` is false where the margin over the runner-up is
below ``margin`` of the winner's size, and a caller may reject those.

Chunks end with whole texts, nothing is cut away, however long. Texts that are null or have no letter are ``und`` with
score 0 and not reliable; so is every text if nothing was learned. Ties go to the language that sorts first. Repeated
rows get equal results. An id that several rows of a language have is one learned document, with the least of their
texts. An empty table gives an empty one; columns named like the results (``lang_pred``, ``score``, ``reliable``) are
replaced, others pass through.

What is learned has a bound: ``SAMPLE`` documents of each language, of lowest hash, and of each of these its beginning,
so that a language's dictionary has ``DICTIONARY`` bytes.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended

#: Learned documents of lowest hash for each language, and the bytes of each language's dictionary at most.
SAMPLE, DICTIONARY = 120, 48 << 10
#: Every language is learned. So many at a time have their dictionaries ready; beyond that dictionaries become smaller,
#: so that all of them together have at most LANGUAGES * DICTIONARY bytes.
LANGUAGES = 200
#: Texts are scored in groups of at most so many sizes (texts times languages).
SIZES = 1 << 22
CHUNK = 2048
LEVEL = 3
MARGIN = 0.01


_MADE = pa.schema([("name", pa.string()), ("content", pa.binary())])
_PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: str) -> bytes:
    return b" ".join([w for w, _ in groupby(text.lower().encode().translate(_PLAIN).split())])


def content(texts: list[str], size: int = DICTIONARY) -> bytes:
    """A dictionary of up to ``size`` bytes: equal shares of the texts, the rest filled by the longest ones."""
    raw = [plain(t) for t in texts if t]
    if not raw:
        return b""
    share, picked, left = max(64, size // len(raw)), [], size
    for r in sorted(raw, key=len):
        piece = r[: min(max(share, left // max(1, len(raw) - len(picked))), left)]
        picked.append(piece)
        left -= len(piece)
    return b"\n".join(picked)


def dictionary_size(languages: int) -> int:
    return min(DICTIONARY, LANGUAGES * DICTIONARY // max(1, languages))


class CompressionClassifier:
    def __init__(self, contents: dict[str, bytes], margin: float = MARGIN):
        self.contents, self.margin = contents, margin
        self.names = sorted(contents)
        self.ready = self._squeezers(self.names) if len(self.names) <= LANGUAGES else None
        self.letter = re.compile(r"[^\W\d_]").search

    def _squeezers(self, names: list[str]) -> list:
        out = []
        for name in names:
            d = zstandard.ZstdCompressionDict(self.contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return out

    def _sizes(self, texts: list[str]) -> np.ndarray:
        """The summed sizes of each text with each language's dictionary."""
        raw = [plain(t) for t in texts]
        chunks = [[r[i : i + CHUNK] for i in range(0, len(r), CHUNK)] for r in raw]
        sizes = np.empty((len(texts), len(self.names)))
        for at in range(0, len(self.names), LANGUAGES):
            for j, f in enumerate(self.ready or self._squeezers(self.names[at : at + LANGUAGES]), at):
                sizes[:, j] = [sum(len(f(c)) for c in cs) for cs in chunks]
        return sizes

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = [("und", 0.0, False)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.letter(t)] if self.names else []
        rows = max(1, SIZES // max(1, len(self.names)))
        for at in range(0, len(known), rows):
            some = known[at : at + rows]
            for i, sizes in zip(some, self._sizes([texts[i] for i in some]), strict=True):
                order = np.argsort(sizes, kind="stable")
                best = sizes[order[0]]
                odds = np.exp(-(sizes - best) / max(best, 1) * 50)
                narrow = len(order) > 1 and (sizes[order[1]] - best) < self.margin * best
                out[i] = self.names[order[0]], float(1 / odds.sum()), not narrow
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.predict_all([text])[0]


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", margin: float = MARGIN) -> CompressionClassifier:
    """A classifier from the texts and languages of ``docs``: every language, a bounded number of documents of each."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text, F.xxhash64(key, F.lit(5)).alias("__h"))
    size = dictionary_size(known.select(lang).distinct().count())
    # Language and hash first, without texts: a window of narrow rows that finds the highest hash of each SAMPLE.
    ranked = known.select(lang, "__h").withColumn("__r", F.row_number().over(Window.partitionBy(lang).orderBy("__h")))
    cuts = ranked.where(F.col("__r") <= SAMPLE).groupBy(F.col(lang).alias("__lang")).agg(F.max("__h").alias("__cut"))
    # One text for each hash, so that an id that many rows repeat stays one row: at most SAMPLE rows of a language.
    few = known.join(F.broadcast(cuts), (F.col(lang) == F.col("__lang")) & (F.col("__h") <= F.col("__cut")), "left_semi")
    few = few.groupBy(F.col(lang).alias("name"), "__h").agg(F.min(text).alias("text"))

    def made(name: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"name": [name[0].as_py()], "content": [content(rows.sort_by("__h").column("text").to_pylist(), size)]}, _MADE)

    got = few.groupBy("name").applyInArrow(made, "name string, content binary").collect()
    return CompressionClassifier({r["name"]: bytes(r["content"]) for r in got}, margin)


def identified(docs: DataFrame, model: CompressionClassifier, text: str = "text", into: str = "lang_pred") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``reliable`` of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast((model.contents, model.margin))  # at most LANGUAGES * DICTIONARY bytes

    def make():
        m = CompressionClassifier(*held.value)
        return lambda texts: list(map(list, zip(*m.predict_all(texts), strict=True)))

    return appended(docs, [(into, T.StringType()), ("score", T.DoubleType()), ("reliable", T.BooleanType())], make, text)
