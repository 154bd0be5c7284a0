"""What the operators of this subpackage share: scratch tables, batches, word hashes and samples."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import evenly, forget, stored

__all__ = ["appended", "evenly", "fold", "forget", "hashed", "learned_from", "mixed", "segment_sums", "slices", "written"]

#: Rows are handed to numpy in slices of about so many bytes of text.
SLICE_BYTES = 1 << 20
#: Spark closes an Arrow batch at so many rows, or at 64 MB (``spark.sql.execution.arrow.maxBytesPerBatch``).
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_setting = threading.Lock()


def written(df: DataFrame, records: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, lineage cut; ``forget`` deletes it.

    While it is written, at most ``records`` rows (if given) go to Python in one Arrow batch; the session's own setting
    holds again afterwards, and for all that is read lazily.
    """
    spark = df.sparkSession
    if not records:
        return stored(df)
    with _setting:
        before = spark.conf.get(BATCH)
        try:
            spark.conf.set(BATCH, str(min(records, int(before)) if int(before) > 0 else records))
            return stored(df)
        finally:
            spark.conf.set(BATCH, before)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of at most about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(sizes.astype(float)) + 16)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def appended(docs: DataFrame, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list], list]], text: str = "text", spread: bool = True) -> DataFrame:
    """``docs`` (dealt out evenly where they are few, with ``spread``) with ``fields`` after its own columns; a column of the same name is replaced.

    ``make()`` runs once in each task and returns a function from the texts of a slice (``None`` for null) to one list
    or array per field. Other columns pass through untouched, whatever they are called.
    """
    names = {n.lower() for n, _ in fields}
    kept = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in names])
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        function = make()
        arrow = None
        for part in slices(batches, text):
            got = function(part.column(text).to_pylist())
            arrow = arrow or [_arrow_type(t) for _, t in fields]
            new = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(got, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(n for n, _ in fields)])

    return (evenly(kept) if spread else kept).mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Longer words (texts without spaces, encoded data) are not remembered: a memory of words has a bound in bytes.
LONG = 64


class WordHash(dict):
    """``bytes`` to a 64-bit hash, remembered; emptied at ``limit`` words so that its memory is bounded."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h


def hashed(words: list[list[bytes]], of: dict) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in one flat array, and where each list begins and the last one ends."""
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    flat = np.empty(starts[-1], np.uint64)
    get = of.__getitem__
    for i, w in enumerate(words):
        flat[starts[i] : starts[i + 1]] = np.fromiter(map(get, w), np.uint64, len(w))
    return flat, starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (fixed values: the public 64-bit murmur constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of ``values`` in each segment of ``starts``; empty segments give 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``: 0 to ``parts`` - 1, null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(parts)


#: The bytes of text of a training sample that come to the driver.
SAMPLE_BYTES = 64 << 20


def sample_of(docs: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """One row of ``docs`` for each row of ``keys``, which holds a key once and is cut to the ``n`` rows of lowest hash.

    ``n`` is the proven bound of what is broadcast: of rows with one key, each column's least value is taken.
    """
    few = keys.orderBy(F.xxhash64(F.col(key), F.lit(17)), F.col(key)).limit(n)
    rows = docs.join(F.broadcast(few), key)
    return rows.groupBy(*few.columns).agg(*[F.min(c).alias(c) for c in docs.columns if c != key])


def learned_from(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str, n: int, most: int = SAMPLE_BYTES) -> list[tuple[str | None, int]]:
    """Texts and labels of at most ``n`` rows and about ``most`` bytes, by lowest hash, in order of their key.

    An id with several labels has the highest, one with several texts the least. Null keys and labels are left out.
    """
    keys = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("__label"))
    rows = written(sample_of(docs.select(key, text), keys, key, n))
    size = F.coalesce(F.octet_length(text), F.lit(0)).alias("size")
    sizes = sorted((r["hash"], r[key], r["size"]) for r in rows.select(key, size, F.xxhash64(F.col(key), F.lit(17)).alias("hash")).collect())  # at most n numbers
    some, total = [], 0
    for _, k, s in sizes:
        total += s
        if some and total > most:
            break
        some.append(k)
    if len(some) < len(sizes):
        kept = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in some], f"{key} {rows.schema[key].dataType.simpleString()}")), key)
    else:
        kept = rows
    got = [(r[text], int(r["__label"])) for r in sorted(kept.collect(), key=lambda r: r[key])]
    forget(rows)
    return got
