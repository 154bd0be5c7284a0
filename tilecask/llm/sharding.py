"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Every row gets a global number (no gaps), the number goes through a keyed permutation of 0 .. n-1, and shard and slot
follow by arithmetic: position p lies in shard p mod shards, slot p div shards. So shard sizes differ by one row at
most, slots have no gaps, and where any row number lies can be computed, both ways, without looking at data.

The numbering is the order of (bucket, id, order columns), the bucket being the beginning of a digest of these: rows are
counted by bucket, the counts are summed up over a fixed number of buckets, and rows are numbered inside their bucket.
No sampling takes part, so a lost task recomputes the same numbers. Null ids sort first.

Rows equal in all columns are interchangeable: they are counted before they move and get consecutive numbers, so that
any share of the table may be one row again and again. All columns must be groupable and orderable; pass narrow rows.
An empty table gives an empty one. Columns of the names that are added (``row_number``, ``position``, ``shard``,
``slot``, in any case) are replaced; any others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Hexadecimal digits of the digest that name a bucket: 4,096 buckets, of a table of 30 billion rows 7 million each.
DIGITS = 3
ROUNDS = 6
#: Equal rows become rows again in pieces of so many.
PIECE = 1 << 16
ADDED = ("row_number", "position", "shard", "slot")


class Feistel:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network over the next even number of bits, with cycle walking.

    Images beyond n are permuted again until they fall below; the domain is under 4 n, so under 4 walks on average.
    """

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.keys = rng.integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << self.half) | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(numbers).astype(np.uint64)
        out = self._once(x, back)
        while (far := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def place(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def number(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, True)


def numbered(rows: DataFrame, id_col: str, order: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with a global number from 0, without gaps, and how many rows there are."""
    text = F.concat_ws(",", *(F.col(c).cast("string") for c in (id_col, *order)))
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("__copies"))
    keyed = written(once.withColumn("__bucket", F.substring(F.md5(text.cast("binary")), 1, DIGITS)))
    counts = keyed.groupBy("__bucket").agg(F.sum("__copies").alias("n"), F.max("__copies").alias("most")).collect()  # a row for each bucket
    base, total = [], 0
    for r in sorted(counts):
        base.append((r["__bucket"], total))
        total += r["n"]
    before = Window.partitionBy("__bucket").orderBy(id_col, *order, *(c for c in rows.columns if c not in (id_col, *order))).rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.sparkSession.createDataFrame(base or [("", 0)], "__bucket string, __start long")
    out = keyed.withColumn("__within", F.coalesce(F.sum("__copies").over(before), F.lit(0))).join(F.broadcast(starts), "__bucket")
    out = out.withColumn("__low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(PIECE).cast("long"))))
    if max((r["most"] for r in counts), default=0) > PIECE:
        out = out.repartition("__bucket", "__low")
    copy = F.explode(F.sequence(F.col("__low"), F.least(F.col("__copies"), F.col("__low") + PIECE) - 1))
    out = out.withColumn("__copy", copy).withColumn(number, (F.col("__start") + F.col("__within") + F.col("__copy")).cast("long"))
    return out.select(*rows.columns, number), total


def sharded(rows: DataFrame, id_col: str, order: list[str], shards: int, seed: int = 20240229) -> DataFrame:
    """``rows`` with ``row_number``, ``position``, ``shard`` and ``slot``."""
    out, total = numbered(rows.select(*[c for c in rows.columns if c.lower() not in ADDED]), id_col, order)

    @F.pandas_udf("long")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        permutation = Feistel(total, seed)
        for part in parts:
            yield pd.Series(permutation.place(part.to_numpy()))

    out = out.withColumn("position", place("row_number"))
    return out.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.expr(f"position div {shards}"))
