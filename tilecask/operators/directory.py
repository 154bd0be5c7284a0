"""Directory coding as columns: chunks, deltas, elided and restored offsets. ``ordinal`` counts entries from 0.

Rows keep the ranges of the directory order (plans.ordered) from ``numbered`` on, so that they are cut once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import _RANGE, ranged, with_previous, with_running


def numbered(entries: DataFrame) -> DataFrame:
    """``entries`` with ``ordinal``: their place in directory order (tile_id, grp)."""
    return with_running(ranged(entries, ["tile_id", "grp"]), ["tile_id", "grp"], {"ordinal": (F.lit(1), False)})


def chunked(numbered_entries: DataFrame, leaf_size: int) -> DataFrame:
    return numbered_entries.withColumn("leaf", F.expr(f"ordinal div {leaf_size}"))


def leaves(chunks: DataFrame) -> DataFrame:
    """leaf, first id, number of entries, tiles."""
    return chunks.groupBy("leaf").agg(F.min("tile_id").alias("first"), F.count("*").alias("n"), F.sum("run_length").alias("tiles"))


def encoded(numbered_entries: DataFrame) -> DataFrame:
    """ordinal, delta, run_length, length, stored_offset (0: right after the entry before)."""
    rows = with_previous(ranged(numbered_entries, ["ordinal"]), ["ordinal"], ["tile_id", "offset", "length"])
    p = F.col("previous")
    follows = F.coalesce(F.col("offset") == p["offset"] + p["length"], F.lit(False))
    delta = (F.col("tile_id") - F.coalesce(p["tile_id"], F.lit(0))).alias("delta")
    return rows.select(_RANGE, "ordinal", delta, "run_length", "length", F.when(follows, 0).otherwise(F.col("offset") + 1).cast("long").alias("stored_offset"))


def decoded(coded: DataFrame) -> DataFrame:
    """ordinal, tile_id, run_length, offset, length: the inverse of ``encoded``."""
    rows = with_running(ranged(coded, ["ordinal"]), ["ordinal"], {"tile_id": (F.col("delta"), True), "before": (F.col("length"), False)})
    base = F.when(F.col("stored_offset") > 0, F.col("stored_offset") - 1 - F.col("before"))
    rows = with_running(rows, ["ordinal"], {"base": (base, True)}, "last", once=True)
    return rows.select("ordinal", "tile_id", "run_length", (F.col("base") + F.col("before")).alias("offset"), "length")


def first_leaf_size(n: int) -> int:
    return max(n // 3500, 4096)
