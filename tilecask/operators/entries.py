"""From tiles to directory entries: dedup, runs, offsets, statistics. All in DataFrame operations.

Input rows are (seq, tile_id, data) with unique ``seq``, the order of the calls. Empty data is left out. A run grows
while ids follow each other and the content stays the same. Contents are stored once, in the order of their first use.

What takes ``hashed`` rows takes those of ``lined`` too, which are cut into ranges of ``seq`` once for all operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dealt import dealt, mask
from ..plans.ordered import _RANGE, plain, ranged, with_previous, with_running
from ..plans.scratch import forget, stored

#: Runs are expanded in pieces of so many tiles: no array grows with the length of a run.
PIECE = 1 << 16


def content_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def hashed_tiles(tiles: DataFrame) -> DataFrame:
    """seq, tile_id, hash and length of the tiles that are not empty; payloads do not travel further."""
    return tiles.where(F.octet_length("data") > 0).select("seq", "tile_id", content_hash(F.col("data")).alias("hash"), F.octet_length("data").cast("long").alias("length"))


def lined(hashed: DataFrame) -> DataFrame:
    """``hashed`` in ranges of ``seq``. Payloads are hashed once: sampling for the ranges reads the narrow rows."""
    if _RANGE in hashed.columns:
        return hashed
    narrow = stored(hashed)
    line = ranged(narrow, ["seq"])
    forget(narrow)
    return line


def contents(hashed: DataFrame) -> DataFrame:
    """hash, first_seq, length and n_refs of each distinct content, with its offset."""
    once = hashed.groupBy("hash").agg(F.min("seq").alias("first_seq"), F.min("length").alias("length"), F.count("*").alias("n_refs"))
    return plain(with_running(ranged(once, ["first_seq"]), ["first_seq"], {"offset": (F.col("length"), False)}))


def marked(hashed: DataFrame) -> DataFrame:
    """``hashed`` with ``starts`` (a new entry begins here) and ``in_order`` (its id is above the one before)."""
    rows = with_previous(lined(hashed), ["seq"], ["tile_id", "hash"])
    p = F.col("previous")
    follows = (p["hash"] == F.col("hash")) & (F.col("tile_id") == p["tile_id"] + 1)
    return rows.withColumn("starts", ~F.coalesce(follows, F.lit(False))).withColumn("in_order", F.coalesce(F.col("tile_id") > p["tile_id"], F.lit(True))).drop("previous")


def runs(hashed: DataFrame) -> DataFrame:
    """grp (in call order), tile_id, run_length and hash of each entry."""
    return ordered_runs(hashed).drop("in_order")


def ordered_runs(hashed: DataFrame) -> DataFrame:
    """``runs``, and whether all tiles of the entry are ``in_order``."""
    rows = with_running(marked(hashed), ["seq"], {"grp": (F.col("starts").cast("long"), True)}, once=True)
    return plain(rows).groupBy("grp").agg(F.min("tile_id").alias("tile_id"), F.count("*").alias("run_length"), F.min("hash").alias("hash"), F.bool_and("in_order").alias("in_order"))


def entries(hashed: DataFrame) -> DataFrame:
    """tile_id, run_length, offset, length and grp of each entry. The directory order is (tile_id, grp).

    One content may belong to any share of the entries (the sea), so its entries are dealt over tasks.
    """
    line = lined(hashed)
    return located(stored(runs(line)), contents(line))


def located(run_rows: DataFrame, content_rows: DataFrame) -> DataFrame:
    """tile_id, run_length, offset, length and grp: runs with the place of their content (hash, offset, length)."""
    facts = run_rows.groupBy("hash").agg(mask("grp")).join(content_rows.select("hash", "offset", "length"), "hash")
    return dealt(run_rows, facts, ["hash"], "grp").select("tile_id", "run_length", "offset", "length", "grp")


def statistics(hashed: DataFrame) -> DataFrame:
    """One row: addressed tiles, entries, contents, clustered, data length."""
    line = lined(hashed)
    rows = plain(marked(line)).agg(F.count("*").alias("n_addressed_tiles"), F.coalesce(F.sum(F.col("starts").cast("long")), F.lit(0)).alias("n_tile_entries"), F.coalesce(F.bool_and("in_order"), F.lit(True)).alias("clustered"))
    once = line.groupBy("hash").agg(F.min("length").alias("length")).agg(F.count("*").alias("n_tile_contents"), F.coalesce(F.sum("length"), F.lit(0)).alias("data_length"))
    return rows.crossJoin(once)  # one row and one row


def ids_between(first: str, end: str, into: str = "tile"):
    """A function on DataFrames: one row, ``into``, for each id from ``first`` to before ``end``, a piece at a time."""

    def rows(df: DataFrame) -> DataFrame:
        last = F.col(end) - 1
        pieces = df.where(F.col(first) <= last).withColumn("__low", F.explode(F.sequence(F.col(first), last, F.lit(PIECE).cast("long"))))
        return pieces.withColumn(into, F.explode(F.sequence(F.col("__low"), F.least(last, F.col("__low") + (PIECE - 1))))).drop("__low")

    return rows


def expanded(entry_rows: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """One row, ``tile``, for each tile of each entry; from id ``low`` to ``high`` only where they are given."""
    first = F.col("tile_id") if low is None else F.greatest("tile_id", F.lit(low).cast("long"))
    end = F.col("tile_id") + F.col("run_length")
    end = end if high is None else F.least(end, F.lit(high + 1).cast("long"))
    rows = entry_rows.where("run_length > 0").withColumns({"__first": first, "__end": end})
    return ids_between("__first", "__end")(rows).drop("__first", "__end")


def approximate_size(entry_rows: DataFrame) -> DataFrame:
    """Bytes that the entries take in memory, 24 each."""
    return entry_rows.agg((F.count("*") * 24).alias("bytes"))
