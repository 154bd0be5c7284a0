"""Lookups of tile ids in entries: the nearest entry at or below an id, if it reaches so far.

Only the nearest one counts, so this is an as-of join and no interval join: an id that only an earlier, longer run
covers is not found. Of entries with one id the last one (by ``grp``) is taken.

Entries and probes are laid on one line and cut into ranges; inside a range a window carries the last entry forward, and
the last entry of all ranges before comes from a table of one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ranged, with_running
from .entries import ids_between

ENTRY = ["tile_id", "run_length", "offset", "length", "grp"]


def nearest(entries: DataFrame, probes: DataFrame, within: str | None = None) -> DataFrame:
    """probe_id, tile and ``entry``: the last entry at or below each probed tile, whether it reaches the tile or not;
    only entries that have the probe's ``within`` (a column of both, passed through), where it is given."""
    part = [within] if within else []
    of = {c: F.col(c).cast("long") for c in part}
    e = entries.select(*(c.alias(n) for n, c in of.items()), F.col("tile_id").alias("tile"), F.lit(0).alias("side"), F.col("grp").alias("tie"), F.struct(*ENTRY, *part).alias("e"), F.lit(None).cast("long").alias("probe_id"))
    probe_id = F.col("probe_id").cast("long")
    p = probes.select(*(c.alias(n) for n, c in of.items()), "tile", F.lit(1).alias("side"), probe_id.alias("tie"), F.lit(None).cast(e.schema["e"].dataType).alias("e"), probe_id.alias("probe_id"))
    order = [*part, "tile", "side", "tie"]
    line = with_running(ranged(e.unionByName(p), order), order, {"entry": (F.col("e"), True)}, "last")
    found = line.where("side = 1")
    if within:
        found = found.withColumn("entry", F.when(F.col("entry")[within] == F.col(within), F.col("entry")))
    return found.select("probe_id", "tile", *part, "entry")


def _reaches(e: Column) -> Column:
    return (e["run_length"] == 0) | (F.col("tile") - e["tile_id"] < e["run_length"]) | (F.col("tile") == e["tile_id"])


def _found(rows: DataFrame, *more: str) -> DataFrame:
    e = F.col("entry")
    reaches = _reaches(e)
    return rows.select("probe_id", "tile", *more, F.when(reaches, e["offset"]).alias("offset"), F.when(reaches, e["length"]).alias("length"), F.coalesce(reaches, F.lit(False)).alias("found"))


def lookup(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_id, tile, and offset and length where the tile is found (null elsewhere); leaf pointers count as found."""
    return _found(nearest(entries, probes))


def missing(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (tile) that a lookup does not find: runs are tested where they are, not expanded."""
    return lookup(entries, wanted.select("tile", F.col("tile").alias("probe_id"))).where("not found").select("tile")


def gaps(entries: DataFrame) -> DataFrame:
    """tile: the ids from 0 to the greatest covered one that no entry covers."""
    order = ["tile_id", "grp"]
    rows = ranged(entries.where("run_length > 0").select("tile_id", "grp", (F.col("tile_id") + F.col("run_length")).alias("end")), order)
    rows = with_running(rows, order, {"reached": (F.col("end"), False)}, "max")
    return ids_between("reached", "tile_id")(rows.select(F.coalesce("reached", F.lit(0).cast("long")).alias("reached"), "tile_id")).select("tile")


def two_level(entries: DataFrame, leaves: DataFrame, probes: DataFrame) -> DataFrame:
    """A lookup through leaves: probes find the leaf by its first id, then the entry inside that leaf, and only there.

    ``leaves``: leaf, first. ``entries`` carry their ``leaf``.
    """
    root = leaves.select(F.col("first").alias("tile_id"), F.lit(0).cast("long").alias("run_length"), F.col("leaf").cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), F.col("leaf").cast("long").alias("grp"))
    at = lookup(root, probes).select("probe_id", "tile", F.col("offset").alias("leaf"))
    return _found(nearest(entries, at, within="leaf"), "leaf")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """tile and change (added, removed, changed) between two tables of (tile, hash)."""
    a, b = left.select("tile", F.col("hash").alias("a")), right.select("tile", F.col("hash").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "tile", "full_outer").withColumn("change", change).where("change is not null").select("tile", "change")


def merge(*archives: DataFrame) -> DataFrame:
    """(tile, hash) of several archives; later ones win."""
    rows = None
    for i, a in enumerate(archives):
        a = a.select("tile", "hash").withColumn("rank", F.lit(i))
        rows = a if rows is None else rows.unionByName(a)
    return rows.groupBy("tile").agg(F.max_by("hash", "rank").alias("hash"))
