"""Tile coordinates and ids as column expressions.

An id counts the tiles of a pyramid level by level, along a Hilbert curve in each level. ``tile_id`` and ``tile_zxy`` are
pure SQL folds; ``tile_id_bulk`` and ``tile_zxy_bulk`` are the same in numpy, for large columns. Null in, null out.
Strict versions raise on invalid input; the others give null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ZOOM = 31


def pyramid_size(z: int) -> int:
    """The number of tiles before zoom ``z``."""
    return ((1 << 2 * z) - 1) // 3


MAX_TILE_ID = pyramid_size(MAX_ZOOM + 1) - 1
_SIZES = np.array([pyramid_size(z) for z in range(MAX_ZOOM + 1)], np.int64)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def pyramid_base(z) -> Column:
    """The first id of zoom ``z`` (0 to 31)."""
    return F.call_function("div", F.call_function("shiftleft", F.lit(1).cast("long"), (_c(z) * 2).cast("int")) - 1, F.lit(3).cast("long"))


def is_coordinate(z, x, y) -> Column:
    z, x, y = _c(z), _c(x).cast("long"), _c(y).cast("long")
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.least(z, F.lit(MAX_ZOOM))).cast("int"))
    return (z >= 0) & (z <= MAX_ZOOM) & (x >= 0) & (x < side) & (y >= 0) & (y < side)


def is_tile_id(tile) -> Column:
    return _c(tile).between(0, MAX_TILE_ID)


def tile_id(z, x, y) -> Column:
    """The id of (z, x, y), null for what is no coordinate."""
    z, x, y = _c(z).cast("int"), _c(x).cast("long"), _c(y).cast("long")
    one = F.lit(1).cast("long")

    def step(acc, i):
        s = F.call_function("shiftleft", one, i)
        rx = F.when(acc["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        ry = F.when(acc["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        d = acc["d"] + s * s * (rx * 3).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - acc["x"].bitwiseAND(s - 1)).otherwise(acc["x"]), F.when(flip, s - 1 - acc["y"].bitwiseAND(s - 1)).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    levels = F.when(z > 0, F.sequence(F.greatest(z - 1, F.lit(0)), F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("d"))
    return F.when(is_coordinate(z, x, y), pyramid_base(z) + F.aggregate(levels, start, step, lambda a: a["d"]))


def tile_zoom(tile) -> Column:
    """The zoom of an id: the last level whose first id is not above it."""
    t = _c(tile).cast("long")
    ladder = F.when(t < int(_SIZES[1]), 0)
    for z in range(1, MAX_ZOOM):
        ladder = ladder.when(t < int(_SIZES[z + 1]), z)
    return F.when(is_tile_id(t), ladder.otherwise(MAX_ZOOM))


def tile_zxy(tile) -> Column:
    """struct<z, x, y> of an id, null for what is no id."""
    t = _c(tile).cast("long")
    z = tile_zoom(t)
    one = F.lit(1).cast("long")

    def step(acc, i):
        s = F.call_function("shiftleft", one, i)
        rx = F.shiftright(acc["t"], 1).bitwiseAND(one)
        ry = acc["t"].bitwiseXOR(rx).bitwiseAND(one)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - acc["x"]).otherwise(acc["x"]), F.when(flip, s - 1 - acc["y"]).otherwise(acc["y"])
        nx, ny = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct((nx + s * rx).alias("x"), (ny + s * ry).alias("y"), F.shiftright(acc["t"], 2).alias("t"))

    levels = F.when(z > 0, F.sequence(F.lit(0), F.greatest(z - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("x"), zero.alias("y"), (t - pyramid_base(z)).alias("t"))
    return F.when(is_tile_id(t), F.aggregate(levels, start, step, lambda a: F.struct(z.alias("z"), a["x"].alias("x"), a["y"].alias("y"))))


def strict_tile_id(z, x, y) -> Column:
    says = F.concat(F.lit("InvalidCoordinate: "), F.concat_ws(",", _c(z), _c(x), _c(y)))
    return F.when(F.coalesce(is_coordinate(z, x, y), F.lit(False)), tile_id(z, x, y)).otherwise(F.raise_error(says).cast("long"))


def strict_tile_zxy(tile) -> Column:
    return F.when(F.coalesce(is_tile_id(tile), F.lit(False)), tile_zxy(tile)).otherwise(F.raise_error(F.concat(F.lit("InvalidTileId: "), _c(tile))).cast("struct<z:int,x:bigint,y:bigint>"))


def ids_of(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ids of valid coordinates."""
    z, x, y = z.astype(np.int64), x.astype(np.int64).copy(), y.astype(np.int64).copy()
    d = np.zeros(len(z), np.int64)
    for level in range(int(z.max(initial=0)) - 1, -1, -1):
        on, s = z > level, np.int64(1 << level)
        rx, ry = (x & s > 0) & on, (y & s > 0) & on
        d += np.where(on, s * s * ((3 * rx.astype(np.int64)) ^ ry), 0)
        flip, swap = on & ~ry & rx, on & ~ry
        x, y = np.where(flip, (s - 1) - (x & (s - 1)), x), np.where(flip, (s - 1) - (y & (s - 1)), y)
        x, y = np.where(swap, y, x), np.where(swap, x, y)
    return d + _SIZES[z]


def zxy_of(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of valid ids."""
    tile = tile.astype(np.int64)
    z = np.searchsorted(_SIZES, tile, "right") - 1
    t = tile - _SIZES[z]
    x, y = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    for level in range(int(z.max(initial=0))):
        on, s = z > level, np.int64(1 << level)
        rx = (t >> 1) & 1
        ry = (t ^ rx) & 1
        flip, swap = (ry == 0) & (rx == 1), ry == 0
        fx, fy = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        nx, ny = np.where(swap, fy, fx) + s * rx, np.where(swap, fx, fy) + s * ry
        x, y, t = np.where(on, nx, x), np.where(on, ny, y), np.where(on, t >> 2, t)
    return z, x, y


@F.pandas_udf(T.LongType())
def _ids(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    fine = (z.notna() & x.notna() & y.notna()).to_numpy()
    zz, xx, yy = (np.where(fine, v.fillna(0).to_numpy(), 0).astype(np.int64) for v in (z, x, y))
    side = np.int64(1) << np.clip(zz, 0, MAX_ZOOM)
    fine &= (zz >= 0) & (zz <= MAX_ZOOM) & (xx >= 0) & (xx < side) & (yy >= 0) & (yy < side)
    return pd.Series(ids_of(*(np.where(fine, v, 0) for v in (zz, xx, yy)))).astype("Int64").mask(~fine)


@F.pandas_udf(T.StructType([T.StructField("z", T.IntegerType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))
def _zxy(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in parts:
        z, x, y = zxy_of(t.to_numpy())
        yield pd.DataFrame({"z": z.astype(np.int32), "x": x, "y": y})


def tile_id_bulk(z, x, y) -> Column:
    """``tile_id`` in numpy over Arrow batches."""
    return _ids(_c(z).cast("long"), _c(x).cast("long"), _c(y).cast("long"))


def tile_zxy_bulk(tile) -> Column:
    """``tile_zxy`` in numpy over Arrow batches."""
    return F.when(is_tile_id(tile), _zxy(F.coalesce(F.when(is_tile_id(tile), _c(tile)), F.lit(0)).cast("long")))
