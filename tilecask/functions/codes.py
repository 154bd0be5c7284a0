"""Compression and tile type codes, and fixed-point coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: code, name, content encoding.
COMPRESSIONS = [(0, "Unknown", None), (1, "None", None), (2, "Gzip", "gzip"), (3, "Brotli", "br"), (4, "Zstd", "zstd")]
#: Fixed values of the format: code, name, MIME type.
TILE_TYPES = [
    (0, "Unknown", "application/octet-stream"),
    (1, "Mvt", "application/vnd.mapbox-vector-tile"),
    (2, "Png", "image/png"),
    (3, "Jpeg", "image/jpeg"),
    (4, "Webp", "image/webp"),
    (5, "Avif", "image/avif"),
    (6, "Mlt", "application/vnd.maplibre-vector-tile"),
]
SCALE = 10_000_000


def _pick(value: Column, rows: list[tuple], key: int, out: int, error: str | None) -> Column:
    case = F.lit(None).cast("string")
    for row in rows:
        case = F.when(value == row[key], F.lit(row[out])).otherwise(case)
    if error:
        known = value.isin([r[key] for r in rows])
        case = F.when(value.isNull() | known, case).otherwise(F.raise_error(F.concat(F.lit(f"{error}: "), value.cast("string"))).cast("string"))
    return case


def compression_name(code: Column, strict: bool = True) -> Column:
    return _pick(code, COMPRESSIONS, 0, 1, "InvalidCompression" if strict else None)


def content_encoding(name: Column) -> Column:
    return _pick(name, COMPRESSIONS, 1, 2, None)


def tile_type_name(code: Column, strict: bool = True) -> Column:
    return _pick(code, TILE_TYPES, 0, 1, "InvalidTileType" if strict else None)


def content_type(name: Column) -> Column:
    return _pick(name, TILE_TYPES, 1, 2, None)


def from_e7(value: Column) -> Column:
    """Degrees of a stored coordinate."""
    return value / F.lit(float(SCALE))


def to_e7(degrees: Column) -> Column:
    """The stored coordinate: times 10^7, rounded half away from zero, clamped to 32 bits; NaN is 0."""
    scaled = F.nanvl(degrees.cast("double") * SCALE, F.lit(0.0))
    away = F.signum(scaled) * F.floor(F.abs(F.greatest(F.least(scaled, F.lit(3e9)), F.lit(-3e9))) + 0.5)
    return F.greatest(F.least(away, F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int")


def bounds(header: Column) -> Column:
    return F.array(*(header[c] for c in ("min_longitude", "min_latitude", "max_longitude", "max_latitude")))


def center(header: Column) -> Column:
    return F.struct(header["center_longitude"].alias("longitude"), header["center_latitude"].alias("latitude"), header["center_zoom"].alias("zoom"))
