"""The byte level: compression, varints, header and directories. Plain Python and numpy, no Spark."""

from __future__ import annotations

import gzip
import importlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np

from .. import errors as E
from .codes import COMPRESSIONS, SCALE, TILE_TYPES

#: Fixed values of the format.
MAGIC = b"PMTiles"
HEADER_SIZE = 127
INITIAL_READ = 16_384
ROOT_BUDGET = INITIAL_READ - HEADER_SIZE
NAMES = {c: n for c, n, _ in COMPRESSIONS}
CODES = {n: c for c, n, _ in COMPRESSIONS}
TYPE_NAMES = {c: n for c, n, _ in TILE_TYPES}
TYPE_CODES = {n: c for c, n, _ in TILE_TYPES}


def _brotli():
    try:
        return importlib.import_module("brotli")
    except ImportError as e:
        raise E.UnsupportedCompression("Brotli: its module is not installed") from e


def compression_of(codec: str) -> str:
    """The compression whose code a codec's output has in the header. A codec is the name of a compression, with
    ``=module:callable`` after it where a function of one's own makes it."""
    name = codec.partition("=")[0]
    if name not in CODES:
        raise E.UnsupportedCompression(f"{codec}: say which compression it is, as in Zstd=module:callable")
    return name


def compressor(codec: str, level: int | None = None) -> Callable[[bytes], bytes]:
    """The compressor of a codec."""
    name, _, own = codec.partition("=")
    compression_of(codec)
    if own:
        module, _, attribute = own.partition(":")
        return getattr(importlib.import_module(module), attribute)
    if name == "None":
        return bytes
    if name == "Gzip":
        return lambda data: gzip.compress(data, 6 if level is None else level, mtime=0)
    if name == "Zstd":
        zstandard = importlib.import_module("zstandard")
        return zstandard.ZstdCompressor(level=3 if level is None else level).compress
    if name == "Brotli":
        module = _brotli()
        return lambda data: module.compress(data, quality=11 if level is None else level)
    raise E.UnsupportedCompression(name)


def decompress(name: str, data: bytes) -> bytes:
    if name == "None":
        return bytes(data)
    try:
        if name == "Gzip":
            return gzip.decompress(data)
        if name == "Zstd":
            zstandard = importlib.import_module("zstandard")
            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        if name == "Brotli":
            return _brotli().decompress(data)
    except (OSError, EOFError, zlib.error) as e:
        raise E.ReadingError(str(e)) from e
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            raise E.ReadingError(str(e)) from e
        raise
    raise E.UnsupportedCompression(name)


def encode_varints(values: np.ndarray) -> bytes:
    """Unsigned LEB128 of all values, in order."""
    v = np.asarray(values).astype(np.uint64)
    if not len(v):
        return b""
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += (v >> np.uint64(7 * k)) > 0
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max())):
        some = n > k
        byte = (v[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[some] + k] = byte | np.where(n[some] > k + 1, 128, 0).astype(np.uint64)
    return out.tobytes()


def decode_varints(data: bytes, most: int | None = None) -> tuple[np.ndarray, int]:
    """Values from the front of ``data`` (at most ``most``), and the bytes that they took."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    if most is not None:
        ends = ends[:most]
    if not len(ends):
        return np.zeros(0, np.uint64), 0
    begins = np.r_[0, ends[:-1]]
    n = ends - begins
    if n.max() > 10:
        raise E.InvalidEntry("a varint is longer than 10 bytes")
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(n.max())):
        some = n > k
        out[some] |= (raw[begins[some] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out, int(ends[-1])


def encode_directory(tile_id, offset, length, run_length) -> bytes:
    """Entries in id order: their number, id deltas, run lengths, lengths, offsets (0: right after the one before)."""
    ids, off, size, run = (np.asarray(x, np.int64) for x in (tile_id, offset, length, run_length))
    if len(size) and (size.max() >= 1 << 32 or run.max() >= 1 << 32):
        raise E.IndexEntryOverflow("a length does not fit 32 bits")
    deltas = np.diff(ids, prepend=0)
    follows = np.zeros(len(ids), bool)
    follows[1:] = off[1:] == off[:-1] + size[:-1]
    return encode_varints(np.r_[np.array([len(ids)], np.int64), deltas, run, size, np.where(follows, 0, off + 1)])


class Directory(dict):
    """Entries as arrays: tile_id, offset, length and run_length."""

    def __repr__(self) -> str:
        return f"Directory [entries: {len(self['tile_id'])}]"


def decode_directory(data: bytes) -> Directory:
    """tile_id, offset, length and run_length arrays. Trailing bytes are ignored."""
    head, used = decode_varints(data[:10], 1)
    if not used:
        raise E.InvalidEntry("no number of entries")
    n = int(head[0])
    if n * 4 > len(data) - used:
        raise E.InvalidEntry(f"{n} entries do not fit {len(data) - used} bytes")
    values, _ = decode_varints(data[used:], 4 * n)
    if len(values) < 4 * n:
        raise E.InvalidEntry("the directory ends early")
    deltas, run, size, stored = values.reshape(4, n).astype(np.int64) if n else np.zeros((4, 0), np.int64)
    if n and stored[0] == 0:
        raise E.InvalidEntry("the first offset follows nothing")
    # Offsets run on from the last stored one by the lengths in between.
    total = np.r_[0, np.cumsum(size)]
    last = np.maximum.accumulate(np.where(stored > 0, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    offset = stored[last] - 1 + total[:-1] - total[last] if n else stored
    return Directory(tile_id=np.cumsum(deltas), offset=offset, length=size, run_length=run)


def find(directory: dict[str, np.ndarray], tile: int) -> int | None:
    """The place of the entry that holds ``tile`` or leads to it: the last one not above it, if it reaches so far."""
    at = int(np.searchsorted(directory["tile_id"], tile, "right")) - 1
    if at < 0:
        return None
    run, first = int(directory["run_length"][at]), int(directory["tile_id"][at])
    return at if tile == first or run == 0 or tile - first < run else None


def e7(degrees: float) -> int:
    """Rounded half away from zero, clamped; NaN is 0."""
    scaled = degrees * SCALE
    if scaled != scaled:
        return 0
    scaled = max(min(scaled, 2147483647.0), -2147483648.0)
    return int(scaled + 0.5) if scaled >= 0 else -int(-scaled + 0.5)


_LAYOUT = struct.Struct("<7sB11QBBBBBBiiiiBii")


@dataclass
class Header:
    version: int = 3
    root_offset: int = HEADER_SIZE
    root_length: int = 0
    metadata_offset: int = INITIAL_READ
    metadata_length: int = 0
    leaf_offset: int = 0
    leaf_length: int = 0
    data_offset: int = 0
    data_length: int = 0
    n_addressed_tiles: int | None = None
    n_tile_entries: int | None = None
    n_tile_contents: int | None = None
    clustered: bool = True
    internal_compression: str = "Gzip"
    tile_compression: str = "None"
    tile_type: str = "Unknown"
    min_zoom: int = 0
    max_zoom: int = 22
    min_longitude: float = -180.0
    min_latitude: float = -85.051129
    max_longitude: float = 180.0
    max_latitude: float = 85.051129
    center_zoom: int = 0
    center_longitude: float = 0.0
    center_latitude: float = 0.0

    def encode(self) -> bytes:
        return _LAYOUT.pack(
            MAGIC, self.version, self.root_offset, self.root_length, self.metadata_offset, self.metadata_length, self.leaf_offset, self.leaf_length, self.data_offset, self.data_length,
            self.n_addressed_tiles or 0, self.n_tile_entries or 0, self.n_tile_contents or 0, int(self.clustered), CODES[self.internal_compression], CODES[self.tile_compression], TYPE_CODES[self.tile_type],
            self.min_zoom, self.max_zoom, e7(self.min_longitude), e7(self.min_latitude), e7(self.max_longitude), e7(self.max_latitude), self.center_zoom, e7(self.center_longitude), e7(self.center_latitude),
        )

    def row(self) -> dict:
        return asdict(self)


def decode_header(data: bytes) -> Header:
    if len(data) < len(MAGIC):
        raise E.InvalidHeader(f"{len(data)} bytes")
    if data[: len(MAGIC)] != MAGIC:
        raise E.UnsupportedVersion(repr(data[:8])) if data[:2] == MAGIC[:2] else E.InvalidMagicNumber(repr(data[:7]))
    if len(data) < HEADER_SIZE:
        raise E.InvalidHeader(f"{len(data)} bytes")
    _, version, *rest = _LAYOUT.unpack(data[:HEADER_SIZE])
    numbers, (clustered, internal, tile, kind, low, high, *corners, center_zoom, lon, lat) = rest[:11], rest[11:]
    if max(numbers) >= 1 << 63:
        raise E.InvalidHeader("a number does not fit 63 bits")
    for code in (internal, tile):
        if code not in NAMES:
            raise E.InvalidCompression(str(code))
    if kind not in TYPE_NAMES:
        raise E.InvalidTileType(str(kind))
    return Header(version, *numbers[:8], *(n or None for n in numbers[8:]), clustered == 1, NAMES[internal], NAMES[tile], TYPE_NAMES[kind], low, high, *(c / SCALE for c in corners), center_zoom, lon / SCALE, lat / SCALE)
