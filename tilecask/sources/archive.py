"""One archive: header, metadata, directories and tiles over byte ranges."""

from __future__ import annotations

import importlib
import json
import threading
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np

from .. import errors as E
from ..functions import codec
from ..functions.codec import Directory
from ..functions.tiles import MAX_TILE_ID, ids_of
from .ranges import Ranges, open_ranges

#: A lookup consults at most so many leaf directories; a scan goes no deeper.
LEAF_LEVELS = 6


class NoCache:
    """Directories by their absolute offset. Not to be shared between archives. Errors are not kept.

    Subclass this, with ``get``, for another kind of cache.
    """

    def get(self, offset: int, fetch: Callable[[], Directory]) -> Directory:
        return fetch()


class DictCache(NoCache):
    """Every directory that was read."""

    def __init__(self):
        self.kept: dict[int, Directory] = {}

    def get(self, offset: int, fetch: Callable[[], Directory]) -> Directory:
        if offset not in self.kept:
            self.kept[offset] = fetch()
        return self.kept[offset]


class LruCache(NoCache):
    """The ``most`` directories used last. Threads that ask for one directory at a time fetch it once; a failed fetch is a
    ``DirectoryCacheError``."""

    def __init__(self, most: int = 64):
        self.most, self.kept, self.flights, self.lock = most, OrderedDict(), {}, threading.Lock()

    def get(self, offset: int, fetch: Callable[[], Directory]) -> Directory:
        with self.lock:
            flight = self.flights.setdefault(offset, threading.Lock())
        with flight:
            with self.lock:
                if offset in self.kept:
                    self.kept.move_to_end(offset)
                    return self.kept[offset]
            try:
                got = fetch()
            except E.ArchiveError as e:
                raise E.DirectoryCacheError(f"directory at {offset}: {e.error_class}: {e}") from e
            with self.lock:
                self.kept[offset] = got
                while len(self.kept) > self.most:
                    self.flights.pop(self.kept.popitem(last=False)[0], None)
            return got


CACHES = {"none": NoCache, "dict": DictCache, "lru": LruCache}


def make_cache(kind: str) -> NoCache:
    """A cache by its name, or by ``module:callable``."""
    if ":" in kind:
        module, _, attribute = kind.partition(":")
        return getattr(importlib.import_module(module), attribute)()
    return CACHES[kind]()


class Archive:
    """Opens with one read: header and root directory lie in the first 16 KiB. With ``head`` (those bytes) and their
    ``version`` it opens without a read; of a ``head`` that is the header alone the root is empty, leaves can be read."""

    def __init__(self, source: Ranges | str, cache: NoCache | None = None, head: bytes | None = None, version: str | None = None):
        self.source = open_ranges(source) if isinstance(source, str) else source
        self.cache = cache or NoCache()
        self.head, self.version = (head, version) if head is not None else self.source.read(0, codec.INITIAL_READ)
        self.header = h = codec.decode_header(self.head)
        if head is not None and len(head) == codec.HEADER_SIZE:
            self.root = codec.decode_directory(b"\0")
            return
        if h.root_offset < codec.HEADER_SIZE or h.root_offset + h.root_length > len(self.head):
            raise E.InvalidHeader("the root directory is not in the first 16 KiB")
        self.root = self._decode(self.head[h.root_offset : h.root_offset + h.root_length])

    def _decode(self, data: bytes) -> Directory:
        return codec.decode_directory(codec.decompress(self.header.internal_compression, data))

    def _read(self, offset: int, length: int) -> bytes:
        data, version = self.source.read_exact(offset, length)
        if version is not None and self.version is not None and version != self.version:
            raise E.SourceModified(f"{self.version} became {version}")
        return data

    def leaf(self, offset: int, length: int) -> Directory:
        at = self.header.leaf_offset + offset
        return self.cache.get(at, lambda: self._decode(self._read(at, length)))

    def find(self, tile: int) -> dict[str, int] | None:
        """The entry of a tile, through at most six leaves."""
        directory = self.root
        for _ in range(LEAF_LEVELS + 1):
            at = codec.find(directory, tile)
            if at is None:
                return None
            entry = {k: int(v[at]) for k, v in directory.items()}
            if entry["run_length"]:
                return entry
            directory = self.leaf(entry["offset"], entry["length"])
        return None

    def tile(self, tile: int) -> bytes | None:
        """The stored bytes of a tile id."""
        if not 0 <= tile <= MAX_TILE_ID:
            raise E.InvalidTileId(str(tile))
        entry = self.find(tile)
        return None if entry is None else self._read(self.header.data_offset + entry["offset"], entry["length"])

    def tile_at(self, z: int, x: int, y: int) -> bytes | None:
        if not (0 <= z <= 31 and 0 <= x < 1 << z and 0 <= y < 1 << z):
            raise E.InvalidCoordinate(f"{z}, {x}, {y}")
        return self.tile(int(ids_of(np.array([z]), np.array([x]), np.array([y]))[0]))

    def tile_decompressed(self, tile: int) -> bytes | None:
        data = self.tile(tile)
        return None if data is None else codec.decompress(self.header.tile_compression, data)

    def metadata(self) -> str:
        h = self.header
        data = codec.decompress(h.internal_compression, self._read(h.metadata_offset, h.metadata_length)) if h.metadata_length else b""
        try:
            return data.decode()
        except UnicodeDecodeError as e:
            raise E.InvalidMetadataUtf8Encoding(str(e)) from e

    def leaves_of(self, directory: Directory, low: int = 0, high: int = MAX_TILE_ID) -> list[tuple[int, int]]:
        """Offset and length of the leaves of a directory that may hold ids from ``low`` to ``high``.

        A repeated id can be on both sides of a border, and out of order a run can reach beyond it.
        """
        ids = directory["tile_id"]
        upper = np.r_[ids[1:], MAX_TILE_ID + 1] if len(ids) else ids
        reaches = upper >= low if self.header.clustered else np.ones(len(ids), bool)
        some = np.flatnonzero((directory["run_length"] == 0) & reaches & (ids <= high))
        found = [(int(directory["offset"][i]), int(directory["length"][i])) for i in some]
        if len({o for o, _ in found}) < len(found):
            raise E.InvalidEntry("a leaf is met twice")
        return found

    def directories(self, low: int = 0, high: int = MAX_TILE_ID, leaf: tuple[int, int] | None = None, level: int = 1) -> Iterator[tuple[int, int, Directory]]:
        """(level, offset, directory) level by level: the root (offset -1) and what is under it, or one leaf and what is
        under that. Leaves beyond ``low`` and ``high`` are not read."""
        now = [(0, -1, self.root)] if leaf is None else [(level, leaf[0], self.leaf(*leaf))]
        seen = {at for _, at, _ in now}
        while now:
            yield from now
            below = [(depth + 1, *x) for depth, _, directory in now for x in self.leaves_of(directory, low, high)]
            if any(depth > LEAF_LEVELS or at in seen for depth, at, _ in below):
                raise E.InvalidEntry("leaves are too deep, or one is met twice")
            seen.update(at for _, at, _ in below)
            now = [(depth, at, self.leaf(at, length)) for depth, at, length in below]

    def entries(self) -> Iterator[dict[str, int]]:
        """All tile entries, level by level."""
        for level, at, d in self.directories():
            for i in np.flatnonzero(d["run_length"] > 0).tolist():
                yield {**{k: int(v[i]) for k, v in d.items()}, "level": level, "dir_offset": at, "ordinal": i}

    def tilejson(self, sources: list[str]) -> dict:
        return merged_tilejson(self.header, self.metadata(), sources)


#: Fixed values of the format: text fields of the document, fields that the header owns.
TEXTS = ("description", "attribution", "legend", "name", "version")
OWNED = ("minzoom", "maxzoom")


def header_tilejson(header: codec.Header, sources: list[str]) -> dict:
    h = header
    return {
        "tilejson": "3.0.0", "tiles": list(sources), "minzoom": h.min_zoom, "maxzoom": h.max_zoom,
        "bounds": [h.min_longitude, h.min_latitude, h.max_longitude, h.max_latitude], "center": [h.center_longitude, h.center_latitude, h.center_zoom],
    }


def merged_tilejson(header: codec.Header, metadata: str, sources: list[str]) -> dict:
    """The header's document with the metadata laid over it; what has no field of its own goes to ``other``."""
    try:
        own = json.loads(metadata)
    except ValueError as e:
        raise E.InvalidMetadata(str(e)) from e
    if not isinstance(own, dict):
        raise E.InvalidMetadata("not an object")
    out = header_tilejson(header, sources)
    other = {}
    for key, value in own.items():
        if isinstance(value, str) and key in TEXTS:
            out[key] = value
        elif isinstance(value, str) and key in OWNED:
            continue
        elif key == "vector_layers" and not isinstance(value, str):
            if not (isinstance(value, list) and all(isinstance(v, dict) and isinstance(v.get("id"), str) and isinstance(v.get("fields", {}), dict) for v in value)):
                raise E.InvalidMetadata("vector_layers is no list of layers")
            out[key] = value
        else:
            other[key] = value
    return out | {"other": other}
