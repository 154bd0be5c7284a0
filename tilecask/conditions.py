"""Every error condition with a small case that leads to it: the contract of ``errors`` as a table."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from . import errors as E
from .functions import codec
from .sources.archive import Archive, LruCache
from .sources.ranges import BufferRanges, FileRanges, HttpRanges, ObjectRanges


def _bytes(metadata: bytes = b"{}", root: bytes = b"\0", **fields) -> bytes:
    """A small archive without tiles, not compressed."""
    h = codec.Header(**{"internal_compression": "None", "root_length": len(root), "metadata_length": len(metadata)} | fields)
    return (h.encode() + root).ljust(codec.INITIAL_READ, b"\0") + metadata


def _patched(at: int, value: int) -> bytes:
    data = bytearray(_bytes())
    data[at] = value
    return bytes(data)


def _open(data: bytes) -> Archive:
    return Archive(BufferRanges(data))


class _Changing(BufferRanges):
    def read(self, offset, length):
        self.version = str(int(self.version) + 1)
        return super().read(offset, length)


class _Short(BufferRanges):
    def read_exact(self, offset, length):
        return super(BufferRanges, self).read_exact(offset, length)


_LEAF = codec.encode_directory([0], [0], [5], [0])

#: Case, its action and the class of the error that it raises.
CASES: dict[str, tuple[Callable[[], object], type[E.ArchiveError]]] = {
    "another magic number": (lambda: _open(b"XX" * 100), E.InvalidMagicNumber),
    "an older version": (lambda: _open(b"PM" + bytes(200)), E.UnsupportedVersion),
    "a short header": (lambda: _open(_bytes()[:100]), E.InvalidHeader),
    "nothing at all": (lambda: _open(b""), E.InvalidHeader),
    "a root beyond the first read": (lambda: _open(_bytes(root_offset=codec.INITIAL_READ)), E.InvalidHeader),
    "an unknown compression code": (lambda: _open(_patched(97, 9)), E.InvalidCompression),
    "an unknown tile type code": (lambda: _open(_patched(99, 9)), E.InvalidTileType),
    "a directory that ends early": (lambda: _open(_bytes(root=b"\5\1")), E.InvalidEntry),
    "a first offset that follows nothing": (lambda: _open(_bytes(root=bytes([1, 0, 1, 1, 0]))), E.InvalidEntry),
    "compression Unknown": (lambda: codec.decompress("Unknown", b"x"), E.UnsupportedCompression),
    "a codec without its compression": (lambda: codec.compressor("gzip:compress"), E.UnsupportedCompression),
    "bytes that are no gzip": (lambda: codec.decompress("Gzip", b"xyz"), E.ReadingError),
    "metadata that is no UTF-8": (lambda: _open(_bytes(b"\xff\xfe")).metadata(), E.InvalidMetadataUtf8Encoding),
    "metadata that is no JSON": (lambda: _open(_bytes(b"[")).tilejson([]), E.InvalidMetadata),
    "metadata that is no object": (lambda: _open(_bytes(b"[]")).tilejson([]), E.InvalidMetadata),
    "a length of 33 bits": (lambda: codec.encode_directory([0], [0], [1 << 32], [1]), E.IndexEntryOverflow),
    "a read beyond the end": (lambda: BufferRanges(b"abc").read(4, 1), E.ReadingError),
    "fewer bytes than asked for": (lambda: _Short(b"abc").read_exact(1, 9), E.UnexpectedNumberOfBytesReturned),
    "a file that is not there": (lambda: FileRanges(str(Path(tempfile.gettempdir(), "no", "such", "file"))), E.UnableToOpenFile),
    "an object that is not there": (lambda: ObjectRanges("file:///no/such/object"), E.ObjectStoreError),
    "a server that is not there": (lambda: HttpRanges("http://127.0.0.1:9/").read(0, 1), E.HttpError),
    "a request header of two lines": (lambda: HttpRanges("http://127.0.0.1:9/", {"A": "b\r\nC: d"}), E.InvalidHeaderValue),
    "a source that changes": (lambda: Archive(_Changing(_bytes(b"{}", codec.encode_directory([0], [0], [2], [1])), "0")).tile(0), E.SourceModified),
    "a leaf that a cache cannot fetch": (lambda: Archive(BufferRanges(_bytes(root=_LEAF, leaf_offset=1 << 30)), LruCache()).tile(0), E.DirectoryCacheError),
    "a leaf that is met twice": (lambda: list(_open(_bytes(root=codec.encode_directory([0, 1], [0, 0], [5, 5], [0, 0]))).entries()), E.InvalidEntry),
    "a tile id beyond the last zoom": (lambda: _open(_bytes()).tile(1 << 63), E.InvalidTileId),
    "a coordinate beyond its zoom": (lambda: _open(_bytes()).tile_at(1, 2, 0), E.InvalidCoordinate),
}


def raised(case: str) -> str:
    """The error class that a case leads to, or "none"."""
    try:
        CASES[case][0]()
    except E.ArchiveError as e:
        return e.error_class
    return "none"


__all__ = ["CASES", "raised"]
