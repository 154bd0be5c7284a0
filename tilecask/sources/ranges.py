"""Byte ranges of files, web servers, object stores and buffers. A read gives bytes and, where there is one, the data's
version."""

from __future__ import annotations

import importlib
import mmap
import os
import urllib.error
import urllib.request
from abc import ABC, abstractmethod

from .. import errors as E


class Ranges(ABC):
    """Subclass this for another kind of store; only ``read`` is needed."""

    @abstractmethod
    def read(self, offset: int, length: int) -> tuple[bytes, str | None]:
        """Up to ``length`` bytes from ``offset``, fewer at the end."""

    def read_exact(self, offset: int, length: int) -> tuple[bytes, str | None]:
        data, version = self.read(offset, length)
        if len(data) != length:
            raise E.UnexpectedNumberOfBytesReturned(f"expected {length}, got {len(data)}")
        return data, version

    def close(self) -> None: ...


class BufferRanges(Ranges):
    def __init__(self, data, version: str | None = None):
        self.data, self.version = data, version

    def read(self, offset: int, length: int) -> tuple[bytes, str | None]:
        if offset > len(self.data):
            raise E.ReadingError(f"offset {offset} is beyond the end, {len(self.data)}")
        return bytes(self.data[offset : offset + length]), self.version

    def read_exact(self, offset: int, length: int) -> tuple[bytes, str | None]:
        if offset + length > len(self.data):
            raise E.ReadingError(f"{offset} + {length} is beyond the end, {len(self.data)}")
        return self.read(offset, length)


class FileRanges(BufferRanges):
    """A local file, mapped into memory. The version is its time and size, looked up at every read."""

    def __init__(self, path: str):
        try:
            with open(path, "rb") as f:
                stat = os.fstat(f.fileno())
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if stat.st_size else b""
        except OSError as e:
            raise E.UnableToOpenFile(f"{path}: {e}") from e
        super().__init__(data)
        self.path = path

    def read(self, offset: int, length: int) -> tuple[bytes, str | None]:
        stat = os.stat(self.path)
        return super().read(offset, length)[0], f"{stat.st_mtime_ns}-{stat.st_size}"


class HttpRanges(Ranges):
    """A web server that answers range requests. The version is the ETag, else Last-Modified."""

    def __init__(self, url: str, headers: dict[str, str] | None = None, timeout: float = 60):
        for name, value in (headers or {}).items():
            if any(c in f"{name}{value}" for c in "\r\n\0"):
                raise E.InvalidHeaderValue(name)
        self.url, self.headers, self.timeout = url, headers or {}, timeout

    def read(self, offset: int, length: int) -> tuple[bytes, str | None]:
        if not length:
            return b"", None
        request = urllib.request.Request(self.url, headers={**self.headers, "Range": f"bytes={offset}-{offset + length - 1}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                if answer.status != 206:
                    raise E.RangeRequestsUnsupported(f"{self.url}: status {answer.status}")
                data = answer.read(length + 1)
                version = answer.headers.get("ETag") or answer.headers.get("Last-Modified")
        except (urllib.error.URLError, OSError) as e:
            raise E.HttpError(f"{self.url}: {e}") from e
        if len(data) > length:
            raise E.ResponseBodyTooLong(f"more than {length} bytes")
        return data, version


class ObjectRanges(Ranges):
    """An object of a store that ``pyarrow.fs`` knows (``s3://``, ``gs://``, ``abfss://``, ``hdfs://``, ``file://``), or of
    a given ``pyarrow.fs.FileSystem``. Only the asked ranges are read. The version is the object's time and size."""

    def __init__(self, uri: str, store=None):
        from pyarrow import fs

        uri = uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri
        self.error = E.S3Error if uri.startswith("s3://") else E.ObjectStoreError
        try:
            self.store, self.path = (store, uri) if store else fs.FileSystem.from_uri(uri)
            self.file = self.store.open_input_file(self.path)
        except Exception as e:  # OSError, or the library's own kinds for a bad address
            raise self.error(f"{uri}: {e}") from e

    def read(self, offset: int, length: int) -> tuple[bytes, str | None]:
        try:
            info = self.store.get_file_info(self.path)
            if offset > (info.size or 0):
                raise E.ReadingError(f"offset {offset} is beyond the end, {info.size}")
            data = self.file.read_at(length, offset)
        except OSError as e:
            raise self.error(f"{self.path}: {e}") from e
        return data, f"{info.mtime_ns}-{info.size}"


def open_ranges(path: str, kind: str | None = None) -> Ranges:
    """The byte ranges of ``path``. ``kind``: ``object``, or ``module:callable`` (takes the path, gives ``Ranges``); by
    default what the address says."""
    if kind and ":" in kind:
        module, _, attribute = kind.partition(":")
        return getattr(importlib.import_module(module), attribute)(path)
    if path.startswith(("http://", "https://")):
        return HttpRanges(path)
    if kind == "object" or ("://" in path and not path.startswith("file://")):
        return ObjectRanges(path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}")
    return FileRanges(path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:"))
