"""The sink of the data source: ``df.write.format("tilearchive").mode("overwrite").save(path)``.

Columns: tile_id and data; seq (the order of the calls; by default that of tile_id) and is_raw where there are any.
Options: ``tile_type``, ``tile_codec``, ``internal_codec``, ``metadata``, ``min_zoom``, ``max_zoom``, ``center_zoom``, and
the four bounds and two center coordinates under the names that the header has.

A data source commits in one process, which gets a few numbers for each tile here (not the payloads, which tasks write
as segments): up to ``MOST`` tiles. ``sources.writer.write_archive`` has no such bound and copies in tasks.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .. import errors as E
from ..functions import codec
from .writer import FLAT_ENTRIES, first_leaf_size, new_header

#: Tiles of one archive that the sink takes; some 100 bytes of the committing process each.
MOST = 20_000_000
_INDEX = np.dtype([("seq", "<i8"), ("tile", "<i8"), ("hash", "S32"), ("at", "<i8"), ("length", "<i8")])


@dataclass
class Written(WriterCommitMessage):
    name: str
    tiles: int


class ArchiveSink(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema, overwrite: bool):
        of = {f.name: f for f in fields(codec.Header)}
        told = {k: v for k, v in options.items() if k.lower() in of or k in of}
        numbers = {k: float(v) if "itude" in k else int(v) for k, v in told.items() if k.startswith(("min_", "max_", "center_"))}
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        if os.path.exists(self.path) and not overwrite:
            raise E.ReadingError(f"{self.path} is there; mode overwrite replaces it")
        self.header = new_header(options.get("tile_type", "Unknown"), **numbers)
        self.metadata = options.get("metadata", "{}")
        self.tile_codec, self.internal_codec = options.get("tile_codec", self.header.tile_compression), options.get("internal_codec", self.header.internal_compression)
        self.header.tile_compression, self.header.internal_compression = map(codec.compression_of, (self.tile_codec, self.internal_codec))
        codec.compressor(self.tile_codec)
        self.names = schema.names
        for c in ("tile_id", "data"):
            if c not in self.names:
                raise ValueError(f"no column {c}")
        self.work = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator) -> Written:
        """One segment of the contents that are new to the task, and an index of its tiles."""
        os.makedirs(self.work, exist_ok=True)
        name, compress, seen, rows, at = f"{self.work}/{uuid.uuid4().hex}", codec.compressor(self.tile_codec), {}, [], 0
        with open(f"{name}.data", "wb") as out:
            for batch in iterator:
                tiles = batch.column("tile_id").to_pylist()
                seqs = batch.column("seq").to_pylist() if "seq" in self.names else tiles
                raws = batch.column("is_raw").to_pylist() if "is_raw" in self.names else [False] * len(tiles)
                for seq, tile, raw, data in zip(seqs, tiles, raws, batch.column("data").to_pylist(), strict=True):
                    data = data.encode() if isinstance(data, str) else data
                    if data:
                        # Of equal inputs the first call decides, raw or not, which only the commit knows: both are kept.
                        key = hashlib.sha256(data).digest(), bool(raw)
                        if key not in seen:
                            n = out.write(data if raw else compress(data))
                            seen[key] = at, n
                            at += n
                        rows.append((seq, tile, key[0], *seen[key]))
        np.array(rows, _INDEX).tofile(f"{name}.index")
        return Written(name, len(rows))

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        if sum(m.tiles for m in done) > MOST:
            self.abort(messages)
            raise E.IndexEntryOverflow(f"more than {MOST} tiles: use write_archive")
        os.makedirs(self.work, exist_ok=True)
        parts = [np.fromfile(f"{m.name}.index", _INDEX) for m in done]
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        rows = np.concatenate([np.zeros(0, _INDEX), *parts])
        order = np.lexsort((np.arange(len(rows)), rows["seq"]))
        rows, part = rows[order], part[order]
        starts = np.ones(len(rows), bool)
        starts[1:] = (rows["hash"][1:] != rows["hash"][:-1]) | (rows["tile"][1:] != rows["tile"][:-1] + 1)
        _, first, content = np.unique(rows["hash"], return_index=True, return_inverse=True)
        by_use = np.argsort(first, kind="stable")
        length = rows["length"][first].astype(np.int64)
        offset = np.zeros(len(first), np.int64)
        offset[by_use] = np.cumsum(length[by_use]) - length[by_use]
        at = np.flatnonzero(starts)
        run = np.diff(np.r_[at, len(rows)])
        place = np.argsort(rows["tile"][at], kind="stable")
        tile, where = rows["tile"][at][place], content[at][place]
        columns = [tile, offset[where], length[where], run[place]]
        compress = codec.compressor(self.internal_codec)
        root, leaves, size = compress(codec.encode_directory(*columns)) if len(at) < FLAT_ENTRIES else b"", [], first_leaf_size(len(at))
        while len(at) >= FLAT_ENTRIES and not leaves or len(root) > codec.ROOT_BUDGET:
            cuts = range(0, len(at), size)
            leaves = [compress(codec.encode_directory(*(c[i : i + size] for c in columns))) for i in cuts]
            n = np.array([len(x) for x in leaves], np.int64)
            root = compress(codec.encode_directory(tile[list(cuts)], np.cumsum(n) - n, n, np.zeros(len(n), np.int64)))
            size += size // 5
        h, told = self.header, compress(self.metadata.encode())
        h.n_addressed_tiles, h.n_tile_entries, h.n_tile_contents = len(rows) or None, len(at) or None, len(first) or None
        h.clustered = bool((np.diff(rows["tile"].astype(np.int64)) > 0).all())
        h.root_length, h.metadata_length, h.data_length = len(root), len(told), int(length.sum())
        h.data_offset = h.metadata_offset + len(told)
        if leaves:
            h.leaf_offset, h.leaf_length = h.data_offset + h.data_length, sum(map(len, leaves))
        target = f"{self.work}/archive"
        with open(target, "wb") as out:
            out.write((h.encode() + root).ljust(codec.INITIAL_READ, b"\0") + told)
            files = [open(f"{m.name}.data", "rb") for m in done]  # noqa: SIM115
            for k in by_use.tolist():
                i = first[k]
                files[part[i]].seek(int(rows["at"][i]))
                shutil.copyfileobj(_Some(files[part[i]], int(rows["length"][i])), out)
            for f in files:
                f.close()
            for leaf in leaves:
                out.write(leaf)
        os.replace(target, self.path)
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


class _Some:
    """The next ``n`` bytes of a file."""

    def __init__(self, file, n: int):
        self.file, self.n = file, n

    def read(self, size: int) -> bytes:
        data = self.file.read(min(size, self.n))
        self.n -= len(data)
        return data
