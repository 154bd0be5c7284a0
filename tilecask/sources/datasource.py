"""The Spark data source ``tilearchive``.

``spark.read.format("tilearchive").option("table", ...).load(path)`` reads one of

* ``archives``: path, header, metadata, version; one row for each archive,
* ``entries``: tile entries with their directory; one partition for each leaf directory under the root,
* ``tiles``: one row for each tile with its stored bytes, decompressed with option ``decompress=true``.

``path`` may name several archives, comma-separated, with ``*`` for local ones; addresses with a scheme are read by
ranges (web servers, object stores). Planning reads the first 16 KiB of each archive and no leaf: tasks read their leaf
and what is under it. Options ``low`` and ``high`` bound the ids, as do, with ``read_archive`` and
``spark.sql.python.filterPushdown.enabled=true``, filters on ``tile_id``: leaves beyond them are never read.
``mode=PERMISSIVE`` turns a failing archive into a row of table ``archives`` with ``error``; other tables skip it.
``ranges`` and ``cache`` may be ``module:callable`` for a store or cache of one's own.

``df.write.format("tilearchive")`` writes an archive (sources.sink).
"""

from __future__ import annotations

import glob
import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .. import errors as E
from ..functions.codec import HEADER_SIZE, Directory, Header, decompress
from ..functions.tiles import MAX_TILE_ID, zxy_of
from .archive import Archive, make_cache, merged_tilejson
from .ranges import BufferRanges, open_ranges

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_KINDS = {"int": "bigint", "str": "string", "float": "double", "bool": "boolean", "int | None": "bigint"}
HEADER = "struct<" + ",".join(f"{n}:{_KINDS[str(f.type)]}" for n, f in Header.__dataclass_fields__.items()) + ">"
SCHEMAS = {
    "archives": f"archive_path string, source_version string, header {HEADER}, metadata string, error string",
    "entries": "archive_path string, tile_id long, run_length long, offset long, length long, level int, dir_offset long, ordinal long",
    "tiles": "archive_path string, tile_id long, z int, x long, y long, data binary",
}
#: Rows of a batch of tiles, and bytes of neighbouring contents that are read at once.
ROWS, SPAN = 1024, 8 << 20
#: Archives that a Python worker keeps open, with their caches.
OPEN = 16
_open: OrderedDict[tuple, Archive] = OrderedDict()


def opened(path: str, ranges: str | None, cache: str, head: bytes | None = None, version: str | None = None) -> Archive:
    """An archive, kept open by this worker: what its cache holds is found by the next task that reads it."""
    key = (path, ranges, cache, version, len(head or b""))
    if version is None or key not in _open:
        archive = Archive(open_ranges(path, ranges), make_cache(cache), head, version)
        if version is None:
            return archive
        _open[key] = archive
        while len(_open) > OPEN:
            _open.popitem(last=False)
    _open.move_to_end(key)
    return _open[key]


class Part(InputPartition):
    """An archive's root directory, or one leaf under it. ``head``: the first 16 KiB, or for a leaf the header alone."""

    def __init__(self, path: str, head: bytes | None = None, version: str | None = None, leaf: tuple[int, int] | None = None):
        super().__init__((path, leaf))
        self.path, self.head, self.version, self.leaf = path, head, version, leaf


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], table: str):
        self.table = table
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.decompress = options.get("decompress", "false").lower() == "true"
        self.ranges, self.cache = options.get("ranges"), options.get("cache", "lru")
        self.low, self.high = int(options.get("low", 0)), int(options.get("high", MAX_TILE_ID))
        self.paths = []
        for p in options["path"].split(","):
            p = p.strip()
            local = p.removeprefix("file://").removeprefix("file:")
            self.paths += sorted(glob.glob(local)) if "*" in p and "://" not in local else [p]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            if self.table == "archives":
                out.append(Part(path))
                continue
            try:
                archive = Archive(open_ranges(path, self.ranges))
                leaves = archive.leaves_of(archive.root, self.low, self.high)
            except E.ArchiveError:
                if not self.permissive:
                    raise
                continue
            if len(self._some(archive.root)):
                out.append(Part(path, archive.head, archive.version))
            out += [Part(path, archive.head[:HEADER_SIZE], archive.version, leaf) for leaf in leaves]
        return out or [Part("")]

    def _some(self, d: Directory) -> np.ndarray:
        """The places of the entries that hold wanted tiles."""
        return np.flatnonzero((d["run_length"] > 0) & (d["tile_id"] <= self.high) & (d["tile_id"] + d["run_length"] > self.low))

    def read(self, partition: Part) -> Iterator:
        if not partition.path:
            return
        try:
            archive = opened(partition.path, self.ranges, self.cache, partition.head, partition.version)
            if self.table == "archives":
                yield (partition.path, archive.version, tuple(archive.header.row().values()), archive.metadata(), None)
                return
        except E.ArchiveError as e:
            if not self.permissive:
                raise
            if self.table == "archives":
                yield (partition.path, None, None, None, f"{e.error_class}: {e}")
            return
        leaf = partition.leaf
        for level, at, d in [(0, -1, archive.root)] if leaf is None else archive.directories(self.low, self.high, leaf):
            some = self._some(d)
            if self.table == "entries":
                yield entries_batch(partition.path, level, at, d, some)
                continue
            for i in range(0, len(some), 256):
                yield from self.tiles(archive, partition.path, {k: v[some[i : i + 256]].astype(np.int64) for k, v in d.items()})

    def tiles(self, archive: Archive, path: str, d: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The tiles of some entries. Stored bytes are read in the order of the file; those side by side share a read.
        Runs become rows a batch at a time, from ``low`` to ``high`` only."""
        held: dict[tuple[int, int], bytes] = {}
        for group in _neighbours(sorted(set(zip(d["offset"].tolist(), d["length"].tolist(), strict=True)))):
            low, high = group[0][0], max(o + n for o, n in group)
            data = archive._read(archive.header.data_offset + low, high - low)
            for o, n in group:
                raw = data[o - low : o - low + n]
                held[o, n] = decompress(archive.header.tile_compression, raw) if self.decompress else raw
        first = np.maximum(d["tile_id"], self.low)
        ends = np.cumsum(np.minimum(d["tile_id"] + d["run_length"], self.high + 1) - first)
        for at in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
            place = np.arange(at, min(at + ROWS, int(ends[-1])))
            w = np.searchsorted(ends, place, "right")
            t = first[w] + place - np.r_[0, ends][w]
            z, x, y = zxy_of(t)
            payload = [held[int(d["offset"][i]), int(d["length"][i])] for i in w]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(t)), pa.array(t), pa.array(z.astype(np.int32)), pa.array(x), pa.array(y), pa.array(payload, pa.binary())], ["archive_path", "tile_id", "z", "x", "y", "data"])


def entries_batch(path: str, level: int, at: int, d: Directory, some: np.ndarray) -> pa.RecordBatch:
    n = len(some)
    numbers = [pa.array(d[c][some].astype(np.int64)) for c in ("tile_id", "run_length", "offset", "length")]
    columns = [pa.array([path] * n, pa.string()), *numbers, pa.array([level] * n, pa.int32()), pa.array([at] * n, pa.int64()), pa.array(some.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["archive_path", "tile_id", "run_length", "offset", "length", "level", "dir_offset", "ordinal"])


def _neighbours(keys: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) in groups that touch or overlap, of at most ``SPAN`` bytes (one content at least)."""
    groups, low, high = [], 0, -1
    for o, n in keys:
        if o <= high and o + n - low <= SPAN:
            groups[-1].append((o, n))
            high = max(high, o + n)
        else:
            groups.append([(o, n)])
            low, high = o, o + n
    return groups


class PushdownReader(Reader):
    """Prunes by ``tile_id``. Filters go back to Spark, which applies them to every row."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("tile_id",):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value)
                elif isinstance(f, In) and f.value:
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value)
            yield f


class TileArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilearchive"

    def _table(self) -> str:
        table = self.options.get("table", "entries")
        if table not in SCHEMAS:
            raise ValueError(f"table {table!r} is none of {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> DataSourceReader:
        kind = PushdownReader if self.options.get("pushdown", "false") == "true" else Reader
        return kind(dict(self.options), self._table())

    def writer(self, schema, overwrite: bool):
        from .sink import ArchiveSink

        return ArchiveSink(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileArchiveSource)


def read_archive(spark: SparkSession, path: str, table: str = "entries", **options: str | int) -> DataFrame:
    """A table of the archives at ``path``; filters prune leaves if the session allows them to be pushed to Python."""
    register(spark)
    push = str(spark.conf.get(PUSHDOWN, "false")).lower()
    return spark.read.format("tilearchive").options(table=table, pushdown=push, **options).load(path)


def tiles_at(probes: DataFrame, path: str, tile: str = "tile", decompress_tiles: bool = False, ranges: str | None = None, cache: str = "lru") -> DataFrame:
    """``probes`` with ``data``: the stored bytes of each row's tile, null where the archive has none or the id is null.

    Probes are sorted by tile and cut into ranges (all columns split ties), so that a task reads the few leaves on the
    way to its tiles, each once while the cache holds it.
    """
    first = Archive(open_ranges(path, ranges))
    head, version = first.head, first.version
    names = [c for c in probes.columns if c.lower() != "data"]
    rows = probes.select(*names).repartitionByRange(F.col(tile), F.xxhash64(*names)).sortWithinPartitions(tile)

    def run(batches):
        archive = opened(path, ranges, cache, head, version)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [None if t is None or not 0 <= t <= MAX_TILE_ID else archive.tile_decompressed(t) if decompress_tiles else archive.tile(t) for t in part.column(tile).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, "data"])

    return rows.mapInArrow(run, rows.withColumn("data", F.lit(None).cast("binary")).schema)


def entries_at(probes: DataFrame, path: str, tile: str = "tile", ranges: str | None = None, cache: str = "lru") -> DataFrame:
    """``probes`` (plain columns) with offset, length and found of each row's tile, through the archive's own leaves."""
    first = Archive(open_ranges(path, ranges))
    head, version = first.head, first.version
    new = ["offset", "length", "found"]
    names = [c for c in probes.columns if c.lower() not in new]
    rows = probes.select(*names).repartitionByRange(F.col(tile), F.xxhash64(*names)).sortWithinPartitions(tile)

    def run(batches):
        archive = opened(path, ranges, cache, head, version)
        for batch in batches:
            found = [None if t is None else archive.find(t) for t in batch.column(tile).to_pylist()]
            numbers = [pa.array([e and e[c] for e in found], pa.int64()) for c in new[:2]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers, pa.array([e is not None for e in found])], [*batch.schema.names, *new])

    nothing = F.lit(None).cast("long")
    return rows.mapInArrow(run, rows.select("*", nothing.alias("offset"), nothing.alias("length"), F.lit(True).alias("found")).schema)


def read_archive_bytes(spark: SparkSession, path: str, table: str = "entries", **options: str) -> DataFrame:
    """Table ``entries`` or ``tiles`` of whole archives that only Hadoop's file systems reach, of up to 2 GB each. Where
    ``pyarrow.fs`` or a store of one's own can read ranges, ``read_archive`` is the way."""
    reader = Reader({"path": path, **options}, table)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                archive = Archive(BufferRanges(content))
                for level, at, d in archive.directories():
                    some = reader._some(d)
                    if table == "entries":
                        yield entries_batch(name, level, at, d, some)
                    else:
                        for i in range(0, len(some), 256):
                            yield from reader.tiles(archive, name, {k: v[some[i : i + 256]].astype(np.int64) for k, v in d.items()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMAS[table])


def tilejson(archives: DataFrame, sources: list[str]) -> DataFrame:
    """archive_path and the merged descriptive document (JSON) of each archive of table ``archives``."""

    def run(batches):
        for batch in batches:
            rows = batch.select(["archive_path", "header", "metadata"]).to_pylist()
            docs = [json.dumps(merged_tilejson(Header(**r["header"]), r["metadata"], sources), sort_keys=True) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["archive_path"] for r in rows], pa.string()), pa.array(docs, pa.string())], ["archive_path", "tilejson"])

    return archives.where("header is not null").select("archive_path", "header", "metadata").mapInArrow(run, "archive_path string, tilejson string")
