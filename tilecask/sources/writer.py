"""Writing an archive from a table of tiles.

Rows: seq (unique, the order of the calls), tile_id, data, is_raw. Payloads are hashed and stored once each, compressed
where they are not raw; of equal inputs the first one decides, raw or not. Entries, offsets and leaf directories are
computed by Spark from narrow rows. Contents are compressed by tasks, in ranges of first use, into segments next to the
target; then tasks copy segments and leaves to their places in the file. The driver writes root, header and metadata
and moves the file into place. Tables that are read twice are stored, segments and leaves carry the name of the task
attempt that wrote them, and copying writes the same bytes to the same place: tasks may run again or twice at a time. A
failed write leaves nothing behind. ``path`` is on a file system that driver and executors share.

Leaves come from chunks of the entries in id order; the first leaf size is max(entries / 3500, 4096) and grows by a
fifth until the root fits 16,257 bytes, so there are at most some 3,500. Fewer than 16,384 entries that fit make a flat
root. A codec is the name of a compression, whose code goes to the header; ``Zstd=module:callable`` names a compressor
of one's own that makes it.
"""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.tiles import zxy_of
from ..operators import entries as ops
from ..operators.directory import chunked, first_leaf_size, numbered
from ..plans.ordered import _RANGE, plain, ranged, with_running
from ..plans.scratch import forget, stored

FLAT_ENTRIES = 16_384
#: Bytes that a task copies at once.
COPY = 8 << 20


def _leaves(entries: DataFrame, leaf_size: int, work: str, internal: str, level: int | None) -> list[tuple[int, int, str]]:
    """(first id, bytes, file) of each encoded leaf, in order: at most some 3,500 rows, as leaves grow with the entries."""

    def encode(table: pa.Table) -> pa.Table:
        t = table.sort_by("ordinal")
        columns = [t.column(c).to_numpy() for c in ("tile_id", "offset", "length", "run_length")]
        data = codec.compressor(internal, level)(codec.encode_directory(*columns))
        name = f"{work}/leaf.{uuid.uuid4().hex}"
        with open(name, "wb") as out:
            out.write(data)
        return pa.table({"leaf": pa.array([t.column("leaf")[0].as_py()], pa.int64()), "first": pa.array([int(columns[0][0])], pa.int64()), "n": pa.array([len(data)], pa.int64()), "file": pa.array([name])})

    rows = chunked(entries, leaf_size).select("leaf", "ordinal", "tile_id", "offset", "length", "run_length").groupBy("leaf").applyInArrow(encode, "leaf long, first long, n long, file string")
    return [(r["first"], r["n"], r["file"]) for r in sorted(rows.collect())]


def _segments(first: DataFrame, work: str, tile_codec: str, level: int | None) -> DataFrame:
    """range, hash, first_seq, length, segment of each content; stored bytes go to one file for each range and attempt."""

    def store(batches):
        compress, attempt, now, out = codec.compressor(tile_codec, level), uuid.uuid4().hex, None, None
        try:
            for batch in batches:
                lengths, segments = [], []
                for k, data, is_raw in zip(*(batch.column(c).to_pylist() for c in (_RANGE, "data", "is_raw")), strict=True):
                    if k != now:
                        if out:
                            out.close()
                        now, out = k, open(f"{work}/{k}.{attempt}", "wb")  # noqa: SIM115
                    lengths.append(out.write(data if is_raw else compress(data)))
                    segments.append(f"{k}.{attempt}")
                out.flush()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (_RANGE, "hash", "first_seq")), pa.array(lengths, pa.int64()), pa.array(segments)], [_RANGE, "hash", "first_seq", "length", "segment"])
        finally:
            if out:
                out.close()

    rows = first.repartition(_RANGE).sortWithinPartitions(_RANGE, "first_seq").select(_RANGE, "hash", "first_seq", "data", "is_raw")
    return stored(rows.mapInArrow(store, f"{_RANGE} int, hash string, first_seq long, length long, segment string"))


def _copied(files: DataFrame, target: str) -> None:
    """Copies each file (name, at) to its place in ``target``."""

    def copy(batches):
        for batch in batches:
            for name, at in zip(batch.column("name").to_pylist(), batch.column("at").to_pylist(), strict=True):
                with open(name, "rb") as part, open(target, "r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(part, out, COPY)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.mapInArrow(copy, "n long").agg(F.sum("n")).collect()


def write_archive(tiles: DataFrame, path: str, header: codec.Header | None = None, metadata: str = "{}", tile_codec: str | None = None, internal_codec: str | None = None, level: int | None = None, derive_header: bool = False) -> codec.Header:
    """Writes ``tiles`` to ``path`` and returns the header.

    ``header`` gives type, zooms, bounds and center, taken as they are, and compressions unless codecs say otherwise.
    ``derive_header`` takes zooms from the tiles instead.
    """
    h = replace(header or codec.Header())
    tile_codec, internal_codec = tile_codec or h.tile_compression, internal_codec or h.internal_compression
    compress_internal = codec.compressor(internal_codec, level)
    codec.compressor(tile_codec, level)  # an unsupported one is told now
    h.tile_compression, h.internal_compression = codec.compression_of(tile_codec), codec.compression_of(internal_codec)
    spark = tiles.sparkSession
    raw = F.coalesce(F.col("is_raw"), F.lit(False)) if "is_raw" in tiles.columns else F.lit(False)
    rows = tiles.where(F.octet_length("data") > 0).select("seq", "tile_id", F.col("data").cast("binary").alias("data"), raw.alias("is_raw"))
    work = f"{path}.{uuid.uuid4().hex}.parts"
    os.makedirs(work)
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        line = keep(ops.lined(ops.hashed_tiles(rows)))
        once = keep(ranged(line.groupBy("hash").agg(F.min("seq").alias("first_seq")), ["first_seq"]))
        # Payloads meet their range by the unique call number, never by content.
        first = rows.select("seq", "data", "is_raw").join(once.withColumn("seq", F.col("first_seq")), "seq")
        done = keep(_segments(first, work, tile_codec, level))
        sized = with_running(done, ["first_seq"], {"offset": (F.col("length"), False)})
        run_rows = keep(stored(ops.ordered_runs(line)))
        found = ops.located(run_rows, plain(sized))
        n, addressed, h.clustered = run_rows.agg(F.count("*"), F.sum("run_length"), F.coalesce(F.bool_and("in_order"), F.lit(True))).first()
        n_contents, h.data_length = done.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        h.n_addressed_tiles, h.n_tile_entries, h.n_tile_contents = addressed or None, n or None, n_contents or None
        if derive_header and n:
            zooms = zxy_of(np.array(line.agg(F.min("tile_id"), F.max("tile_id")).first()))[0]
            h.min_zoom, h.max_zoom = int(zooms[0]), int(zooms[1])
        root, leaves = b"", []
        if n < FLAT_ENTRIES:
            flat = np.array(found.select("tile_id", "grp", "offset", "length", "run_length").collect(), np.int64).reshape(-1, 5)
            flat = flat[np.lexsort((flat[:, 1], flat[:, 0]))]
            root = compress_internal(codec.encode_directory(flat[:, 0], *flat.T[2:]))
        if n >= FLAT_ENTRIES or len(root) > codec.ROOT_BUDGET:
            found = keep(stored(plain(numbered(found))))
            size = first_leaf_size(n)
            while True:
                leaves = _leaves(found, size, work, internal_codec, level)
                lengths = np.array([x[1] for x in leaves], np.int64)
                root = compress_internal(codec.encode_directory([x[0] for x in leaves], np.cumsum(lengths) - lengths, lengths, np.zeros(len(leaves), np.int64)))
                if len(root) <= codec.ROOT_BUDGET:
                    break
                size += size // 5
        told = compress_internal(metadata.encode())
        h.root_length, h.metadata_length = len(root), len(told)
        h.data_offset = h.metadata_offset + len(told)
        if leaves:
            h.leaf_offset, h.leaf_length = h.data_offset + h.data_length, int(sum(x[1] for x in leaves))
        target = f"{work}/archive"
        with open(target, "wb") as out:
            out.write((h.encode() + root).ljust(codec.INITIAL_READ, b"\0"))
            out.write(told)
            out.truncate(h.data_offset + h.data_length + h.leaf_length)
        places = sized.groupBy("segment").agg(F.min("offset").alias("at")).select(F.concat(F.lit(f"{work}/"), "segment").alias("name"), (F.col("at") + h.data_offset).alias("at"))
        if leaves:
            places = places.unionByName(spark.createDataFrame([(x[2], int(h.leaf_offset + at)) for x, at in zip(leaves, np.cumsum(lengths) - lengths, strict=True)], "name string, at long"))
        _copied(places, target)
        os.replace(target, path)
        return h
    finally:
        forget(*kept)
        shutil.rmtree(work, ignore_errors=True)


def new_header(tile_type: str, **fields) -> codec.Header:
    """The header of a new archive: vector tiles of type Mvt are compressed with Gzip, all others are not."""
    return codec.Header(**{"tile_type": tile_type, "tile_compression": "Gzip" if tile_type == "Mvt" else "None"} | fields)
