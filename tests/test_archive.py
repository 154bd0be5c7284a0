import http.server
import json
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tilecask import errors as E
from tilecask.conditions import CASES, raised
from tilecask.functions import codec
from tilecask.sources import datasource
from tilecask.sources.archive import Archive, DictCache, LruCache, merged_tilejson
from tilecask.sources.datasource import PushdownReader, read_archive, read_archive_bytes, register, tilejson, tiles_at
from tilecask.sources.ranges import BufferRanges, FileRanges, HttpRanges, ObjectRanges, open_ranges
from tilecask.sources.writer import new_header, write_archive

SCHEMA = "seq long, tile_id long, data binary, is_raw boolean"


def tiles(spark, rows):
    return spark.createDataFrame([(i, t, d, bool(r and r[0])) for i, (t, d, *r) in enumerate(rows)], SCHEMA)


def test_flat_archive(spark, tmp_path):
    path = str(tmp_path / "a")
    h = write_archive(tiles(spark, [(i, i.to_bytes(8, "little")) for i in range(100)]), path, new_header("Png", internal_compression="None"))
    assert (h.n_addressed_tiles, h.n_tile_entries, h.n_tile_contents, h.clustered) == (100, 100, 100, True)
    a = Archive(path)
    assert a.tile(0) == bytes(8) and a.tile(99) == (99).to_bytes(8, "little") and a.tile(100) is None and a.metadata() == "{}"
    assert a.tile_at(0, 0, 0) == bytes(8) and len(list(a.entries())) == 100
    got = read_archive(spark, path, "tiles").where("tile_id = 4").collect()
    assert [(r["z"], r["x"], r["y"]) for r in got] == [(1, 1, 0)]
    with pytest.raises(E.InvalidTileId):
        a.tile(-1)


def test_leaves_caches_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.range(20000).select(F.col("id").alias("seq"), F.col("id").alias("tile_id"), F.col("id").cast("string").cast("binary").alias("data"))
    h = write_archive(rows, path, new_header("Mvt"))
    assert h.leaf_length > 0 and h.n_tile_entries == 20000
    for cache in (None, DictCache(), LruCache(1)):
        a = Archive(path, cache)
        assert [a.tile_decompressed(t) for t in (0, 4095, 4096, 19999)] == [b"0", b"4095", b"4096", b"19999"]
    got = read_archive(spark, path).where("tile_id between 4000 and 4200")
    assert got.count() == 201 and read_archive(spark, path).count() == 20000
    assert read_archive_bytes(spark, path).count() == 20000


class Counted(FileRanges):
    reads: list = []  # noqa: RUF012

    def read(self, offset, length):
        self.reads.append((offset, length))
        return super().read(offset, length)


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """An archive with leaves."""
    path = str(tmp_path_factory.mktemp("large") / "a")
    rows = spark.range(20000).select(F.col("id").alias("seq"), F.col("id").alias("tile_id"), F.col("id").cast("string").cast("binary").alias("data"))
    write_archive(rows, path, new_header("Png"))
    return path


def test_one_id_reads_its_leaf_only(spark, large, monkeypatch):
    monkeypatch.setattr(datasource, "open_ranges", lambda path, kind=None: Counted(path))
    monkeypatch.setattr(datasource, "_open", datasource.OrderedDict())
    Counted.reads.clear()
    for read in range(2):
        reader = PushdownReader({"path": large}, "tiles")
        assert len(list(reader.pushFilters([datasource.EqualTo(("tile_id",), 9000)]))) == 1
        parts = reader.partitions()
        assert len(parts) == 1 and len(Counted.reads) == 1  # planning: the first 16 KiB
        got = [b.to_pylist() for p in parts for b in reader.read(p)]
        assert [r["tile_id"] for b in got for r in b] == [9000]
        assert len(Counted.reads) == (3 if read == 0 else 2)  # one leaf, which the worker keeps, and one content
        Counted.reads.clear()
    archive = Archive(Counted(large))
    Counted.reads.clear()
    assert archive.tile(9000) == b"9000" and len(Counted.reads) == 2


def test_long_runs_are_read_in_pieces(tmp_path):
    root = codec.encode_directory([0, 3 << 30], [0, 0], [2, 2], [1 << 31, 1])
    h = codec.Header(internal_compression="None", root_length=len(root), data_offset=codec.INITIAL_READ, data_length=2)
    (tmp_path / "a").write_bytes((h.encode() + root).ljust(codec.INITIAL_READ, b"\0") + b"ok")
    reader = datasource.Reader({"path": str(tmp_path / "a"), "low": str(1 << 30), "high": str((1 << 30) + 2999)}, "tiles")
    ids = [t for p in reader.partitions() for b in reader.read(p) for t in b.column("tile_id").to_pylist()]
    assert ids == list(range(1 << 30, (1 << 30) + 3000))
    whole = datasource.Reader({"path": str(tmp_path / "a")}, "tiles")
    assert next(whole.read(whole.partitions()[0])).num_rows == datasource.ROWS


def test_tiles_at(spark, large):
    probes = spark.createDataFrame([(i, t) for i, t in enumerate([0, 4095, 4096, 4096, 19999, 20000, -1, None])], "probe long, tile long")
    got = {r["probe"]: r["data"] and bytes(r["data"]) for r in tiles_at(probes, large).collect()}
    assert got == {0: b"0", 1: b"4095", 2: b"4096", 3: b"4096", 4: b"19999", 5: None, 6: None, 7: None}


def test_nested_leaves_and_order(tmp_path):
    """Leaves of leaves, level by level; a scan of one leaf of the root has what is under it."""
    inner = [codec.encode_directory([t], [0], [1], [1]) for t in (0, 5)]
    middle = codec.encode_directory([0, 3, 5], [0, 0, len(inner[0])], [len(inner[0]), 1, len(inner[1])], [0, 2, 0])
    body = inner[0] + inner[1] + middle
    root = codec.encode_directory([0, 9], [len(inner[0]) + len(inner[1]), 0], [len(middle), 1], [0, 1])
    h = codec.Header(internal_compression="None", root_length=len(root), leaf_offset=codec.INITIAL_READ, leaf_length=len(body), data_offset=codec.INITIAL_READ + len(body), data_length=1)
    (tmp_path / "a").write_bytes((h.encode() + root).ljust(codec.INITIAL_READ, b"\0") + body + b"x")
    a = Archive(str(tmp_path / "a"))
    assert [(e["tile_id"], e["level"], e["ordinal"]) for e in a.entries()] == [(9, 0, 1), (3, 1, 1), (0, 2, 0), (5, 2, 0)]
    assert [a.tile(t) for t in (0, 1, 3, 4, 5, 6, 9)] == [b"x", None, b"x", b"x", b"x", None, b"x"] and repr(a.root) == "Directory [entries: 2]"
    reader = datasource.Reader({"path": str(tmp_path / "a")}, "entries")
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["tile_id"], r["level"], r["ordinal"]) for r in rows) == [(0, 2, 0), (3, 1, 1), (5, 2, 0), (9, 0, 1)]


def test_codecs_name_their_compression(spark, tmp_path):
    path = str(tmp_path / "a")
    for codecs, tile, internal in (({"tile_codec": "Zstd"}, "Zstd", "Gzip"), ({"internal_codec": "Zstd"}, "None", "Zstd"), ({"tile_codec": "Gzip=gzip:compress"}, "Gzip", "Gzip")):
        given = new_header("Png")
        h = write_archive(tiles(spark, [(0, b"abc"), (1, b"d")]), path, given, **codecs)
        a = Archive(path)
        assert (h.tile_compression, h.internal_compression) == (a.header.tile_compression, a.header.internal_compression) == (tile, internal)
        assert a.tile_decompressed(0) == b"abc" and given == new_header("Png")
    with pytest.raises(E.UnsupportedCompression, match="which compression"):
        write_archive(tiles(spark, []), path, tile_codec="gzip:compress")


def test_sink(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "a")
    rows = tiles(spark, [(5, b"ABC"), (6, b"ABC"), (2, b"X"), (3, b""), (9, b"ABC", True)]).repartition(3)
    rows.write.format("tilearchive").mode("overwrite").options(tile_type="Mvt", min_zoom=1, center_longitude=1.5, metadata='{"name": "n"}').save(path)
    a = Archive(path)
    assert [a.tile_decompressed(t) for t in (2, 3, 5, 6, 7, 9)] == [b"X", None, b"ABC", b"ABC", None, b"ABC"]
    h = a.header
    assert (h.n_addressed_tiles, h.n_tile_entries, h.n_tile_contents, h.clustered, h.min_zoom, h.center_longitude, a.metadata()) == (4, 3, 2, False, 1, 1.5, '{"name": "n"}')
    same = str(tmp_path / "b")
    assert write_archive(rows, same, new_header("Mvt", min_zoom=1, center_longitude=1.5), '{"name": "n"}') == h
    many = spark.range(20000).select(F.col("id").alias("tile_id"), F.col("id").cast("string").alias("data"))
    many.write.format("tilearchive").mode("overwrite").save(path)
    b = Archive(path)
    assert b.header.leaf_length > 0 and b.tile(12345) == b"12345" and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    with pytest.raises(Exception, match="overwrite"):
        many.write.format("tilearchive").mode("append").save(path)
    spark.createDataFrame([], "tile_id long, data binary").write.format("tilearchive").mode("overwrite").save(path)
    assert list(Archive(path).entries()) == []


@pytest.mark.parametrize("case", CASES)
def test_conditions(case):
    assert raised(case) == CASES[case][1].__name__


def test_caches():
    fetched, cache = [], LruCache(2)

    def fetch(at):
        fetched.append(at)
        if at == 9:
            raise E.ReadingError("no")
        return codec.Directory(tile_id=[at])

    for at in (1, 2, 1, 3, 1, 2):
        assert cache.get(at, lambda at=at: fetch(at))["tile_id"] == [at]
    assert fetched == [1, 2, 3, 2] and len(cache.flights) == 2
    for _ in range(2):
        with pytest.raises(E.DirectoryCacheError, match="ReadingError"):
            cache.get(9, lambda: fetch(9))
    assert fetched[-2:] == [9, 9]
    with ThreadPoolExecutor(8) as pool:  # at one time, one fetch
        assert all(x["tile_id"] == [7] for x in pool.map(lambda _: cache.get(7, lambda: fetch(7)), range(50)))
    assert fetched.count(7) == 1


def test_object_store(tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    uri = (tmp_path / "f").as_uri()
    r = open_ranges(uri, "object")
    assert isinstance(r, ObjectRanges) and r.read(2, 3)[0] == b"234" and r.read(8, 5)[0] == b"89" and r.read(0, 0)[0] == b"" and r.read(0, 1)[1] == r.read(1, 1)[1] is not None
    own = ObjectRanges("f", fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()))
    assert own.read_exact(0, 10)[0] == b"0123456789"
    with pytest.raises(E.UnexpectedNumberOfBytesReturned):
        own.read_exact(8, 9)


def test_pushdown_keeps_repeated_ids_and_long_runs(spark, tmp_path):
    n = F.col("seq")
    seq = spark.range(20000).withColumnRenamed("id", "seq")
    repeated = seq.select("seq", F.expr("(seq + 1) div 2").alias("tile_id"), n.cast("string").cast("binary").alias("data"))
    runs = seq.select(n, n.alias("tile_id"), F.lit("run").cast("binary").alias("data")).unionByName(seq.select((n + 20000).alias("seq"), n.alias("tile_id"), n.cast("string").cast("binary").alias("data")))
    for name, rows, at in (("a", repeated, 2048), ("b", runs, 9000)):
        path = str(tmp_path / name)
        h = write_archive(rows, path, new_header("Png", internal_compression="None"))
        assert h.leaf_length > 0 and not h.clustered
        whole = [r["tile_id"] for r in read_archive(spark, path, "tiles").collect()]
        for condition, holds in ((f"tile_id = {at}", at.__eq__), (f"tile_id >= {at}", at.__le__), (f"tile_id <= {at}", at.__ge__)):
            got = sorted(r["tile_id"] for r in read_archive(spark, path, "tiles").where(condition).select("tile_id").collect())
            assert got == sorted(filter(holds, whole))


def test_dedup_raw_and_order(spark, tmp_path):
    path = str(tmp_path / "a")
    h = write_archive(tiles(spark, [(0, b"ABC"), (1, b"X"), (2, b"ABC"), (3, b""), (5, b"ABC")]), path, new_header("Png"))
    assert (h.n_addressed_tiles, h.n_tile_entries, h.n_tile_contents) == (4, 4, 2)
    e = list(Archive(path).entries())
    assert (e[0]["offset"], e[0]["length"]) == (e[2]["offset"], e[2]["length"]) != (e[1]["offset"], e[1]["length"])
    h = write_archive(tiles(spark, [(2, b"a"), (0, b"a")]), path, new_header("Png"))
    assert not h.clustered and Archive(path).tile(0) == b"a"
    write_archive(tiles(spark, [(0, b"\0", True), (1, b"\1", False)]), path, new_header("Mvt"))
    a = Archive(path)
    assert a.tile(0) == b"\0" and a.tile_decompressed(1) == b"\1"


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "a")
    h = write_archive(tiles(spark, []), path)
    assert h.n_tile_entries is None and list(Archive(path).entries()) == [] and read_archive(spark, path).count() == 0


def test_tilejson():
    h = codec.Header()
    got = merged_tilejson(h, json.dumps({"name": "n", "minzoom": "3", "maxzoom": 9, "version": 2, "vector_layers": [{"id": "a", "fields": {}}], "x": "y"}), ["s"])
    assert got["name"] == "n" and got["minzoom"] == 0 and got["other"] == {"maxzoom": 9, "version": 2, "x": "y"} and got["vector_layers"][0]["id"] == "a"
    for bad in ("[", "[]", '{"vector_layers": 1}'):
        with pytest.raises(E.InvalidMetadata):
            merged_tilejson(h, bad, [])


def test_archives_table_and_errors(spark, tmp_path):
    good, bad = str(tmp_path / "a"), str(tmp_path / "b")
    write_archive(tiles(spark, [(0, b"x")]), good, new_header("Png"), metadata='{"attribution": "me"}')
    (tmp_path / "b").write_bytes(b"XX" * 100)
    rows = {r["archive_path"]: r for r in read_archive(spark, f"{good},{bad}", "archives", mode="PERMISSIVE").collect()}
    assert rows[good]["header"]["tile_type"] == "Png" and rows[bad]["error"].startswith("InvalidMagicNumber")
    doc = json.loads(tilejson(read_archive(spark, good, "archives"), ["u"]).first()["tilejson"])
    assert doc["attribution"] == "me"
    with pytest.raises(E.UnsupportedCompression):
        write_archive(tiles(spark, []), bad, new_header("Png", tile_compression="Unknown"))


def test_ranges(tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    f = FileRanges(str(tmp_path / "f"))
    assert f.read(8, 5)[0] == b"89" and f.read(10, 1)[0] == b""
    for call in (lambda: f.read(11, 1), lambda: f.read_exact(8, 5), lambda: FileRanges(str(tmp_path / "none"))):
        with pytest.raises(E.ReadingError):
            call()


class Handler(http.server.BaseHTTPRequestHandler):
    status, etag = 206, "v1"

    def do_GET(self):
        low, high = map(int, self.headers["Range"][6:].split("-"))
        data = b"0123456789"[low : high + 1] + (b"extra" if self.etag == "long" else b"")
        self.send_response(self.status)
        self.send_header("ETag", self.etag)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a): ...


def test_http():
    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    r = HttpRanges(f"http://127.0.0.1:{server.server_port}/")
    assert r.read(2, 3) == (b"234", "v1") and r.read(8, 9)[0] == b"89" and r.read(0, 0) == (b"", None)
    with pytest.raises(E.UnexpectedNumberOfBytesReturned):
        r.read_exact(8, 9)
    for status, etag, error in ((200, "v1", E.RangeRequestsUnsupported), (404, "v1", E.HttpError), (206, "long", E.ResponseBodyTooLong)):
        Handler.status, Handler.etag = status, etag
        with pytest.raises(error):
            r.read(0, 3)
    server.shutdown()


def test_source_modified(spark, tmp_path):
    path = tmp_path / "a"
    write_archive(tiles(spark, [(0, b"x")]), str(path), new_header("Png"))
    a = Archive(str(path))
    path.write_bytes(path.read_bytes() + b" ")
    with pytest.raises(E.SourceModified):
        a.tile(0)
    assert Archive(BufferRanges(path.read_bytes())).tile(0) == b"x"
