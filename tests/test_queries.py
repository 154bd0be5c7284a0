import os
import random
from typing import ClassVar

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilecask.functions import tiles
from tilecask.operators import directory, entries, lookup
from tilecask.plans import ordered, scratch
from tilecask.plans.dealt import dealt, mask
from tilecask.queries import ORACLE_SQL, QUERIES
from tilecask.streaming.upsert import TileTable

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    names = sorted(df.columns)
    return sorted([str(tuple(r[n] for n in names)) for r in df.collect()])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(ORACLE_SQL) <= set(entry.queries())


def transcript(rows):
    """The writer's rules, call by call."""
    out, seen, at, clustered, last = [], {}, 0, True, None
    for tile, data in rows:
        if not data:
            continue
        if out and last == data and tile == out[-1][0] + out[-1][1]:
            out[-1][1] += 1
            continue
        if out and tile < out[-1][0] + out[-1][1]:
            clustered = False
        if data not in seen:
            seen[data] = at
            at += len(data)
        out.append([tile, 1, seen[data], len(data)])
        last = data
    return sorted(map(tuple, out)), clustered


def test_entries_against_transcript(spark):
    rng = random.Random(4)
    for order in (True, False):
        rows = [(rng.randint(0, 300), rng.choice(["", "a", "bb", "ccc"])) for _ in range(200)]
        if order:
            rows = [(i * 2 // 3 * 2 + i % 2, d) for i, (_, d) in enumerate(rows)]
        df = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(rows)], "seq long, tile_id long, data string")
        hashed = entries.hashed_tiles(df)
        want, clustered = transcript(rows)
        got = sorted((r["tile_id"], r["run_length"], r["offset"], r["length"]) for r in entries.entries(hashed).collect())
        assert got == want and entries.statistics(hashed).first()["clustered"] == clustered


def test_strict_functions(spark):
    df = spark.createDataFrame([(2, 4, 0)], "z int, x long, y long")
    assert df.select(tiles.tile_id("z", "x", "y")).first()[0] is None and df.select(tiles.tile_id_bulk("z", "x", "y")).first()[0] is None
    with pytest.raises(Exception, match="InvalidCoordinate"):
        df.select(tiles.strict_tile_id("z", "x", "y")).collect()
    with pytest.raises(Exception, match="InvalidTileId"):
        df.select(tiles.strict_tile_zxy(F.lit(tiles.MAX_TILE_ID) + 1)).collect()


def test_stream_upsert(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("tile_id"), F.col("id").cast("string").cast("binary").alias("data")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, tile_id long, data binary").parquet(str(tmp_path / "in"))
    table = TileTable(str(tmp_path / "table"))
    q = table.sink(stream, str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["tile_id"], bytes(r["data"])) for r in table.current(spark).collect()) == [(0, b"9"), (1, b"7"), (2, b"8")]


def test_coverage_of_a_whole_table(spark, tmp_path):
    spark.createDataFrame([(k, "O") for k in (0, 1, 20000)], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(r["tile"] for r in QUERIES["coverage_missing"](spark, str(tmp_path)).collect())
    assert got == sorted(set(range(60001)) - {0, 3, 60000})


def test_empty_filter_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text <> ''")
    assert rows_of(QUERIES["empty_filter"](spark, DATA).select("doc_id")) == rows_of(docs.select("doc_id"))


def entry_table(spark, rows):
    """Entries (tile_id, run_length) in directory order."""
    return spark.createDataFrame([(t, n, 10 * i, 1, i) for i, (t, n) in enumerate(rows)], "tile_id long, run_length long, offset long, length long, grp long")


def test_only_the_nearest_entry_counts(spark):
    rows = entry_table(spark, [(0, 5), (2, 1), (9, 2), (9, 1)])
    wanted = spark.createDataFrame([(t,) for t in (0, 2, 3, 4, 5, 9, 10, 10, 11)], "tile long")
    assert sorted(r["tile"] for r in lookup.missing(rows, wanted).collect()) == [3, 4, 5, 10, 10, 11]
    assert sorted(r["tile"] for r in lookup.gaps(rows).collect()) == [5, 6, 7, 8]
    assert lookup.missing(rows.where("false"), wanted).count() == 9 and lookup.gaps(rows.where("false")).count() == 0


def test_long_runs_are_expanded_in_pieces(spark):
    rows = entry_table(spark, [(0, 200_000), (300_000, 1 << 40), (7, 0)])
    got = entries.expanded(rows.where("tile_id = 0")).agg(F.count("*"), F.min("tile"), F.max("tile"), F.countDistinct("tile")).first()
    assert tuple(got) == (200_000, 0, 199_999, 200_000)
    some = entries.expanded(rows, 199_990, 300_009).select("tile").collect()
    assert sorted(r["tile"] for r in some) == [*range(199_990, 200_000), *range(300_000, 300_010)]


def uneven(spark):
    """Ids of low zooms, one of zoom 22, and one that a third of the rows have."""
    far = tiles.pyramid_size(22) + 5
    rows = [(i * 7 % 4000, i) for i in range(4000)] + [(far, 4000)] + [(50, 5000 + i) for i in range(2000)]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "tile_id long, grp long")


def test_ranges_are_even(spark):
    rows, df = uneven(spark)
    sizes = [r["count"] for r in ordered.ranged(df, ["tile_id", "grp"], 16).groupBy("__range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * len(rows) / 16


def test_running_values_over_ranges(spark):
    rows, df = uneven(spark)
    order = ["tile_id", "grp"]
    line = ordered.ranged(df, order, 16)
    value = F.when(F.col("grp") % 3 == 0, F.col("grp"))
    found = [
        ordered.with_previous(line, order, ["grp"]).select(*order, F.col("previous.grp").alias("v")),
        *(ordered.with_running(line, order, {"v": (value, inclusive)}, how, once=inclusive).select(*order, "v") for how in ("sum", "max", "last") for inclusive in (True, False)),
    ]
    want, previous, seen = [[] for _ in found], None, []
    for t, g in sorted(rows):
        want[0].append((t, g, previous))
        now = [*seen, g] if g % 3 == 0 else seen
        for k, values in enumerate((now, seen)):
            want[1 + k].append((t, g, sum(values)))
            want[3 + k].append((t, g, max(values, default=None)))
            want[5 + k].append((t, g, values[-1] if values else None))
        previous, seen = g, now
    for got, expected in zip(found, want, strict=True):
        assert sorted(map(tuple, got.collect())) == expected


def test_scratch_tables(spark, monkeypatch):
    df = scratch.stored(spark.range(5))
    where = getattr(df, scratch._PATH).removeprefix("file:")
    assert os.path.exists(where) and df.count() == 5
    scratch.forget(df, spark.range(1))
    assert not os.path.exists(where)

    class Cluster:
        sparkContext = type("C", (), {"getCheckpointDir": lambda s: None, "getConf": lambda s: {}, "master": "local-cluster[3,2,1024]"})()
        conf: ClassVar[dict] = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Cluster())


def test_small_tables_go_to_all_cores(spark):
    assert scratch.evenly(spark.read.parquet(f"{DATA}/documents.parquet")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_joins_deal_out_a_hot_key(spark):
    rows = spark.range(3000).select((F.when(F.col("id") < 2000, 0).otherwise(F.col("id"))).alias("k"), F.col("id"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), mask("id"))
    out = dealt(rows, facts, ["k"], "id")
    assert out.where("k = 0").agg(F.count("*"), F.min("n"), F.max("n")).first() == (2000, 2000, 2000) and out.count() == 3000


def test_two_level_looks_inside_the_leaf(spark):
    # The root leads id 10 to leaf 1, which does not hold it; leaf 0 does.
    rows = spark.createDataFrame([(0, 1, 0, 1, 1, 0), (10, 1, 1, 1, 2, 0), (5, 1, 2, 1, 3, 1), (7, 2, 3, 1, 4, 1)], "tile_id long, run_length long, offset long, length long, grp long, leaf long")
    probes = spark.createDataFrame([(i, t) for i, t in enumerate([0, 5, 8, 9, 10])], "probe_id long, tile long")
    got = lookup.two_level(rows, directory.leaves(rows), probes).orderBy("probe_id").collect()
    assert [(r["leaf"], r["offset"], r["found"]) for r in got] == [(0, 0, True), (1, 2, True), (1, 3, True), (1, None, False), (1, None, False)]
