"""The engine's operators as queries over the test tables, and the same in SQL for DuckDB.

The tables hold no archives, so tiles are derived from them: ``ev`` (runs), ``doc`` (equal contents), ``ord`` (ids with
gaps) and ``li`` (coordinates in no order).
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import cache
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conditions import CASES, raised
from .functions import codes, tiles
from .functions.codec import Header
from .operators import directory, entries, lookup
from .plans.ordered import plain, ranged, with_running
from .plans.scratch import evenly, shared_dir
from .sources.datasource import HEADER, entries_at, read_archive, tilejson, tiles_at
from .sources.ranges import FileRanges, Ranges
from .sources.writer import new_header, write_archive

LI_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
#: The first id of zoom 8.
ZOOM_8 = tiles.pyramid_size(8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinates(spark: SparkSession, d: str) -> DataFrame:
    """z, x, y of each line item."""
    li = evenly(table(spark, d, "lineitem")).withColumn("z", (F.col("l_linenumber") % 7 + 8).cast("int"))
    side = F.expr("shiftleft(1L, z)")
    return li.withColumn("x", F.col("l_partkey") % side).withColumn("y", F.col("l_suppkey") % side)


def tiles_of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """seq, tile_id, data of a derived set of tiles."""
    if kind == "ev":
        return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_id").alias("tile_id"), F.col("event_type").alias("data"))
    if kind == "doc":
        return table(spark, d, "documents").select(F.col("doc_id").alias("seq"), (F.col("doc_id") + ZOOM_8).alias("tile_id"), F.col("text").alias("data"))
    if kind == "ord":
        return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 3).alias("tile_id"), F.col("o_orderstatus").alias("data"))
    li = plain(with_running(ranged(coordinates(spark, d).select("z", "x", "y", *LI_ORDER, "l_returnflag", "l_linestatus"), LI_ORDER), LI_ORDER, {"seq": (F.lit(1), True)}))
    return li.select("seq", tiles.tile_id_bulk("z", "x", "y").alias("tile_id"), F.concat_ws("-", F.col("l_returnflag"), F.col("l_linestatus")).alias("data"))


def hashed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return entries.hashed_tiles(tiles_of(spark, d, kind))


def entry_rows(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return entries.entries(hashed(spark, d, kind))


TILES_SQL = {
    "ev": "select event_id as seq, event_id as tile_id, event_type as data from events",
    "doc": f"select doc_id as seq, doc_id + {ZOOM_8} as tile_id, text as data from documents",
    "ord": "select o_orderkey as seq, o_orderkey * 3 as tile_id, o_orderstatus as data from orders",
}
COORDINATES_SQL = "select *, l_partkey % (1 << z) as x, l_suppkey % (1 << z) as y from (select *, 8 + l_linenumber % 7 as z from lineitem)"
#: The curve, level by level: coordinates ``c`` (z, x, y) to ``h`` (z, x, y, tile).
HILBERT_SQL = """
    walk(z, x0, y0, s, x, y, d) as (
        select z, x, y, z - 1, x, y, 0::bigint from c
        union all
        select z, x0, y0, s - 1,
            case when ry = 0 then fy else fx end, case when ry = 0 then fx else fy end, d + (1::bigint << (2 * s)) * xor(3 * rx, ry)
        from (
            select *, case when ry = 0 and rx = 1 then (1::bigint << s) - 1 - (x & ((1::bigint << s) - 1)) else x end as fx,
                      case when ry = 0 and rx = 1 then (1::bigint << s) - 1 - (y & ((1::bigint << s) - 1)) else y end as fy
            from (select *, (x >> s) & 1 as rx, (y >> s) & 1 as ry from walk where s >= 0)
        )
    ), h as (select z, x0 as x, y0 as y, cast(((1::bigint << (2 * z)) - 1) // 3 + d as bigint) as tile from walk where s = -1)
"""
TILES_SQL["li"] = f"""
    with recursive n as (select *, row_number() over (order by {", ".join(LI_ORDER)}) as seq from ({COORDINATES_SQL})),
    c as (select distinct z, x, y from n), {HILBERT_SQL}
    select seq, tile as tile_id, l_returnflag || '-' || l_linestatus as data from n join h using (z, x, y)
"""


def core_sql(kind: str) -> str:
    """Common table expressions t, n, m, r, e, o: tiles, not empty ones, marked rows, runs, entries, contents."""
    return f"""
        t as ({TILES_SQL[kind]}),
        n as (select seq, tile_id, sha256(data) as hash, octet_length(encode(data)) as len from t where octet_length(encode(data)) > 0),
        m as (select *, case when lag(hash) over w = hash and tile_id = lag(tile_id) over w + 1 then 0 else 1 end as s, coalesce(tile_id > lag(tile_id) over w, true) as ok from n window w as (order by seq)),
        r as (select *, sum(s) over (order by seq) as grp from m),
        e as (select cast(grp as bigint) as grp, min(tile_id) as tile_id, count(*) as run_length, min(hash) as hash from r group by grp),
        c0 as (select hash, min(seq) as first_seq, cast(min(len) as bigint) as length, count(*) as n_refs from n group by hash),
        o as (select *, cast(coalesce(sum(length) over (order by first_seq rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from c0),
        f as (select tile_id, run_length, "offset", length, grp from e join o using (hash))
    """


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Line items by zoom: how many, and the lowest and highest id. In numpy, as the fold in SQL (``tile_id_encode`` is
    that one) takes over twice the time: Spark interprets its lambda for every zoom of every row."""
    rows = coordinates(spark, d).select("z", tiles.tile_id_bulk("z", "x", "y").alias("tile"))
    return rows.groupBy("z").agg(F.count("*").alias("n"), F.min("tile").alias("low"), F.max("tile").alias("high"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


query(f"with recursive c as (select distinct z, x, y from ({COORDINATES_SQL})), {HILBERT_SQL}, all_rows as (select z, tile from ({COORDINATES_SQL}) join h using (z, x, y)) select cast(z as integer) as z, count(*) as n, min(tile) as low, max(tile) as high from all_rows group by z", "zoom_summary")(entry)


@query(f"with recursive c as (select distinct z, x, y from ({COORDINATES_SQL})), {HILBERT_SQL} select cast(z as integer) as z, x, y, tile from h")
def tile_id_encode(spark, d):
    return coordinates(spark, d).select("z", "x", "y").distinct().select("z", "x", "y", tiles.tile_id("z", "x", "y").alias("tile"))


@query(f"with recursive c as (select distinct z, x, y from ({COORDINATES_SQL})), {HILBERT_SQL} select cast(z as integer) as z, x, y, tile from h")
def tile_id_encode_bulk(spark, d):
    return coordinates(spark, d).select("z", "x", "y").distinct().select("z", "x", "y", tiles.tile_id_bulk("z", "x", "y").alias("tile"))


DECODE_SQL = """
    with recursive i as (select distinct l_partkey * 100 + l_suppkey as tile from lineitem),
    zoomed as (select tile, (select max(g) from range(0, 32) r(g) where ((1::hugeint << (2 * g)) - 1) // 3 <= tile) as z from i),
    walk(tile, z, s, x, y, t) as (
        select tile, z, 0::bigint, 0::bigint, 0::bigint, tile - cast(((1::hugeint << (2 * z)) - 1) // 3 as bigint) from zoomed
        union all
        select tile, z, s + 1, case when ry = 0 then fy else fx end + (rx << s), case when ry = 0 then fx else fy end + (ry << s), t >> 2
        from (
            select *, case when ry = 0 and rx = 1 then (1::bigint << s) - 1 - x else x end as fx, case when ry = 0 and rx = 1 then (1::bigint << s) - 1 - y else y end as fy
            from (select *, (t >> 1) & 1 as rx, xor(t, (t >> 1) & 1) & 1 as ry from walk where s < z)
        )
    )
    select tile, cast(z as integer) as z, x, y from walk where s = z
"""


def _some_ids(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("tile")).distinct()


@query(DECODE_SQL)
def tile_id_decode(spark, d):
    return _some_ids(spark, d).select("tile", tiles.tile_zxy("tile").alias("c")).select("tile", "c.*")


@query(DECODE_SQL)
def tile_id_decode_bulk(spark, d):
    return _some_ids(spark, d).select("tile", tiles.tile_zxy_bulk("tile").alias("c")).select("tile", "c.*")


@query("select o_orderkey, cast((select max(g) from range(0, 32) r(g) where ((1::hugeint << (2 * g)) - 1) // 3 <= o_orderkey * 3) as integer) as z from orders")
def tile_zoom_of_id(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tiles.tile_zoom(F.col("o_orderkey") * 3).alias("z"))


@query("""
    select z, x, y, z between 0 and 31 and x >= 0 and y >= 0 and x < (1::bigint << greatest(0, least(z, 31))) and y < (1::bigint << greatest(0, least(z, 31))) as valid,
           x * 6148914691236 between 0 and 6148914691236517204 as valid_id
    from (select distinct l_linenumber * 6 - 8 as z, l_partkey - 50 as x, l_suppkey - 3 as y from lineitem)
""")
def coord_validity(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") * 6 - 8).alias("z"), (F.col("l_partkey") - 50).alias("x"), (F.col("l_suppkey") - 3).alias("y")).distinct()
    return rows.select("z", "x", "y", tiles.is_coordinate("z", "x", "y").alias("valid"), tiles.is_tile_id(F.col("x") * 6148914691236).alias("valid_id"))


@query(f"select coalesce(cast(z as integer), -1) as z, coalesce(l_returnflag, 'all') as flag, count(*) as n, count(distinct (x, y)) as places from ({COORDINATES_SQL}) group by rollup (z, l_returnflag)")
def zoom_rollup(spark, d):
    return coordinates(spark, d).rollup("z", "l_returnflag").agg(F.count("*").alias("n"), F.countDistinct(F.struct("x", "y")).alias("places")).select(F.coalesce("z", F.lit(-1)).alias("z"), F.coalesce("l_returnflag", F.lit("all")).alias("flag"), "n", "places")


for _kind, _name in (("ev", "events"), ("ord", "orders")):
    query(f"with {core_sql(_kind)} select grp, tile_id, run_length, hash from e", f"rle_entries_{_name}")(lambda spark, d, k=_kind: entries.runs(hashed(spark, d, k)))


@query(f"with {core_sql('doc')} select hash, first_seq, length, n_refs, \"offset\" from o")
def dedup_contents_docs(spark, d):
    return entries.contents(hashed(spark, d, "doc")).select("hash", "first_seq", "length", "n_refs", "offset")


for _kind in ("ev", "doc", "ord", "li"):
    query(f"with {core_sql(_kind)} select * from f", f"writer_entries_{_kind}")(lambda spark, d, k=_kind: entry_rows(spark, d, k))
    query(
        f"""with {core_sql(_kind)} select count(*) as n_addressed_tiles, cast(sum(s) as bigint) as n_tile_entries, bool_and(ok) as clustered,
            (select count(*) from o) as n_tile_contents, (select cast(sum(length) as bigint) from o) as data_length from m""",
        f"header_stats_{_kind}",
    )(lambda spark, d, k=_kind: entries.statistics(hashed(spark, d, k)))


def _probes(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("probe_id"), (F.col("o_orderkey") * 3 + F.col("o_custkey") % 3).alias("tile"))


#: Nulls are written as -1: not all clients tell a column of numbers and nulls from one of fractions.
KNOWN = 'probe_id, tile, coalesce("offset", -1) as "offset", coalesce(length, -1) as length, found'


def _known(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("offset", "length")})


LOOKUP_SQL = """
    p as (select o_orderkey as probe_id, o_orderkey * 3 + o_custkey % 3 as tile from orders),
    one as (select * from f qualify row_number() over (partition by tile_id order by grp desc) = 1),
    j as (select probe_id, tile, one.*, tile - one.tile_id < run_length or tile = one.tile_id as ok from p asof left join one on p.tile >= one.tile_id),
    got as (select probe_id, tile, case when ok then "offset" end as "offset", case when ok then length end as length, coalesce(ok, false) as found from j)
"""


@query(f"with {core_sql('ord')}, {LOOKUP_SQL} select {KNOWN} from got")
def lookup_asof(spark, d):
    return _known(lookup.lookup(entry_rows(spark, d, "ord"), _probes(spark, d)))


@query(f"with {core_sql('ev')}, {LOOKUP_SQL} select {KNOWN} from got")
def lookup_runs(spark, d):
    return _known(lookup.lookup(entry_rows(spark, d, "ev"), _probes(spark, d)))


@query(f"with {core_sql('ord')}, {LOOKUP_SQL} select tile from got where not found")
def lookup_missing(spark, d):
    return lookup.missing(entry_rows(spark, d, "ord"), _probes(spark, d).select("tile"))


LEAF = 500
CHUNK_SQL = f"k as (select *, row_number() over (order by tile_id, grp) - 1 as ordinal from f), l as (select *, ordinal // {LEAF} as leaf from k)"


@query(f"with {core_sql('ord')}, {LOOKUP_SQL}, {CHUNK_SQL}, first as (select leaf, min(tile_id) as first from l group by leaf) select {KNOWN}, leaf from got asof left join first on got.tile >= first.first")
def lookup_two_level(spark, d):
    rows = directory.chunked(directory.numbered(entry_rows(spark, d, "ord")), LEAF)
    return _known(lookup.two_level(rows, directory.leaves(rows), _probes(spark, d)))


@query(f"with {core_sql('ev')} select unnest(range(tile_id, tile_id + run_length)) as tile, \"offset\", length from f")
def entries_expand(spark, d):
    return entries.expanded(entry_rows(spark, d, "ev")).select("tile", "offset", "length")


@query(f"with {core_sql('ev')}, {CHUNK_SQL} select leaf, min(tile_id) as first, count(*) as n, cast(sum(run_length) as bigint) as tiles from l group by leaf")
def leaf_chunks(spark, d):
    return directory.leaves(directory.chunked(directory.numbered(entry_rows(spark, d, "ev")), LEAF))


@query(f"""with recursive {core_sql('doc')}, {CHUNK_SQL} select ordinal, tile_id - coalesce(lag(tile_id) over w, 0) as delta, run_length, length,
           case when "offset" = lag("offset") over w + lag(length) over w then 0 else "offset" + 1 end as stored_offset from k window w as (order by ordinal)""")
def dir_encode(spark, d):
    return plain(directory.encoded(directory.numbered(entry_rows(spark, d, "doc"))))


@query(f"with {core_sql('doc')}, {CHUNK_SQL} select ordinal, tile_id, run_length, \"offset\", length from k")
def dir_restore(spark, d):
    return directory.decoded(directory.encoded(directory.numbered(entry_rows(spark, d, "doc"))))


@query(f"with recursive {core_sql('li')}, {CHUNK_SQL} select ordinal, tile_id, run_length, \"offset\", length from k")
def unclustered_sort(spark, d):
    return directory.numbered(entry_rows(spark, d, "li")).select("ordinal", "tile_id", "run_length", "offset", "length")


@query("""
    select c_custkey, e7, cast(e7 as double) / 10000000.0 as degrees from (
        select c_custkey, cast(greatest(least(sign(v) * floor(abs(v) + 0.5), 2147483647), -2147483648) as integer) as e7 from (select c_custkey, c_acctbal / 30.0 * 10000000 as v from customer)
    )
""")
def fixed_point(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", codes.to_e7(F.col("c_acctbal") / 30.0).alias("e7"))
    return rows.withColumn("degrees", codes.from_e7(F.col("e7")))


def _case(value: str, rows: list, key: int, out: int) -> str:
    return f"case {value} " + " ".join(f"when {r[key]!r} then {r[out]!r}" for r in rows if r[out]) + " end"


@query(f"select p_partkey, {_case('p_size % 7', codes.TILE_TYPES, 0, 1)} as name, {_case('p_size % 7', codes.TILE_TYPES, 0, 2)} as mime from part")
def enum_mime(spark, d):
    rows = table(spark, d, "part").select("p_partkey", codes.tile_type_name(F.col("p_size") % 7).alias("name"))
    return rows.withColumn("mime", codes.content_type(F.col("name")))


@query(f"select p_partkey, {_case('p_size % 5', codes.COMPRESSIONS, 0, 1)} as name, {_case('p_size % 5', codes.COMPRESSIONS, 0, 2)} as encoding from part")
def enum_encoding(spark, d):
    rows = table(spark, d, "part").select("p_partkey", codes.compression_name(F.col("p_size") % 5).alias("name"))
    return rows.withColumn("encoding", codes.content_encoding(F.col("name")))


@query("""
    select event_id, event_type as name, event_id % 5 as minzoom, 22 as maxzoom, cast(event_id % 9 as varchar) as other_maxzoom, json_extract_string(props, '$.k') as other_k, 'u' as tiles,
           '-180.0,-85.051129,180.0,85.051129' as bounds from events
""")
def tilejson_merge(spark, d):
    """A document for each event: a header, and metadata with a text field, a text that the header owns (dropped), a
    number of that name and an object (both of which have no field of their own and go to ``other``)."""
    low = (F.col("event_id") % 5).cast("long")
    fields = {n: F.lit(v).cast("long") if v is None else F.lit(v) for n, v in Header().row().items()} | {"min_zoom": low}
    header = F.struct(*(v.alias(n) for n, v in fields.items())).cast(HEADER)
    metadata = F.concat(F.lit('{"name":'), F.to_json(F.struct("event_type")).substr(F.lit(15), F.length("event_type") + 2), F.lit(',"minzoom":"7","maxzoom":'), (F.col("event_id") % 9).cast("string"), F.lit(',"props":'), F.col("props"), F.lit("}"))
    rows = evenly(table(spark, d, "events")).select(F.col("event_id").cast("string").alias("archive_path"), header.alias("header"), metadata.alias("metadata"))
    at = lambda path: F.get_json_object("tilejson", path)
    return tilejson(rows, ["u"]).select(
        F.col("archive_path").cast("long").alias("event_id"), at("$.name").alias("name"), at("$.minzoom").cast("long").alias("minzoom"), at("$.maxzoom").cast("int").alias("maxzoom"), at("$.other.maxzoom").alias("other_maxzoom"),
        at("$.other.props.k").alias("other_k"), at("$.tiles[0]").alias("tiles"), F.array_join(F.from_json(at("$.bounds"), "array<string>"), ",").alias("bounds"),
    )


@query("select doc_id, octet_length(encode(text)) as n from documents where text <> ''")
def empty_filter(spark, d):
    """All texts, with an empty tile beside each."""
    docs = tiles_of(spark, d, "doc")
    rows = docs.unionByName(docs.withColumn("data", F.lit("")))
    return entries.hashed_tiles(rows).select(F.col("seq").alias("doc_id"), F.col("length").alias("n"))


@query(f"with {core_sql('ev')} select count(*) * 24 as bytes from f")
def approximate_size(spark, d):
    return entries.approximate_size(entry_rows(spark, d, "ev"))


@query("select g as tile from (select unnest(range(0, (select max(o_orderkey) * 3 + 1 from orders))) as g) where g not in (select o_orderkey * 3 from orders)")
def coverage_missing(spark, d):
    """All ids from 0 to the greatest covered id that no entry covers."""
    return lookup.gaps(entry_rows(spark, d, "ord"))


def _two(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("tile"), F.col("event_type").alias("hash"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("tile"), F.when(F.col("o_orderkey") % 5 == 0, "click").otherwise(F.col("o_orderstatus")).alias("hash"))
    return ev, orders


TWO_SQL = "a as (select event_id as tile, event_type as hash from events), b as (select o_orderkey as tile, case when o_orderkey % 5 = 0 then 'click' else o_orderstatus end as hash from orders)"


@query(f"with {TWO_SQL} select tile, case when a.hash is null then 'added' when b.hash is null then 'removed' else 'changed' end as change from a full join b using (tile) where a.hash is distinct from b.hash")
def archive_diff(spark, d):
    return lookup.diff(*_two(spark, d))


@query(f"with {TWO_SQL} select tile, coalesce(b.hash, a.hash) as hash from a full join b using (tile)")
def archive_merge(spark, d):
    return lookup.merge(*_two(spark, d))


def _shared(spark) -> str:
    """A local path in the folder that driver and executors share."""
    return urlparse(shared_dir(spark)).path


def _new_path(spark) -> str:
    return f"{_shared(spark)}/{uuid.uuid4().hex}.archive"


_written: dict[tuple, str] = {}


def _archive(spark, d: str, kind: str) -> str:
    """An archive of derived tiles, not compressed, so that ``ord`` has leaves; written once in a session, for the
    queries that read."""
    key = spark.sparkContext.applicationId, d, kind
    if key not in _written:
        path = _new_path(spark)
        write_archive(tiles_of(spark, d, kind), path, new_header("Png", internal_compression="None"))
        _written[key] = path
    return _written[key]


def _round_trip(spark, d, kind: str, header, **how) -> DataFrame:
    """Writes an archive and reads its tiles back, each with what the archive's header says."""
    path = _new_path(spark)
    write_archive(tiles_of(spark, d, kind), path, header, **how)
    return _tiles_and_header(spark, path)


COUNTS = ["tile_type", "tile_compression", "internal_compression", "n_addressed_tiles", "n_tile_entries", "n_tile_contents", "clustered", "data_length"]


def _tiles_and_header(spark, path: str, **options) -> DataFrame:
    rows = read_archive(spark, path, "tiles", decompress="true", **options).select("archive_path", "tile_id", F.col("data").cast("string").alias("data"))
    headers = read_archive(spark, path, "archives", **options).select("archive_path", *(f"header.{c}" for c in COUNTS[:-1]))
    return rows.join(F.broadcast(headers), "archive_path").drop("archive_path")  # one row


def _header_sql(kind: str, tile_type: str, tile: str, internal: str) -> str:
    """The tiles of a kind with the header that an archive of them has."""
    return f"""with {core_sql(kind)} select tile_id, data, '{tile_type}' as tile_type, '{tile}' as tile_compression, '{internal}' as internal_compression,
        (select count(*) from n) as n_addressed_tiles, (select count(*) from e) as n_tile_entries, (select count(*) from o) as n_tile_contents, (select bool_and(ok) from m) as clustered
        from t where data <> ''"""


@query(_header_sql("ev", "Mvt", "Gzip", "Gzip"))
def roundtrip_archive_events(spark, d):
    return _round_trip(spark, d, "ev", new_header("Mvt"))


@query(_header_sql("doc", "Png", "Zstd", "Zstd"))
def roundtrip_archive_docs(spark, d):
    return _round_trip(spark, d, "doc", new_header("Png", tile_compression="Zstd", internal_compression="Zstd"))


@query(_header_sql("ord", "Unknown", "None", "None"))
def roundtrip_archive_leaves(spark, d):
    return _round_trip(spark, d, "ord", new_header("Unknown", internal_compression="None"))


@query(_header_sql("ev", "Webp", "Gzip", "None"))
def roundtrip_codec_tile(spark, d):
    """A compressor of one's own; the header names what it makes, whatever it said before."""
    return _round_trip(spark, d, "ev", new_header("Webp", tile_compression="None", internal_compression="None"), tile_codec="Gzip=gzip:compress")


@query(_header_sql("ord", "Avif", "None", "Zstd"))
def roundtrip_codec_internal(spark, d):
    return _round_trip(spark, d, "ord", new_header("Avif"), internal_codec="Zstd")


@query(_header_sql("ord", "Jpeg", "Zstd", "Gzip"))
def roundtrip_sink(spark, d):
    """``df.write`` with the data source."""
    from .sources.datasource import register

    register(spark)
    path = _new_path(spark)
    tiles_of(spark, d, "ord").write.format("tilearchive").mode("overwrite").options(tile_type="Jpeg", tile_codec="Zstd").save(path)
    return _tiles_and_header(spark, path)


@query("select event_id as tile_id, event_id % 2 = 0 as is_raw, case when event_id % 2 = 0 then event_type || '-raw' else '1f8b' end as stored from events")
def roundtrip_raw(spark, d):
    """Raw tiles are stored as they are, others compressed: their stored bytes begin like gzip."""
    path = _new_path(spark)
    rows = tiles_of(spark, d, "ev").withColumn("is_raw", F.col("tile_id") % 2 == 0)
    write_archive(rows.withColumn("data", F.when(F.col("is_raw"), F.concat("data", F.lit("-raw"))).otherwise(F.col("data"))), path, new_header("Mvt"))
    stored = F.when(F.col("tile_id") % 2 == 0, F.col("data").cast("string")).otherwise(F.lower(F.hex(F.substring("data", 1, 2))))
    return read_archive(spark, path, "tiles").select("tile_id", (F.col("tile_id") % 2 == 0).alias("is_raw"), stored.alias("stored"))


BOX = dict(min_zoom=3, max_zoom=9, min_longitude=-10.5, min_latitude=-20.25, max_longitude=30.125, max_latitude=40.0, center_zoom=5, center_longitude=1.5, center_latitude=2.0000001)
TOLD = '{"name": "events", "note": "not looked at"}'


@query(f"""
    with {core_sql("ev")} select cast(3 as bigint) as version, 'Webp' as tile_type, 'image/webp' as mime, 'None' as tile_compression, cast(null as varchar) as encoding, 'Zstd' as internal_compression, cast(3 as bigint) as min_zoom, cast(9 as bigint) as max_zoom,
        '-10.5,-20.25,30.125,40.0' as bounds, '1.5,2.0000001,5' as center, '{TOLD}' as metadata, count(*) as n_addressed_tiles, cast(sum(s) as bigint) as n_tile_entries, bool_and(ok) as clustered,
        (select count(*) from o) as n_tile_contents, (select cast(sum(length) as bigint) from o) as data_length from m
""")
def archives_table(spark, d):
    """Header and metadata as they were given, statistics as they were counted."""
    path = _new_path(spark)
    write_archive(tiles_of(spark, d, "ev"), path, new_header("Webp", internal_compression="Zstd", **BOX), metadata=TOLD)
    h = F.col("header")
    text = lambda c: c.cast("string")
    center = codes.center(h)
    return read_archive(spark, path, "archives").select(
        *(h[c].alias(c) for c in ("version", "min_zoom", "max_zoom", *COUNTS)), "metadata", codes.content_type(h["tile_type"]).alias("mime"), codes.content_encoding(h["tile_compression"]).alias("encoding"),
        F.array_join(codes.bounds(h).cast("array<string>"), ",").alias("bounds"), F.concat_ws(",", text(center["longitude"]), text(center["latitude"]), text(center["zoom"])).alias("center"),
    )


@query(f"with {core_sql('ev')} select tile_id, run_length, \"offset\", length from f")
def archive_entries_scan(spark, d):
    return read_archive(spark, _archive(spark, d, "ev"), "entries").select("tile_id", "run_length", "offset", "length")


@query(f"with {core_sql('ord')}, {CHUNK_SQL} select tile_id, ordinal // 4096 as leaf, ordinal % 4096 as ordinal, cast(case when (select count(*) from f) > 4096 then 1 else 0 end as integer) as level from k")
def archive_entries_order(spark, d):
    """Directory, place in it and level of each entry: the order of a scan, level by level."""
    rows = read_archive(spark, _archive(spark, d, "ord"), "entries")
    leaves = rows.groupBy("dir_offset").agg(F.min("tile_id").alias("first")).orderBy("first").collect()  # at most some 3,500
    number = spark.createDataFrame([(r["dir_offset"], i) for i, r in enumerate(leaves)] or [(0, 0)], "dir_offset long, leaf long")
    return rows.join(F.broadcast(number), "dir_offset").select("tile_id", "leaf", "ordinal", "level")


@query(f"with {core_sql('ord')}, {LOOKUP_SQL} select {KNOWN} from got")
def lookup_recursive(spark, d):
    """Through the archive's own leaves, of which a task reads those on the way to its tiles."""
    return _known(entries_at(_probes(spark, d), _archive(spark, d, "ord")))


@query("select p.o_orderkey as probe_id, p.o_orderkey * 3 + p.o_custkey % 3 as tile, coalesce(t.o_orderstatus, '') as data from orders p left join orders t on p.o_orderkey * 3 + p.o_custkey % 3 = t.o_orderkey * 3")
def point_lookup_pruned(spark, d):
    """The stored bytes of probed tiles."""
    found = tiles_at(_probes(spark, d), _archive(spark, d, "ord"))
    return found.withColumn("data", F.coalesce(F.col("data").cast("string"), F.lit("")))


@query("select o_orderkey * 3 as tile_id, o_orderstatus as data from orders where o_orderkey * 3 between (select max(o_orderkey) from orders) and (select max(o_orderkey) * 2 from orders)")
def leaf_pruning(spark, d):
    """The middle third of the ids: leaves beyond it are not read."""
    top = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    return read_archive(spark, _archive(spark, d, "ord"), "tiles", low=top, high=top * 2).select("tile_id", F.col("data").cast("string").alias("data"))


class _Served(BaseHTTPRequestHandler):
    """Ranges of files, for the query that reads a web server."""

    def do_GET(self):
        low, high = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        data, version = FileRanges(self.path).read(low, high - low + 1)
        self.send_response(206)
        self.send_header("ETag", version)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a): ...


@cache
def _server() -> int:
    server = ThreadingHTTPServer(("", 0), _Served)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server.server_port


def plain_file(path: str) -> Ranges:
    """A store of one's own."""
    return FileRanges(path)


ORD_SQL = "select o_orderkey * 3 as tile_id, o_orderstatus as data from orders"


def _ord_tiles(spark, path: str, **options) -> DataFrame:
    return read_archive(spark, path, "tiles", **options).select("tile_id", F.col("data").cast("string").alias("data"))


@query(ORD_SQL)
def archive_over_http(spark, d):
    return _ord_tiles(spark, f"http://{spark.conf.get('spark.driver.host')}:{_server()}{_archive(spark, d, 'ord')}")


@query(ORD_SQL)
def archive_of_object_store(spark, d):
    return _ord_tiles(spark, f"file://{_archive(spark, d, 'ord')}", ranges="object")


@query(ORD_SQL)
def archive_of_own_store(spark, d):
    return _ord_tiles(spark, _archive(spark, d, "ord"), ranges="tilecask.queries:plain_file", cache="tilecask.sources.archive:DictCache")


@query("select * from (values " + ", ".join(f"('{c}', '{e.__name__}')" for c, (_, e) in CASES.items()) + ") t(condition, error)")
def error_conditions(spark, d):
    """Each condition is brought about in a task."""
    told = F.udf(raised, "string", useArrow=False)  # a row for each condition
    return spark.createDataFrame([(c,) for c in CASES], "condition string").withColumn("error", told("condition"))


OVERLAP_SQL = """
    f as (select o_orderkey * 2 as tile_id, 1 + o_custkey % 7 as run_length, o_orderkey as grp, o_orderkey * 10 as "offset", o_custkey as length from orders),
"""


@query(f"with {OVERLAP_SQL} {LOOKUP_SQL} select {KNOWN} from got")
def lookup_overlapping(spark, d):
    """Runs that overlap: only the nearest entry counts, an id that an earlier, longer run covers is not found."""
    orders = table(spark, d, "orders")
    rows = orders.select((F.col("o_orderkey") * 2).alias("tile_id"), (F.col("o_custkey") % 7 + 1).alias("run_length"), F.col("o_orderkey").alias("grp"), (F.col("o_orderkey") * 10).alias("offset"), F.col("o_custkey").alias("length"))
    return _known(lookup.lookup(rows, _probes(spark, d)))


@query("select date_trunc('hour', ts) as hour, event_id % 64 as tile_id, count(*) as n from events group by all")
def tile_events_windowed(spark, d):
    """The batch form of the streaming counts."""
    from .streaming.upsert import windowed_counts

    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 64).alias("tile"))
    return windowed_counts(rows, "ts", "tile").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "tile_id", "n")
