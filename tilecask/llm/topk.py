"""Exact top-k by inner product: tiled matrix products, partial selection in each tile, tree merging of the lists.

Candidates are packed into blocks of rows, queries into tiles; a tile and a block meet in one task as two matrices, by
an equi-join on the number of a group of blocks, to which every tile is copied. A task that gets many blocks for a tile
keeps the running lists of that tile only. The lists of a query from different groups are merged in a tree of fixed
fan-in. The stated query set against all rows is the whole work; nothing is approximate.

Components are first made integers, floor(scale * x). Sums below 2^53 are exact in float64; a tile and a block whose
norms allow more are multiplied as Python integers, and scores outside 64 bits are written as the nearest 64-bit number
(their order is kept). Vectors that are null, or hold null or non-finite components, take no part, nor do rows with a
null id; vectors of different lengths are not comparable and never meet. Ties go to the smaller id. Rows with one id
are candidates of their own, but none is a candidate of a query with its id. An empty table, or one without queries, gives
an empty one. Columns beyond id and vector are not looked at, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, TILE = 4096, 1024
#: Blocks of a group (they meet a tile in one task), and lists merged at once.
GROUP, FAN_IN = 16, 16


def _quantised(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    x = F.col(vector)
    fine = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ints = F.transform(x, lambda c: _floor(c.cast("double") * scale))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), F.size(x).alias("dim"), ints.alias("v"))


def _floor(c):
    """floor as a double: Spark's floor gives a long, which large components leave."""
    return F.when(F.abs(c) < 2.0**52, F.floor(F.when(F.abs(c) < 2.0**52, c).otherwise(0.0)).cast("double")).otherwise(c)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into matrices of at most ``size`` rows: dim, n, ids (binary), m (binary of doubles), norm."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, size):
                    piece = part.slice(at, size)
                    ids = piece.column("id").to_numpy()
                    m = piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
                    order = np.argsort(ids, kind="stable")
                    norm = float(np.abs(m).sum(1).max()) if dim else 0.0
                    top = float(np.abs(m).max()) if dim else 0.0
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([m[order].astype("<f8").tobytes()], pa.binary()), pa.array([norm]), pa.array([top])], ["dim", "n", "ids", "m", "norm", "top"])

    return rows.mapInArrow(run, "dim int, n int, ids binary, m binary, norm double, top double")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the ``k`` best columns of each row, in order: higher scores first, then smaller ids (ids sorted)."""
    n = scores.shape[1]
    if n > 4 * k:
        # Partial selection: everything above the k-th score stays, of its ties the first ones.
        kth = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(scores >= kth[:, None])
        s = scores[row, col]
    else:
        row, col = np.indices(scores.shape).reshape(2, -1)
        s = scores.ravel()
    order = np.lexsort((col, -s, row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def _tile_lists(k: int):
    low, high = -(1 << 63), (1 << 63) - 1

    def flush(key, lists):
        tile_ids, found = lists
        query, score, vec = [], [], []
        for q, rows in zip(tile_ids, found, strict=True):
            for s, v in rows:
                query.append(q)
                score.append(min(max(s, low), high))
                vec.append(v)
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array([key[1]] * len(query), pa.int64()), pa.array(score, pa.int64()), pa.array(vec, pa.int64())], ["query_id", "grp", "score", "vec_id"])

    def run(batches):
        key, lists = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["tile"], r["grp"]):
                    if lists:
                        yield flush(key, lists)
                    key = (r["tile"], r["grp"])
                    q_ids = np.frombuffer(r["q_ids"], "<i8")
                    q = np.frombuffer(r["q_m"], "<f8").reshape(len(q_ids), r["dim"])
                    lists = (q_ids.tolist(), [[] for _ in q_ids])
                ids = np.frombuffer(r["ids"], "<i8")
                c = np.frombuffer(r["m"], "<f8").reshape(len(ids), r["dim"])
                if min(r["q_norm"] * r["top"], r["norm"] * r["q_top"]) < 2.0**53:
                    scores = q @ c.T
                    own = q_ids[:, None] == ids[None, :]
                    scores[own] = -np.inf
                    row, col = best_of(scores, ids, k)
                else:  # beyond exact doubles: Python's integers
                    scores = np.array([[int(x) for x in v] for v in q], object) @ np.array([[int(x) for x in v] for v in c], object).T
                    own = q_ids[:, None] == ids[None, :]
                    scores[own] = -(1 << 2200)
                    order = [sorted(range(len(ids)), key=lambda j, s=s: (-s[j], j))[:k] for s in scores]
                    row, col = np.repeat(np.arange(len(q_ids)), [len(o) for o in order]), np.array([j for o in order for j in o], np.int64)
                fine = ~own[row, col]
                row, col = row[fine], col[fine]
                new = [int(s) for s in scores[row, col]]
                bounds = np.searchsorted(row, np.arange(len(q_ids) + 1))
                vec = ids[col].tolist()
                found = lists[1]
                for i in range(len(q_ids)):
                    a, b = bounds[i], bounds[i + 1]
                    if a < b:
                        found[i] = sorted([*found[i], *zip(new[a:b], vec[a:b], strict=True)], key=lambda p: (-p[0], p[1]))[:k]
        if lists:
            yield flush(key, lists)

    return run


def top_k(rows: DataFrame, is_query, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best other rows for each row where ``is_query`` holds."""
    from .common import forget, written

    spark = rows.sparkSession
    candidates = written(_packed(_quantised(rows, vec_id, vector, scale), BLOCK))
    asked = _quantised(rows.where(is_query), vec_id, vector, scale)
    queries = _packed(asked.repartition(max(1, -(-asked.count() // TILE))), TILE)
    number = lambda df, name: df.withColumn(name, F.monotonically_increasing_id())
    tiles = written(number(queries, "tile").withColumnsRenamed({"ids": "q_ids", "m": "q_m", "norm": "q_norm", "top": "q_top", "n": "q_n"}))
    n_groups = max(1, -(-candidates.count() // GROUP))
    grouped = candidates.withColumn("grp", F.pmod(F.xxhash64("ids"), F.lit(n_groups)))
    sent = tiles.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    met = sent.join(grouped.select("grp", "dim", "ids", "m", "norm", "top"), ["grp", "dim"]).sortWithinPartitions("tile", "grp")
    lists = met.mapInArrow(_tile_lists(k), "query_id long, grp long, score long, vec_id long")
    lists = written(lists, records=16)  # rows are matrices: few of them at once go to Python
    forget(candidates, tiles)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))))
    while n_groups > FAN_IN:
        n_groups = -(-n_groups // FAN_IN)
        merged = lists.withColumn("grp", F.col("grp") % n_groups).groupBy("query_id", "grp").agg(F.slice(ordered, 1, k).alias("b"))
        lists = merged.select("query_id", "grp", F.explode("b").alias("b")).select("query_id", "grp", (-F.col("b.s")).alias("score"), F.col("b.v").alias("vec_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
