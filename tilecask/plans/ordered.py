"""Running sums, maxima, last values and previous rows over a whole table, without gathering it in one partition.

A window without a key plans one partition for all rows. Here rows are range-partitioned by the whole order, so that
ranges have about equal numbers of rows however uneven the first column is (its ties are split by the others), and
stored once with the number of their range. Ranges are summed up in a small table, one row each, and windows run inside
a range. What crosses a range's border comes from that table. There are at most ``spark.sql.shuffle.partitions`` ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

_RANGE = "__range"


def ranged(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` stored with the number of each row's range; nulls come first. ``order`` should be unique.

    What is ranged already is taken as it is: its order must go on to hold.
    """
    if _RANGE in df.columns:
        return df
    by = [F.col(c).asc_nulls_first() for c in order]
    cut = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return stored(cut.withColumn(_RANGE, F.spark_partition_id()))


def _inside(order: list[str]):
    return Window.partitionBy(_RANGE).orderBy(*order)


def _last(value: Column | str) -> Column:
    return F.last(value, ignorenulls=True)


def with_running(df: DataFrame, order: list[str], wanted: dict[str, tuple[Column, bool]], how: str = "sum", once: bool = False) -> DataFrame:
    """``df`` (ranged) with a column for each of ``wanted``: the sum, maximum (``max``) or last value that is not null
    (``last``) of a value over all rows before, and the row itself where it is inclusive.

    ``once``: rows are stored with the values inside their range first, as ``df`` takes windows of its own to compute.
    """
    of = {"sum": F.sum, "max": F.max, "last": _last}[how]
    names = list(wanted)
    rows = df.withColumns({f"__v{i}": wanted[n][0] for i, n in enumerate(names)})
    total = [F.max_by(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), F.struct(*order))) if how == "last" else of(f"__v{i}") for i in range(len(names))]

    def inside(i: int) -> Column:
        return of(f"__v{i}").over(_inside(order).rowsBetween(Window.unboundedPreceding, 0 if wanted[names[i]][1] else -1))

    if once:
        rows = stored(rows.withColumns({f"__h{i}": inside(i) for i in range(len(names))}))
    totals = rows.groupBy(_RANGE).agg(*(t.alias(f"__t{i}") for i, t in enumerate(total)))
    over = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    starts = totals.select(_RANGE, *(of(f"__t{i}").over(over).alias(f"__s{i}") for i in range(len(names))))

    def value(i: int) -> Column:
        here, before = F.col(f"__h{i}") if once else inside(i), F.col(f"__s{i}")
        if how == "sum":
            return (F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))).cast("long")
        return F.greatest(before, here) if how == "max" else F.coalesce(here, before)

    out = rows.join(F.broadcast(starts), _RANGE).withColumns({n: value(i) for i, n in enumerate(names)})
    return out.drop(*(f"__{k}{i}" for k in "vhs" for i in range(len(names))))


def with_previous(df: DataFrame, order: list[str], columns: list[str], into: str = "previous") -> DataFrame:
    """``df`` (ranged) with a struct of ``columns`` of the row before, null for the first row."""
    own = F.struct(*columns)
    last = df.groupBy(_RANGE).agg(F.max_by(own, F.struct(*order)).alias("__last"))
    before = last.select(_RANGE, F.lag("__last").over(Window.orderBy(_RANGE)).alias("__before"))  # one row for each range
    inside = F.lag(own).over(_inside(order))
    first = F.row_number().over(_inside(order)) == 1
    return df.join(F.broadcast(before), _RANGE).withColumn(into, F.when(first, F.col("__before")).otherwise(inside)).drop("__before")


def plain(df: DataFrame) -> DataFrame:
    return df.drop(_RANGE)
