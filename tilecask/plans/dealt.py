"""Joins on keys of which one may hold any share of the rows: the rows of a key are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def _salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def mask(by: str) -> Column:
    """An aggregate, ``__mask``: the salts that a group's rows have, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _salt(by))).alias("__mask")


def dealt(rows: DataFrame, facts: DataFrame, key: list[str], by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (key, __mask, more) on ``key``; the rows of one key go to up to ``SALTS`` tasks.

    ``__mask`` comes from the same rows and column ``by``. A fact is copied once for each salt that its group has, so at
    most once for each row.
    """
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("__mask", i) == 1)
    copies = facts.withColumn("__salt", F.explode(salts)).drop("__mask")
    return rows.withColumn("__salt", _salt(by)).join(copies, [*key, "__salt"], how).drop("__salt")
