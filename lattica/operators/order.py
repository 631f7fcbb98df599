"""Positions and running totals over a whole table in key order, without a task that holds all of it.

Keys are cut into ranges at a few of their values (those with the smallest hashes, so the cuts are the same
in every run), ranges are counted, and each range is numbered on its own from where the ones before it end.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges; the only whole-table window is over one row for each of them.
RANGES = 64


def cuts(df: DataFrame, key: str, ranges: int = RANGES) -> list:
    """Up to ``ranges`` - 1 values of ``key``, in order."""
    some = df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(ranges - 1)
    return sorted(some.agg(F.sort_array(F.collect_list(key))).first()[0])


def range_of(key: str, values: list) -> Column:
    """The number of the range that a key is in; nulls are in the first."""
    if not values:
        return F.lit(0)
    return reduce(add, [F.when(F.col(key) >= F.lit(v), 1).otherwise(0) for v in values])


def _ranged(df: DataFrame, key: str, desc: bool, total: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with __r, offsets (__r, __o) from ``total`` of the ranges before)."""
    values = cuts(df, key)
    n = range_of(key, values)
    rows = df.withColumn("__r", F.when(F.col(key).isNull(), -1).otherwise(len(values) - n if desc else n))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__r").agg(total.alias("__t"))
    return rows, F.broadcast(totals.select("__r", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before")))


def numbered(df: DataFrame, key: str, name: str, ties: list[str] | None = None, desc: bool = False) -> DataFrame:
    """Adds ``name``: the 0-based position of each row in order of ``key``, then ``ties``; nulls first."""
    rows, offsets = _ranged(df, key, desc, F.count(F.lit(1)))
    w = Window.partitionBy("__r").orderBy(*[F.col(c).desc() if desc else F.col(c) for c in [key, *(ties or [])]])
    return rows.join(offsets, "__r").withColumn(name, (F.col("__before") + F.row_number().over(w) - 1).cast("long")).drop("__r", "__before")


def running_sum(df: DataFrame, key: str, value: str, name: str, ties: list[str] | None = None, desc: bool = False) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with each row in order of ``key``, then ``ties``; nulls first."""
    rows, offsets = _ranged(df, key, desc, F.sum(value))
    w = Window.partitionBy("__r").orderBy(*[F.col(c).desc() if desc else F.col(c) for c in [key, *(ties or [])]]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, "__r").withColumn(name, F.col("__before") + F.sum(value).over(w)).drop("__r", "__before")
