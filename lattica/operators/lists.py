"""Lists of any length as rows (group, pos, value): pushes, inserts, deletes, pops and rotation by position.

Positions are 0-based and dense within a group. A change shifts positions, by counts of
changes at or before a position and sizes of groups, so no list is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))


def push_tail(df: DataFrame, items: DataFrame, group: str, order: str) -> DataFrame:
    """``items`` (group, order, value) after the last position of their group, in order; a group may be new."""
    n = items.join(_sizes(df, group), group, "left")
    place = F.coalesce("__n", F.lit(0)) + F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return df.select(group, "pos", "value").union(n.select(group, place.cast("long").alias("pos"), "value"))


def push_head(df: DataFrame, items: DataFrame, group: str, order: str) -> DataFrame:
    """``items`` before position 0, pushed in order, so that the last one comes first."""
    shift = items.groupBy(group).agg(F.count(F.lit(1)).alias("__k"))
    moved = df.join(shift, group, "left").select(group, (F.col("pos") + F.coalesce("__k", F.lit(0))).alias("pos"), "value")
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc())) - 1
    return moved.union(items.select(group, place.cast("long").alias("pos"), "value"))


def insert(df: DataFrame, items: DataFrame, group: str, before: str, order: str) -> DataFrame:
    """``items`` before the item at position ``before``, those of one position in order; beyond the end they are appended."""
    old = df.select(group, F.col("pos").alias("__at"), F.lit(1).alias("__new"), F.lit(0).cast("long").alias("__o"), "value")
    new = items.select(group, F.col(before).cast("long").alias("__at"), F.lit(0).alias("__new"), F.col(order).cast("long").alias("__o"), "value")
    place = F.row_number().over(Window.partitionBy(group).orderBy("__at", "__new", "__o")) - 1
    return old.union(new).select(group, place.cast("long").alias("pos"), "value")


def delete(df: DataFrame, gone: DataFrame, group: str) -> DataFrame:
    """Without the positions ``gone`` (group, pos); the others close up."""
    left = df.join(gone.select(group, "pos").distinct(), [group, "pos"], "left_anti")
    return left.select(group, (F.row_number().over(Window.partitionBy(group).orderBy("pos")) - 1).cast("long").alias("pos"), "value")


def replace(df: DataFrame, items: DataFrame, group: str) -> DataFrame:
    """Values of ``items`` (group, pos, value) at positions that exist."""
    new = items.select(group, "pos", F.col("value").alias("__v"), F.lit(True).alias("__hit"))
    return df.join(new, [group, "pos"], "left").select(group, "pos", F.when(F.col("__hit"), F.col("__v")).otherwise(F.col("value")).alias("value"))


def pop(df: DataFrame, group: str, k: int = 1, tail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the k items taken from one end, the list that is left)."""
    if not tail:
        return df.where(F.col("pos") < k), df.where(F.col("pos") >= k).withColumn("pos", F.col("pos") - k)
    sized = df.join(_sizes(df, group), group)
    return sized.where(F.col("pos") >= F.col("__n") - k).drop("__n"), sized.where(F.col("pos") < F.col("__n") - k).drop("__n")


def rotate(df: DataFrame, group: str, by: int = 1) -> DataFrame:
    """The last ``by`` items of each list move to its head; negative moves the first to the tail."""
    sized = df.join(_sizes(df, group), group)
    return sized.select(group, F.pmod(F.col("pos") + by, F.col("__n")).cast("long").alias("pos"), "value")
