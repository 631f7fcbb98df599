"""Prefix sums and range aggregates over indexed values (group, idx, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered, running_sum


def prefix_sums(df: DataFrame, idx: str, v: str, group: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Adds prefix, the sum over [0, idx]. A whole table is summed by ranges; groups with ``block`` (long index) in two levels: inside blocks, and totals of blocks before."""
    if not group:
        return running_sum(df, idx, v, "prefix")
    if block is None:
        w = Window.partitionBy(*group).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("prefix", F.sum(v).over(w))
    df = df.withColumn("__b", F.floor(F.col(idx) / block))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "__b").agg(F.sum(v).alias("__t")).withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    w = Window.partitionBy(*group, "__b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(totals, [*group, "__b"]).withColumn("prefix", F.col("__o") + F.sum(v).over(w)).drop("__b", "__o")


def range_aggregate(df: DataFrame, ranges: DataFrame, idx: str, v: str, how: str, block: int = 1024) -> DataFrame:
    """(q, lo, hi, result): sum, min or max of v over [lo, hi]; an empty range has sum 0 and no min or max.

    Values are folded by blocks first. A range meets its whole blocks by one row each and the values
    of its two end blocks, through equi-joins on the block; so the work follows blocks and
    ends, not ranges times values. A range of many blocks is spread over as many rows.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    b = F.floor(F.col(idx) / block)
    folded = df.groupBy(b.alias("__b")).agg(fold(v).alias("__v"))
    first, last = F.floor(F.col("lo") / block), F.floor(F.col("hi") / block)
    asked = ranges.select("q", "lo", "hi", first.alias("__f"), last.alias("__l"))
    inner = asked.where("__l - __f > 1").select("q", "lo", "hi", F.explode(F.sequence(F.col("__f") + 1, F.col("__l") - 1)).alias("__b")).join(folded, "__b").select("q", "lo", "hi", "__v")
    ends = asked.where("lo <= hi").select("q", "lo", "hi", F.explode(F.array_distinct(F.array("__f", "__l"))).alias("__b"))
    outer = ends.join(df.select(b.alias("__b"), F.col(idx).alias("__i"), F.col(v).alias("__v")), "__b").where("__i between lo and hi").select("q", "lo", "hi", "__v")
    found = inner.union(outer).groupBy("q", "lo", "hi").agg(fold("__v").alias("result"))
    got = ranges.select("q", "lo", "hi").join(found, ["q", "lo", "hi"], "left")
    return got.withColumn("result", F.coalesce("result", F.lit(0))) if how == "sum" else got


def lower_bound(df: DataFrame, targets: list[int], idx: str, v: str, block: int = 1024) -> DataFrame:
    """(target, idx): the smallest index whose prefix sum reaches each target; values must not be negative.

    Each target is sought among the running totals of blocks, then in one block.
    """
    b = F.floor(F.col(idx) / block)
    totals = running_sum(df.groupBy(b.alias("__b")).agg(F.sum(v).alias("__t")), "__b", "__t", "__after")
    asked = df.sparkSession.createDataFrame([(t,) for t in targets], "target long")
    place = totals.join(F.broadcast(asked), F.col("__after") >= F.col("target")).groupBy("target").agg(F.min_by(F.struct("__b", (F.col("__after") - F.col("__t")).alias("__before")), "__b").alias("p"))
    place = place.select("target", "p.*")
    inside = Window.partitionBy("target").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(b.alias("__b"), idx, v).join(F.broadcast(place), "__b").withColumn("__s", F.col("__before") + F.sum(v).over(inside))
    return rows.where("__s >= target").groupBy("target").agg(F.min(idx).alias(idx))


def sliding(df: DataFrame, idx: str, v: str, before: int, group: list[str] | None = None, block: int = 65536) -> DataFrame:
    """Adds w_sum, w_min, w_max over the row and ``before`` rows before it.

    A whole table is cut into blocks of positions; a block also gets the ``before`` rows ahead of it.
    """
    folds = lambda w: (F.sum(v).over(w).alias("w_sum"), F.min(v).over(w).alias("w_min"), F.max(v).over(w).alias("w_max"))
    if group:
        return df.select("*", *folds(Window.partitionBy(*group).orderBy(idx).rowsBetween(-before, 0)))
    block = max(block, before + 1)
    placed = numbered(df, idx, "__p").withColumn("__b", F.floor(F.col("__p") / block))
    late = F.when(F.pmod("__p", F.lit(block)) >= block - before, F.array(F.col("__b"), F.col("__b") + 1)).otherwise(F.array("__b"))
    spread = placed.withColumn("__k", F.explode(late))
    return spread.select("*", *folds(Window.partitionBy("__k").orderBy("__p").rowsBetween(-before, 0))).where("__k = __b").drop("__p", "__b", "__k")


def range_assign(df: DataFrame, idx: str, v: str, lo, hi, value) -> DataFrame:
    return df.withColumn(v, F.when(F.col(idx).between(lo, hi), F.lit(value)).otherwise(F.col(v)))


def point_add(df: DataFrame, deltas: DataFrame, idx: str, v: str) -> DataFrame:
    """Adds deltas (idx, v) at their indexes; new indexes are made."""
    return df.select(idx, v).unionByName(deltas.select(idx, v)).groupBy(idx).agg(F.sum(v).alias(v))


def assign(df: DataFrame, values: DataFrame, idx: str, v: str) -> DataFrame:
    """Values (idx, v) put at their indexes; new indexes are made, and gaps up to them hold 0."""
    new = values.select(F.col(idx).alias("__i"), F.col(v).alias("__v"))
    both = df.select(idx, v).join(new, F.col(idx) == F.col("__i"), "full")
    return filled(both.select(F.coalesce(idx, "__i").alias(idx), F.when(F.col("__i").isNotNull(), F.col("__v")).otherwise(F.col(v)).alias(v)), idx, v)


def filled(df: DataFrame, idx: str, v: str, low: int | None = None, block: int = 4096) -> DataFrame:
    """A dense array: every index from the smallest (or ``low``) to the largest, 0 where nothing was.

    Indexes are made block by block, so that tasks share them.
    """
    ends = df.agg(F.min(idx).alias("a") if low is None else F.lit(low).cast("long").alias("a"), F.max(idx).alias("b")).where("b is not null")
    starts = ends.select("a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))).alias("__k")).repartition("__k")
    every = starts.select("a", "b", F.explode(F.sequence(F.col("__k") * block, F.col("__k") * block + block - 1)).alias(idx)).where(F.col(idx).between(F.col("a"), F.col("b"))).select(idx)
    return every.join(df.select(idx, v), idx, "left").select(idx, F.coalesce(v, F.lit(0)).alias(v))


def cleared(df: DataFrame, v: str) -> DataFrame:
    """All values 0; the size stays."""
    return df.withColumn(v, F.lit(0).cast(df.schema[v].dataType))


def query_points(sums: DataFrame, asked: DataFrame, idx: str) -> DataFrame:
    """(idx, prefix) of the asked indexes; 0 outside the array."""
    return asked.select(idx).join(sums.select(idx, "prefix"), idx, "left").select(idx, F.coalesce("prefix", F.lit(0)).alias("prefix"))


def promoted_sums(df: DataFrame, idx: str, whole: str, real: str, group: list[str]) -> DataFrame:
    """Prefix sums over values that are whole (``whole``), real (``real``) or neither: a group with any real value is summed as doubles.

    Adds prefix_whole and prefix_real, of which one is null; a value that is neither adds nothing.
    """
    w = Window.partitionBy(*group)
    upto = w.orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    mixed = F.max(F.col(real).isNotNull()).over(w)
    doubles = F.sum(F.coalesce(F.col(real), F.col(whole).cast("double"), F.lit(0.0))).over(upto)
    return df.withColumn("prefix_whole", F.when(~mixed, F.sum(F.coalesce(whole, F.lit(0))).over(upto))).withColumn("prefix_real", F.when(mixed, doubles))
