"""Key joins and set relations between stores, and joins that the containers lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import cuts, range_of


def intersect_bag(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag intersection: a key occurs as often as in the side that has fewer."""
    return a.intersectAll(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys in exactly one side; one aggregation of both instead of two anti-joins."""
    key = a.columns
    both = a.select(*key, F.lit(1).alias("__s")).union(b.select(*key, F.lit(2).alias("__s")))
    return both.groupBy(*key).agg(F.bit_or("__s").alias("__s")).where("__s < 3").drop("__s")


def is_subset(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """For each group of a: whether all its keys are in b (keys only)."""
    marked = a.join(b.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    return marked.groupBy(group).agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("is_subset"))


def same_sets(df: DataFrame, group: str, key: str) -> DataFrame:
    """Groups with equal key sets: each group with the smallest group that equals it."""
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k")).distinct()
    # an order-free print of each set, then the keys of each group against those of the first one with its print
    mark = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "k")).alias("y"))
    firsts = mark.groupBy("n", "x", "y").agg(F.min("g").alias("r"))
    pairs = mark.join(firsts, ["n", "x", "y"]).select("g", "n", "r")
    common = rows.join(pairs.where("g != r"), "g").join(rows.select(F.col("g").alias("r2"), F.col("k").alias("k2")), (F.col("r") == F.col("r2")) & F.col("k").eqNullSafe(F.col("k2"))).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    return pairs.join(common, "g", "left").select(F.col("g").alias(group), F.when(F.col("c") == F.col("n"), F.col("r")).otherwise(F.col("g")).alias("same_as"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """For each left row the value of the last right row with the same ``by`` at or before ``at``.

    Both sides are united and swept by a window: linear in rows, no range join. The sweep is cut at a few
    values of ``at``, so that one key's rows are shared by tasks; what a range begins with is carried from the ranges before it.
    """
    rest = [c for c in left.columns if c not in (by, at)]
    l_rows = left.select(by, at, F.lit(1).alias("__side"), F.struct(*rest).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    r_rows = right.select(by, at, F.lit(0).alias("__side"), F.lit(None).cast(l_rows.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    both = l_rows.union(r_rows).withColumn("__r", range_of(at, cuts(right, at)))
    last = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(at, "__v")))
    ends = both.groupBy(F.col(by).alias("__by"), F.col("__r").alias("__q")).agg(last.alias("__l"))
    earlier = Window.partitionBy("__by").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    begun = ends.select("__by", "__q", F.last("__l", ignorenulls=True).over(earlier).alias("__begun"))
    w = Window.partitionBy(by, "__r").orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("__own", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    found = swept.join(begun, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__r") == F.col("__q")), "left")
    return found.select(by, at, *[F.col(f"__row.{c}").alias(c) for c in rest], F.coalesce("__own", "__begun").alias(f"asof_{value}"))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points joined to ranges [low, high] that hold them: an equi-join on buckets of ``width``, then a filter."""
    p = points.withColumn("__b", F.floor(F.col(point) / width))
    r = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__b").where(F.col(point).between(F.col(low), F.col(high))).drop("__b")
