"""Scored sets: (group, member, score) ranked by score, then member."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], score: str, member: str) -> DataFrame:
    """Adds rank (0-based, ascending) and rev_rank (from the top)."""
    w = Window.partitionBy(*group).orderBy(score, member)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return df.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).withColumn("rev_rank", (n - 1 - F.col("rank")).cast("long"))


def by_rank(df: DataFrame, group: list[str], score: str, member: str, rank: int) -> DataFrame:
    """The row at a rank; negative ranks count from the end."""
    r = ranked(df, group, score, member)
    return r.where(F.col("rank") == rank if rank >= 0 else F.col("rev_rank") == -rank - 1).drop("rank", "rev_rank")


def top(df: DataFrame, group: list[str], score: str, member: str, k: int, largest: bool = True) -> DataFrame:
    """The k first rows from one end, with place (1-based); Spark keeps k a group before the shuffle."""
    order = [F.col(score).desc(), F.col(member).desc()] if largest else [F.col(score), F.col(member)]
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    return placed.where(F.col("place") <= k)


def pop(df: DataFrame, group: list[str], score: str, member: str, k: int, largest: bool = True) -> tuple[DataFrame, DataFrame]:
    """(popped, remaining)."""
    popped = top(df, group, score, member, k, largest).drop("place")
    return popped, df.join(popped.select(*group, member), [*group, member], "left_anti")


def count_by_score(df: DataFrame, group: list[str], score: str, low, high) -> DataFrame:
    return df.groupBy(*group).agg(F.count_if(F.col(score).between(low, high)).alias("n"))


def remove_ranks(df: DataFrame, group: list[str], score: str, member: str, start: int, stop: int, strict: bool = False) -> DataFrame:
    """Without ranks start .. stop, inclusive; negatives count from the end. Bounds are clamped, or if ``strict`` a range that isn't inside removes nothing."""
    r = ranked(df, group, score, member)
    at = lambda k: F.lit(k) if k >= 0 else F.col("rank") + F.col("rev_rank") + 1 + k
    inside = (at(start) >= 0) & (at(stop) <= F.col("rank") + F.col("rev_rank")) if strict else F.lit(True)
    return r.where(~(F.col("rank").between(at(start), at(stop)) & inside)).drop("rank", "rev_rank")


def union(sets: list[DataFrame], weights: list[float], member: str, score: str, how: str = "sum") -> DataFrame:
    """Weighted union; common members' scores are combined by sum, min or max."""
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    rows = [s.select(member, (F.col(score).cast("double") * w).alias(score)) for s, w in zip(sets, weights, strict=True)]
    return reduce(DataFrame.unionByName, rows).groupBy(member).agg(fold(score).alias(score))


def intersect(sets: list[DataFrame], weights: list[float], member: str, score: str, how: str = "sum") -> DataFrame:
    """Weighted intersection of sets (members unique in each): one aggregation, whatever the number of sets."""
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    rows = [s.select(member, (F.col(score).cast("double") * w).alias(score), F.lit(i).alias("__i")) for i, (s, w) in enumerate(zip(sets, weights, strict=True))]
    got = reduce(DataFrame.unionByName, rows).groupBy(member).agg(fold(score).alias(score), F.count(F.lit(1)).alias("__n"))
    return got.where(F.col("__n") == len(sets)).drop("__n")


def difference(first: DataFrame, others: list[DataFrame], member: str) -> DataFrame:
    gone = reduce(DataFrame.unionByName, [o.select(member) for o in others])
    return first.join(gone, member, "left_anti")


def random_members(df: DataFrame, group: list[str], member: str, k: int, seed: int = 1) -> DataFrame:
    """k distinct members of each group, by a seeded hash order."""
    w = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), F.col(member)), member)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def add(df: DataFrame, new: DataFrame, group: list[str], score: str, member: str, mode: str = "set") -> DataFrame:
    """The sets after upserts of ``new`` (group, member, score; members unique in each).

    ``set`` replaces scores; ``nx`` only adds absent members; ``xx`` only changes present ones;
    ``incr`` adds to the score, from nothing for an absent member. Whole numbers stay exact.
    """
    key = [*group, member]
    both = df.select(*key, F.col(score).alias("__old"), F.lit(True).alias("__a")).join(new.select(*key, F.col(score).alias("__new"), F.lit(True).alias("__b")), key, "full")
    old, fresh = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    value = {
        "set": F.when(fresh, F.col("__new")).otherwise(F.col("__old")), "nx": F.when(old, F.col("__old")).otherwise(F.col("__new")),
        "xx": F.when(fresh, F.col("__new")).otherwise(F.col("__old")), "incr": F.when(old & fresh, F.col("__old") + F.col("__new")).otherwise(F.coalesce("__old", "__new")),
    }[mode]
    return (both.where(old) if mode == "xx" else both).select(*key, value.alias(score))


def remove(df: DataFrame, gone: DataFrame, group: list[str], member: str) -> tuple[DataFrame, DataFrame]:
    """(removed members with their scores, what is left)."""
    keys = gone.select(*group, member).distinct()
    return df.join(keys, [*group, member], "left_semi"), df.join(keys, [*group, member], "left_anti")


def scores(df: DataFrame, asked: DataFrame, group: list[str], score: str, member: str) -> DataFrame:
    """The asked members with their scores, null where a member is absent."""
    return asked.select(*group, member).join(df.select(*group, member, score), [*group, member], "left")


def scan_from(df: DataFrame, group: list[str], score: str, member: str, at, k: int, forward: bool = True) -> DataFrame:
    """A cursor: the next k rows of each set in (score, member) order from a score on, with place (1-based)."""
    rows = df.where(F.col(score) >= at if forward else F.col(score) <= at)
    return top(rows, group, score, member, k, largest=not forward)


def random_pop(df: DataFrame, group: list[str], member: str, k: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(k random members of each group, what is left)."""
    popped = random_members(df, group, member, k, seed)
    return popped, df.join(popped.select(*group, member), [*group, member], "left_anti")


def random_draws(df: DataFrame, group: list[str], member: str, k: int, seed: int = 1) -> DataFrame:
    """k draws from each group, with repeats, by a seeded hash of group and draw."""
    placed = df.select(*group, member, (F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), F.col(member)), member)) - 1).cast("long").alias("__i"))
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).select(*group, "__n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw"))
    asked = sizes.select(*group, "draw", F.pmod(F.xxhash64(F.lit(seed), *group, "draw"), F.col("__n")).alias("__i"))
    return asked.join(placed, [*group, "__i"]).drop("__i")
