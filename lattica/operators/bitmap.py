"""Bitmaps as rows (group, pos): algebra, rank and select, ranges, similarity, packed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import small
from .order import numbered

CHUNK = 8192
#: Bitmaps that are compared pair by pair.
MOST_GROUPS = 2000


def combine(df: DataFrame, group: str, pos: str, groups: list, how: str) -> DataFrame:
    """and / or / xor / andnot of the bitmaps of ``groups``: positions by the number (and side) of groups that hold them."""
    held = df.where(F.col(group).isin(groups)).select(group, pos).distinct().groupBy(pos).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col(group) == groups[0]).alias("first"))
    rule = {"or": F.lit(True), "and": F.col("n") == len(groups), "xor": F.col("n") % 2 == 1, "andnot": F.col("first") & (F.col("n") == 1)}[how]
    return held.where(rule).select(pos)


def complement(df: DataFrame, pos: str, chunk: int = CHUNK) -> DataFrame:
    """Positions not set, inside chunks that hold any."""
    chunks = df.select(F.floor(F.col(pos) / chunk).alias("__c")).distinct()
    every = chunks.select(F.explode(F.sequence(F.col("__c") * chunk, F.col("__c") * chunk + chunk - 1)).alias(pos))
    return every.join(df.select(pos), pos, "left_anti")


def ranks(df: DataFrame, pos: str) -> DataFrame:
    """Distinct positions with rank (set bits strictly below)."""
    return numbered(df.select(F.col(pos).cast("long").alias(pos)).distinct(), pos, "rank")


def select_kth(df: DataFrame, pos: str, ks: list[int]) -> DataFrame:
    """(k, position) of the k-th set bits, from 1; none for 0 or beyond the end."""
    return ranks(df, pos).where((F.col("rank") + 1).isin(ks)).select((F.col("rank") + 1).alias("k"), pos)


def range_count(df: DataFrame, group: str, pos: str, low: int, high: int) -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct(F.when(F.col(pos).between(low, high), F.col(pos))).alias("n"))


def set_range(df: DataFrame, pos: str, low: int, high: int) -> DataFrame:
    spark = df.sparkSession
    return df.select(F.col(pos).cast("long").alias(pos)).union(spark.range(low, high + 1).toDF(pos)).distinct()


def clear_range(df: DataFrame, pos: str, low: int, high: int) -> DataFrame:
    return df.select(pos).distinct().where(~F.col(pos).between(low, high))


def flip_range(df: DataFrame, pos: str, low: int, high: int) -> DataFrame:
    spark = df.sparkSession
    both = df.select(F.col(pos).cast("long").alias(pos)).distinct().union(spark.range(low, high + 1).toDF(pos))
    return both.groupBy(pos).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") == 1)).select(pos)


def similarity(df: DataFrame, group: str, pos: str) -> DataFrame:
    """Jaccard, dice, overlap and hamming of all pairs of a few bitmaps.

    Positions carry the array of the groups that hold them, so the pairs grow with the
    square of the number of groups (at most MOST_GROUPS, checked), not with a self-join of rows.
    """
    held = df.select(group, pos).distinct()
    sizes = held.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sets = held.groupBy(pos).agg(F.sort_array(F.collect_set(group)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    pairs = sets.select(F.explode("g").alias("a"), "g", "c").select("a", F.explode("g").alias("b"), "c").where("a < b").groupBy("a", "b").agg(F.sum("c").alias("both"))
    s = lambda x, n: sizes.select(F.col(group).alias(x), F.col("n").alias(n))
    small(sizes, MOST_GROUPS)
    every = s("a", "na").join(s("b", "nb"), F.col("a") < F.col("b")).join(pairs, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return every.select(
        "a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard"), F.round(2 * F.col("both") / (F.col("na") + F.col("nb")), 6).alias("dice"),
        F.round(F.col("both") / F.least("na", "nb"), 6).alias("overlap"), (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("hamming"),
    )


def packed_count(df: DataFrame, pos: str) -> DataFrame:
    """Distinct count through packed bitmaps: 4 KB for 32,768 positions instead of a row each."""
    packed = df.groupBy(F.bitmap_bucket_number(F.col(pos)).alias("__c")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(pos))).alias("bits"))
    return packed.agg(F.sum(F.bitmap_count("bits")).alias("n"))


def first_last(df: DataFrame, group: str, pos: str) -> DataFrame:
    """(group, low, high): the smallest and largest set position."""
    return df.groupBy(group).agg(F.min(pos).alias("low"), F.max(pos).alias("high"))


def intersects(df: DataFrame, group: str, pos: str, a, b) -> DataFrame:
    """One row: whether two bitmaps share a position. The answer of each position is partially aggregated."""
    held = df.where(F.col(group).isin(a, b)).groupBy(pos).agg((F.bool_or(F.col(group) == a) & F.bool_or(F.col(group) == b)).alias("__both"))
    return held.agg(F.coalesce(F.bool_or("__both"), F.lit(False)).alias("intersects"))


def get_bits(df: DataFrame, asked: DataFrame, pos: str) -> DataFrame:
    """The asked positions with bit: whether they are set."""
    return asked.join(df.select(pos).distinct().withColumn("bit", F.lit(True)), pos, "left").withColumn("bit", F.coalesce("bit", F.lit(False)))


def set_bits(df: DataFrame, changes: DataFrame, pos: str) -> DataFrame:
    """Positions after ``changes`` (pos, bit), at most one a position."""
    return df.select(pos).distinct().join(changes.select(pos), pos, "left_anti").unionByName(changes.where("bit").select(pos))


def first_n(df: DataFrame, pos: str, n: int) -> DataFrame:
    """The n smallest positions; each task keeps n."""
    return df.select(pos).distinct().orderBy(pos).limit(n)


def pack(df: DataFrame, group: str, pos: str) -> DataFrame:
    """(group, chunk, bits): packed bitmaps of 32,768 positions each; positions must not be negative."""
    at = F.col(pos) + 1  # Spark's buckets count from 1
    return df.groupBy(group, F.bitmap_bucket_number(at).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def unpack(packed: DataFrame, group: str, pos: str) -> DataFrame:
    """(group, pos) of packed bitmaps, read byte by byte from their hexadecimal form: set bits only."""
    size = F.octet_length("bits")
    every = F.sequence(F.lit(0), size - 1)
    bytes_ = F.filter(F.transform(every, lambda i: F.struct(i.alias("i"), F.conv(F.substr(F.hex("bits"), 2 * i + 1, F.lit(2)), 16, 10).cast("int").alias("b"))), lambda x: x["b"] != 0)
    rows = packed.select(group, "chunk", F.explode(bytes_).alias("x"))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.call_function("shiftright", F.col("x.b"), k).bitwiseAND(F.lit(1)) == 1))
    return rows.select(group, "chunk", "x", bit.alias("k")).select(group, ((F.col("chunk") - 1) * 32768 + F.col("x.i") * 8 + F.col("k")).cast("long").alias(pos))


def matrix(df: DataFrame, row: str, col: str, value: str, width: int) -> DataFrame:
    """A sparse matrix of ``width``-bit values: rows (row, col, value) with the value cut to its bits and zeros left out."""
    cut = F.col(value).cast("long").bitwiseAND(F.lit((1 << width) - 1))
    return df.select(row, col, cut.alias(value)).where(F.col(value) != 0)


def matrix_positions(df: DataFrame, row: str, col: str, cols: int) -> DataFrame:
    """Adds pos, the row-major position."""
    return df.withColumn("pos", F.col(row) * cols + F.col(col))
