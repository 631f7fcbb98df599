"""Sketches: distinct counts, membership, frequencies, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K = 14


def distinct_sketch(df: DataFrame, group: list[str], x: str, lg_k: int = LOG_K) -> DataFrame:
    return df.groupBy(*group).agg(F.hll_sketch_agg(F.col(x), lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, group: list[str]) -> DataFrame:
    return sketches.groupBy(*group).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")


def bloom_places(x: Column, bits: int, probes: int) -> Column:
    """array<long> of ``probes`` positions below ``bits`` by double hashing; reduced before it can overflow."""
    h1, h2 = F.pmod(F.xxhash64(x), F.lit(bits)), F.pmod(F.xxhash64(x, F.lit(1)), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(bits)))


def bloom_bits(df: DataFrame, x: str) -> int:
    """Bits of a filter that holds the values of ``x``: 2 ** 20 at least, else 16 to 32 for each, of which 6 probes find less than 1 in 500 others."""
    return max(1 << 20, _above(16 * df.agg(F.approx_count_distinct(x, 0.02)).first()[0]))


def _above(n: int) -> int:
    """The least power of 2 that is not below ``n``."""
    return 1 << max(0, n - 1).bit_length()


def bloom(df: DataFrame, x: str, bits: int = 1 << 20, probes: int = 6) -> DataFrame:
    """A Bloom filter as (word, mask): at most bits / 64 rows whatever the input. Beyond some 60,000 values take ``bloom_bits``."""
    place = df.select(F.explode(bloom_places(F.col(x), bits, probes)).alias("p"))
    return place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("mask"))


def bloom_contains(df: DataFrame, x: str, filled: DataFrame, bits: int = 1 << 20, probes: int = 6) -> DataFrame:
    """Adds maybe: false only for values that were never added."""
    keys = df.select(x).distinct()
    asked = keys.select(x, F.explode(bloom_places(F.col(x), bits, probes)).alias("p")).withColumn("word", F.shiftright("p", 6))
    hit = F.coalesce(F.expr("mask & shiftleft(1L, cast(p & 63 AS int))") != 0, F.lit(False))
    found = asked.join(filled, "word", "left").groupBy(x).agg(F.bool_and(hit).alias("maybe"))
    return df.join(found, x)


def count_min_width(df: DataFrame, x: str) -> int:
    """Cells a row for the values of ``x``: 2 ** 16 at least, else 4 to 8 for each, so that 4 rows leave all but 1 in 400 values a cell of their own."""
    return max(1 << 16, _above(4 * df.agg(F.approx_count_distinct(x, 0.02)).first()[0]))


def count_min(df: DataFrame, x: str, width: int = 1 << 16, depth: int = 4) -> DataFrame:
    """A count-min sketch as (row, cell, n): at most width * depth rows. Beyond some 16,000 values take ``count_min_width``."""
    cells = df.groupBy(x).agg(F.count(F.lit(1)).alias("c")).select("c", F.posexplode(bloom_places(F.col(x), width, depth)).alias("row", "cell"))
    return cells.groupBy("row", "cell").agg(F.sum("c").alias("n"))


def count_min_estimate(keys: DataFrame, x: str, sketch: DataFrame, width: int = 1 << 16, depth: int = 4) -> DataFrame:
    asked = keys.select(x).distinct().select(x, F.posexplode(bloom_places(F.col(x), width, depth)).alias("row", "cell"))
    return asked.join(sketch, ["row", "cell"], "left").groupBy(x).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def decayed(df: DataFrame, group: list[str], ts_us: str, now_us: int, half_life_us: int, most: int = 7) -> DataFrame:
    """Counters of small width that halve every half life: floor(min(count, most) * 0.5 ** (age / half life)), age from the last event."""
    c = df.groupBy(*group).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n"), F.max(ts_us).alias("last"))
    return c.select(*group, F.col("n").cast("long").alias("n"), F.floor(F.col("n") * F.pow(F.lit(0.5), (F.lit(now_us) - F.col("last")) / F.lit(half_life_us))).alias("decayed"))


#: Counting filter: cells of 3 bits, saturating.
CELL_MOST = 7


def counting_filter(df: DataFrame, x: str, cells: int = 1 << 20, probes: int = 4) -> DataFrame:
    """(cell, n): a counting filter of 3-bit cells under conservative updates.

    A conservative update raises only the smallest cells of a key, so what it leaves depends on
    the order of keys; no order leaves a cell below the count of a key on it. Here a cell is the
    largest of these counts, capped: the tightest such filter, and one that any partitions give alike.
    """
    counts = df.groupBy(x).agg(F.least(F.count(F.lit(1)), F.lit(CELL_MOST)).alias("n"))
    return counts.select("n", F.explode(F.array_distinct(bloom_places(F.col(x), cells, probes))).alias("cell")).groupBy("cell").agg(F.max("n").cast("int").alias("n"))


def counting_estimate(keys: DataFrame, x: str, filled: DataFrame, cells: int = 1 << 20, probes: int = 4) -> DataFrame:
    """(x, estimate): the smallest cell of each key, never below its capped count; 0 if any of its cells is empty."""
    asked = keys.select(x).distinct().select(x, F.explode(F.array_distinct(bloom_places(F.col(x), cells, probes))).alias("cell"))
    return asked.join(filled, "cell", "left").groupBy(x).agg(F.min(F.coalesce("n", F.lit(0))).cast("long").alias("estimate"))


def halved(filled: DataFrame, times: int = 1) -> DataFrame:
    """Every cell halved so many times; empty cells go."""
    return filled.withColumn("n", F.shiftright("n", times)).where("n > 0")


def decayed_by(filled: DataFrame, factor: float, seed: int | None = None) -> DataFrame:
    """Cells times a factor: rounded down, or with a seed up with the probability of the rest, by a hash of cell and seed.

    A factor of 1 or more changes nothing; one of 1/8 or less empties the filter.
    """
    if factor >= 1:
        return filled
    if factor <= 0.125:
        return filled.where(F.lit(False))
    exact = F.col("n") * F.lit(factor)
    up = F.lit(0) if seed is None else (F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(1 << 20)) < (exact - F.floor(exact)) * (1 << 20)).cast("int")
    return filled.withColumn("n", (F.floor(exact) + up).cast("int")).where("n > 0")
