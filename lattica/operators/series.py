"""Time series: delta-of-delta and XOR codecs, slices, buckets, moments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Payload bits of the size classes of a delta of deltas, each with a tag before it.
DOD_BITS = (7, 9, 12, 14, 20, 32, 48, 64)


def dod_encode(df: DataFrame, group: list[str], order: list[str], v: str) -> DataFrame:
    """Adds seq, first (only at seq 0), delta (only at seq 1) and dd, the delta of deltas, from seq 2 on."""
    w = Window.partitionBy(*group).orderBy(*order)
    d = F.col(v) - F.lag(v).over(w)
    out = df.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).withColumn("__d", d)
    return out.withColumn("dd", F.when(F.col("seq") == 0, F.col(v)).when(F.col("seq") == 1, F.col("__d")).otherwise(F.col("__d") - F.lag("__d").over(w))).drop("__d")


def dod_decode(df: DataFrame, group: list[str], out: str) -> DataFrame:
    """Values from (group, seq, dd): two running sums."""
    w = Window.partitionBy(*group).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    steps = df.withColumn("__d", F.sum(F.when(F.col("seq") >= 1, F.col("dd")).otherwise(0)).over(w))
    start = F.sum(F.when(F.col("seq") == 0, F.col("dd")).otherwise(0)).over(w)
    return steps.withColumn(out, start + F.sum("__d").over(w)).drop("__d")


def dod_size(dd: Column) -> Column:
    """Bits of one delta of deltas: 1 for zero, else a tag of class number bits and the class's payload."""
    out = F.lit(len(DOD_BITS) + 64)
    for k, bits in reversed(list(enumerate(DOD_BITS[:-1]))):
        half = 1 << (bits - 1)
        out = F.when(dd.between(-half + 1, half), F.lit(k + 2 + bits)).otherwise(out)
    return F.when(dd == 0, F.lit(1)).otherwise(out).cast("long")


def _xor_sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import numpy as np

    for f in frames:
        x = (f["__v"].to_numpy(np.float64).view(np.int64) ^ f["__p"].fillna(0.0).to_numpy(np.float64).view(np.int64)).view(np.uint64)
        high = np.frexp((x >> np.uint64(32)).astype(np.float64))[1], np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        lead = 64 - np.where(high[0] > 0, 32 + high[0], high[1])
        trail = np.where(x > 0, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64), 0)
        bits = np.where(f["__p"].isna(), 64, np.where(x == 0, 1, 14 + 64 - lead - trail))
        yield f.drop(columns=["__v", "__p"]).assign(xor_bits=x.view(np.int64), bits=bits.astype(np.int64))


def xor_encode(df: DataFrame, group: list[str], order: list[str], v: str) -> DataFrame:
    """(group, order, xor_bits, bits): each double XORed with the one before it, and the bits that takes.

    One bit if equal, else 2 + 6 + 6 bits of tag, leading zeros and length, and the payload.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.select(*group, *order, F.col(v).cast("double").alias("__v"), F.lag(F.col(v).cast("double")).over(w).alias("__p"))
    types = dict(rows.dtypes)
    return rows.mapInPandas(_xor_sizes, ", ".join(f"`{c}` {types[c]}" for c in [*group, *order]) + ", xor_bits bigint, bits bigint")


def _xor_values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import numpy as np

    for f in frames:
        yield f.drop(columns="__b").assign(value=f["__b"].to_numpy(np.int64).view(np.float64))


def xor_decode(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Doubles from xor_bits: a running XOR."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*group, *order, F.bit_xor("xor_bits").over(w).alias("__b"))
    types = dict(rows.dtypes)
    return rows.mapInPandas(_xor_values, ", ".join(f"`{c}` {types[c]}" for c in [*group, *order]) + ", value double")


def slice_stats(df: DataFrame, group: list[str], order: list[str], v: str, start: int, stop: int) -> DataFrame:
    """count, sum, mean, min, max, m2 (sum of squared deviations), var_pop and stddev_pop of positions start .. stop - 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).where(F.col("__i").between(start, stop - 1))
    return moments(rows, group, v)


def moments(df: DataFrame, group: list[str], v: str) -> DataFrame:
    """Mergeable moments in one partially aggregated pass."""
    return df.groupBy(*group).agg(
        F.count(v).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.round(F.var_pop(v) * F.count(v), 3).alias("m2"), F.round(F.var_pop(v), 5).alias("var_pop"), F.round(F.stddev_pop(v), 5).alias("stddev_pop"),
    )


def last_n(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def buckets(df: DataFrame, ts: str, width: str, group: list[str], v: str) -> DataFrame:
    b = F.window(F.col(ts), width)["start"].cast("timestamp_ntz")
    return df.groupBy(*group, b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


def products(df: DataFrame, group: str, v: str) -> DataFrame:
    """(group, product): the exact product of whole numbers, modulo nothing: null beyond 38 digits, a long where it fits one.

    Equal factors are counted before the shuffle, so what meets in a group is its distinct factors.
    """
    counts = df.groupBy(group, v).agg(F.count(F.lit(1)).alias("__n"))
    big = lambda x: x.cast("decimal(38,0)")
    power = F.aggregate(F.sequence(F.lit(1), F.col("__n")), big(F.lit(1)), lambda a, _: big(F.try_multiply(a, big(F.col(v)))))
    powers = counts.select(group, F.when(F.abs(v) <= 1, F.when((F.col(v) < 0) & (F.col("__n") % 2 == 0), big(F.lit(1))).otherwise(big(F.col(v)))).when(F.col("__n") <= 126, power).alias("__p"))
    each = powers.groupBy(group).agg(F.collect_list(F.coalesce("__p", big(F.lit(None)))).alias("__f"), F.count_if(F.col("__p").isNull()).alias("__lost"), F.count_if(F.col("__p") == 0).alias("__zero"))
    product = F.aggregate("__f", big(F.lit(1)), lambda a, x: big(F.try_multiply(a, x)))
    return each.select(group, F.when(F.col("__zero") > 0, big(F.lit(0))).when(F.col("__lost") == 0, product).try_cast("bigint").alias("product"))


def blocks(df: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """Adds block and place: a series in blocks of ``size`` values."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    return df.withColumn("block", F.floor(at / size)).withColumn("place", F.pmod(at, F.lit(size)).cast("long"))


def append(stored: DataFrame, new: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """``stored`` (with block and place) and ``new`` values after its end: its last block is filled before another begins."""
    ends = stored.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    at = F.coalesce("__n", F.lit(0)) + F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    placed = new.join(ends, group, "left").withColumn("block", F.floor(at / size)).withColumn("place", F.pmod(at, F.lit(size)).cast("long")).drop("__n")
    return stored.unionByName(placed.select(*stored.columns))
