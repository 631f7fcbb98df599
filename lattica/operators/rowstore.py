"""Sorted row stores: scans, lookups, bounds, positions and changes. A store is a DataFrame with a sort key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "=": "__eq__", "!=": "__ne__"}


def matches(key: str | Column, op: str, value) -> Column:
    """``key op value``; null never matches."""
    column = F.col(key) if isinstance(key, str) else key
    return getattr(column, OPS[op])(value)


def scan(df: DataFrame, *keys: str, forward: bool = True) -> DataFrame:
    """Rows in key order; a total range sort, so any number of rows."""
    return df.orderBy(*[F.col(k).asc() if forward else F.col(k).desc() for k in keys])


def range_scan(df: DataFrame, key: str, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Rows with key between bounds; both reach the file scan as filters."""
    if low is not None:
        df = df.where(matches(key, ">" if low_open else ">=", low))
    if high is not None:
        df = df.where(matches(key, "<" if high_open else "<=", high))
    return df


def take_while(df: DataFrame, keys: list[str], holds: Column, forward: bool = True) -> DataFrame:
    """Rows before the first one, in key order, for which ``holds`` is not true.

    The first failing key is found by a partially aggregated minimum; no sort, no window.
    """
    key = F.struct(*keys)
    bound = df.where(~F.coalesce(holds, F.lit(False))).agg((F.min(key) if forward else F.max(key)).alias("bound")).scalar()
    return df.where(bound.isNull() | (key < bound if forward else key > bound))


def first_last(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row: the first and last row in key order, as first_* and last_*."""
    order, row = F.struct(*keys), F.struct(*columns)
    got = df.agg(F.min_by(row, order).alias("f"), F.max_by(row, order).alias("l"))
    return got.select(*[F.col(f"f.{c}").alias(f"first_{c}") for c in columns], *[F.col(f"l.{c}").alias(f"last_{c}") for c in columns])


def lookup(probes: DataFrame, store: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Probes with the store's ``columns``, null and found=false where the key is missing."""
    right = store.select(F.col(key).alias("__k"), *columns, F.lit(True).alias("__hit"))
    return probes.join(right, probes[key] == F.col("__k"), "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__k", "__hit")


def positions(df: DataFrame, group: list[str], order: list[Column | str], at: int, size: int = 1) -> DataFrame:
    """Rows at positions ``at`` .. ``at + size - 1`` of each group; a negative position counts from the end."""
    w = Window.partitionBy(*group).orderBy(*order)
    placed = df.withColumn("__i", F.row_number().over(w) - 1)
    if at < 0:
        placed = placed.withColumn("__i", F.col("__i") - F.count(F.lit(1)).over(Window.partitionBy(*group)))
    return placed.where(F.col("__i").between(at, at + size - 1)).drop("__i")


def upsert(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, not a window, so hot keys are merged before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    got = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return got.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*log.columns)


def bag_insert(store: DataFrame, rows: DataFrame) -> DataFrame:
    return store.unionByName(rows)


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def counters(df: DataFrame, key: list[str], value: str, start: DataFrame | None = None) -> DataFrame:
    """Counter per key, increments added to the old values of ``start`` (same columns)."""
    rows = df.select(*key, value)
    return (rows if start is None else rows.unionByName(start)).groupBy(*key).agg(F.sum(value).alias(value))


def merge(target: DataFrame, source: DataFrame, key: str, value: str, replace: bool) -> DataFrame:
    """Union of two dictionaries; on common keys the source's value replaces the target's or not."""
    s = source.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    both = target.select(key, value).join(s, F.col(key) == F.col("__k"), "full")
    first, second = ("__v", value) if replace else (value, "__v")
    hit = F.col("__k").isNotNull() if replace else F.col(key).isNotNull()
    return both.select(F.coalesce(key, "__k").alias(key), F.when(hit, F.col(first)).otherwise(F.col(second)).alias(value))


def mixed_order(number: Column, text: Column) -> list[Column]:
    """A total order over mixed values: nulls, then numbers by value, then strings by bytes."""
    rank = F.when(number.isNotNull(), 1).when(text.isNotNull(), 2).otherwise(0)
    return [rank.alias("type_rank"), number, text]


def page(df: DataFrame, key: str, cursor: int, pages: int) -> DataFrame:
    """One page of a resumable scan: every row is on exactly one of ``pages`` pages, whatever was added meanwhile."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(pages)) == cursor)


def dump(df: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """(chunk, rows): all rows as arrays of ``chunk`` rows in key order within ranges of the first key, so no array holds them all."""
    low = F.floor(F.col(keys[0]) / chunk).alias("chunk")
    return df.groupBy(low).agg(F.sort_array(F.collect_list(F.struct(*keys, *[c for c in df.columns if c not in keys]))).alias("rows"))


def update(df: DataFrame, key: str, values: DataFrame, column: str) -> DataFrame:
    """``column`` replaced in place for the keys of ``values`` (key, column); other keys are ignored."""
    new = values.select(F.col(key).alias("__k"), F.col(column).alias("__v"))
    got = df.join(new, F.col(key) == F.col("__k"), "left")
    return got.select(*[F.when(F.col("__k").isNotNull(), F.col("__v")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns])


def get_and_delete(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rows of the keys, the store without them)."""
    gone = keys.select(key).distinct()
    return df.join(gone, key, "left_semi"), df.join(gone, key, "left_anti")


def delete_one(df: DataFrame, keys: DataFrame, key: str, order: str) -> DataFrame:
    """A bag with as many of a key's rows less as ``keys`` has of the key, in ``order``."""
    gone = keys.groupBy(key).agg(F.count(F.lit(1)).alias("__gone"))
    placed = df.join(gone, key, "left").withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return placed.where(F.col("__gone").isNull() | (F.col("__i") > F.col("__gone"))).drop("__gone", "__i")


def truncate(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def at_or_after(df: DataFrame, probes: DataFrame, key: str, width: int) -> DataFrame:
    """(probe, key): the smallest stored key at or after each probe, null beyond the last.

    Stored keys and probes of a bucket of ``width`` are swept together, backwards; a probe after
    the last key of its bucket takes the first key of the next bucket that has one.
    """
    stored = df.select(F.col(key).alias("__x"), F.lit(None).cast(df.schema[key].dataType).alias("probe"))
    both = stored.union(probes.select(F.col("probe").alias("__x"), "probe")).withColumn("__b", F.floor(F.col("__x") / width))
    back = Window.partitionBy("__b").orderBy(F.col("__x").desc(), F.col("probe").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("__k", F.last(F.when(F.col("probe").isNull(), F.col("__x")), ignorenulls=True).over(back))
    later = Window.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    firsts = both.groupBy("__b").agg(F.min(F.when(F.col("probe").isNull(), F.col("__x"))).alias("__f"))
    firsts = firsts.select("__b", F.last("__f", ignorenulls=True).over(later).alias("__next"))
    return swept.where("probe is not null").join(firsts, "__b").select("probe", F.coalesce("__k", "__next").alias(key))


def put_present(df: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """A dictionary in which only keys that are present get new values."""
    return update(df, key, values, value)


def bucket_sizes(df: DataFrame, bucket: Column) -> DataFrame:
    """(held, buckets, n): a histogram of the rows that buckets hold."""
    sizes = df.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("held"))
    return sizes.groupBy("held").agg(F.count(F.lit(1)).alias("buckets"), F.sum("held").alias("n"))


def walk(df: DataFrame, key: str, visit, schema: str, going: Column) -> DataFrame:
    """What ``visit`` makes of the rows before the first one, in key order, where ``going`` fails.

    ``visit`` takes and returns a batch of rows as a pandas frame; batches are disjoint and in no order between them.
    """

    def run(frames):
        for f in frames:
            yield visit(f)

    return take_while(df, [key], going).mapInPandas(run, schema)


def row_members(df: DataFrame, store: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether a row's fields, those that ``store`` has, are a row of it; nulls equal nulls."""
    right = store.distinct().select(*[F.col(c).alias(f"__{c}") for c in store.columns], F.lit(True).alias("__hit"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in store.columns]
    return df.join(right, on, "left").select(*df.columns, F.coalesce("__hit", F.lit(False)).alias(name))
