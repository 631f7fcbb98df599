"""Bounded caches replayed over an access log: segmented LRU with levels, plain LRU, expiry."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered, running_sum


class SegmentedLRU:
    """Entries rise a level on each access; the coldest entry of the lowest used level is evicted, or demoted if above level 0."""

    def __init__(self, capacity: int, levels: int = 4) -> None:
        self.capacity, self.levels = capacity, [OrderedDict() for _ in range(levels)]
        self.at: dict = {}

    def access(self, key) -> tuple[bool, list]:
        """(hit, evicted keys)."""
        if key in self.at:
            level = self.at[key]
            del self.levels[level][key]
            level = min(level + 1, len(self.levels) - 1)
            self.levels[level][key] = True
            self.at[key] = level
            return True, []
        self.levels[0][key] = True
        self.at[key] = 0
        out = []
        while len(self.at) > self.capacity:
            gone, evicted = self.remove_minimum()
            if evicted:
                out.append(gone)
        return False, out

    def remove_minimum(self):
        """The coldest entry: (key, evicted); an entry above level 0 is demoted one level instead."""
        level = next(k for k, entries in enumerate(self.levels) if entries)
        key, _ = self.levels[level].popitem(last=False)
        if level:
            self.levels[level - 1][key] = True
            self.at[key] = level - 1
            return key, False
        del self.at[key]
        return key, True


def replay(log: DataFrame, shard: str, order: str, key: str, capacity: int, levels: int = 4) -> DataFrame:
    """(shard, accesses, hits, evictions): each shard's log replayed in order.

    The cache is sharded, as a large cache is, so the replay is parallel over shards. A shard's log is
    one group, sent as a whole to a task: choose as many shards as keep it in memory.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache, hits, evictions = SegmentedLRU(capacity, levels), 0, 0
        for k in pdf.sort_values(order)[key]:
            hit, out = cache.access(k)
            hits += hit
            evictions += len(out)
        return pd.DataFrame({"shard": [pdf[shard].iloc[0]], "accesses": [len(pdf)], "hits": [hits], "evictions": [evictions]})

    return log.select(shard, order, key).groupBy(shard).applyInPandas(run, "shard bigint, accesses bigint, hits bigint, evictions bigint")


def expired(log: DataFrame, key: str, ts: str, ttl_us: int, now_us) -> DataFrame:
    """Each key's last write and whether it has outlived the time to live at ``now_us``."""
    return log.groupBy(key).agg(F.max(ts).alias("last")).withColumn("expired", F.col("last") + F.lit(ttl_us) <= now_us)


def coldest(log: DataFrame, key: str, ts: str, weight: str, keep: float) -> DataFrame:
    """Keys to evict, least recently used first, until the weight of the rest is at most ``keep``."""
    entries = log.groupBy(key).agg(F.max(ts).alias("last"), F.max_by(weight, ts).alias("w"))
    return running_sum(entries, "last", "w", "__w", [key], desc=True).where(F.col("__w") > keep).drop("__w")


def evict(log: DataFrame, key: str, ts: str, keep: int, policy: str, seed: int = 1, veto: Column | None = None) -> DataFrame:
    """Keys to evict until ``keep`` keys are left: by ``lru`` (least recently used first), ``lfu`` (least often used), ``random`` (by a seeded hash) or ``ttl`` (oldest first write).

    ``veto``, over the columns key, first, last and uses, keeps keys from eviction; they count among those left.
    """
    entries = log.groupBy(key).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("uses"))
    order = {"lru": F.col("last"), "lfu": F.col("uses"), "random": F.xxhash64(F.lit(seed), F.col(key)), "ttl": F.col("first")}[policy]
    held = F.coalesce(veto, F.lit(False)) if veto is not None else F.lit(False)
    entries = entries.withColumn("__held", held).withColumn("__o", order)
    over = entries.agg(F.greatest(F.count(F.lit(1)) - keep, F.lit(0)).alias("n")).scalar()
    placed = numbered(entries.where("not __held"), "__o", "__p", [key])
    return placed.where(F.col("__p") < over).drop("__held", "__o", "__p")


def by_level(log: DataFrame, key: str, weight: str, levels: int) -> DataFrame:
    """(level, keys, weight): entries by the level that their uses raise them to, and what they weigh."""
    entries = log.groupBy(key).agg(F.least(F.count(F.lit(1)) - 1, F.lit(levels - 1)).alias("level"), F.max(weight).alias("__w"))
    return entries.groupBy("level").agg(F.count(F.lit(1)).alias("keys"), F.sum("__w").alias("weight"))
