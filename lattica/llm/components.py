"""Connected components by alternating star contraction; works on edges in parallel, never in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that a task handles at least; few edges over many tasks are many small files.
EDGES_A_TASK = 100_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: longs) but the components' smallest nodes.

    A round links every node's larger neighbours to its smallest neighbour, then every
    node and its smaller neighbours to the smallest of them. Edges stay linear in number
    and settle into stars after a number of rounds logarithmic in the nodes. A null end or
    an edge of a node with itself is left out.
    """
    stars = edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    stars, before = common.cut(stars), None
    tasks = max(8, stars.count() // EDGES_A_TASK)
    for _ in range(most_rounds):
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = common.cut(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct().coalesce(tasks))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        settled = common.cut(small.union(least.select("hi", F.col("m").alias("lo"))).distinct().coalesce(tasks))
        common.drop(stars, large)
        stars = settled
        mark = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if mark == before:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
