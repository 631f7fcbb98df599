"""Queries over the life of a cluster: node changes, replicas on the ring, reads, moves and keyspaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import placement
from .registry import query
from .systems import _H, _N, _nodes, _placed, _PLACED, scratch

#: Changes of the node table, in both engines: (version, op, node_id, weight, state, rack).
CHANGES = [(1, "add", 8, 1, "up", 0), (2, "state", 2, None, "down", None), (3, "remove", 5, None, None, None), (4, "state", 3, None, "up", None), (5, "add", 5, 2, "up", 3), (6, "state", 77, None, "up", None), (7, "remove", 6, None, None, None)]
_AFTER = "(SELECT i AS node_id, CAST(CASE WHEN i = 8 THEN 1 ELSE 1 + i % 2 END AS INTEGER) AS weight, CASE WHEN i = 2 THEN 'down' ELSE 'up' END AS state, CAST(CASE WHEN i = 5 THEN 3 ELSE i % 4 END AS INTEGER) AS rack, CAST(CASE i WHEN 8 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 5 THEN 5 ELSE 0 END AS BIGINT) AS version FROM range(0, 9) AS r(i) WHERE i <> 6)"


def _after(spark):
    log = spark.createDataFrame(CHANGES, "version int, op string, node_id long, weight int, state string, rack int")
    return placement.with_changes(_nodes(spark), log)


@query(f"SELECT * FROM {_AFTER}")
def place_lifecycle(t, spark, sf):
    """Nodes added, removed, added again, and put up and down."""
    return _after(spark)


@query(f"SELECT * FROM {_AFTER}")
def place_sync(t, spark, sf):
    """The node table written in full, and brought up to date by the rows that changed since."""
    full, path = _nodes(spark).withColumn("version", F.lit(0).cast("long")), scratch(spark)
    full.write.parquet(f"{path}/full")
    placement.delta(_after(spark), 0).write.parquet(f"{path}/delta")
    new = spark.read.parquet(f"{path}/delta")
    gone = _nodes(spark).select("node_id").subtract(_after(spark).select("node_id"))
    kept = spark.read.parquet(f"{path}/full").join(new.select("node_id").union(gone), "node_id", "left_anti")
    return kept.unionByName(new)


_POINTS = f"p AS (SELECT node_id, rack, {_H.format(chr(39).join(['node_id || ', '#', ' || k']))} AS point FROM (SELECT node_id, rack, unnest(range(0, weight * 40)) AS k FROM {_AFTER} WHERE state = 'up'))"
_WALK = f"WITH {_POINTS}, c AS (SELECT c_custkey, {_H.format('c_custkey::VARCHAR')} AS h FROM customer), w AS (SELECT c_custkey, node_id, min(CASE WHEN point >= h THEN 0 ELSE 1 END * 2000000000000000000 + point) AS far FROM c, p GROUP BY ALL) SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY far) - 1 AS replica, node_id FROM w QUALIFY replica < 3"


@query(_WALK)
def place_ring_replicas(t, spark, sf):
    """Three distinct live nodes for each key, in ring order."""
    return placement.ring_replicas(t("customer").select("c_custkey"), "c_custkey", _after(spark).drop("version"), 3)


@query("SELECT 101 AS slots, 8 AS nodes, 1 AS most_apart, true AS stable")
def place_table_turns(t, spark, sf):
    """The table that nodes fill in turns: even to one slot; few slots change when a node leaves."""
    before, after = placement.lookup_table(_nodes(spark), 101), placement.lookup_table(_nodes(spark, 5), 101)
    sizes = before.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    moved = before.join(after.withColumnRenamed("node_id", "now"), "slot").agg(F.count_if((F.col("node_id") != F.col("now")) & (F.col("node_id") != 5)).alias("moved"))
    return sizes.agg(F.sum("n").cast("int").alias("slots"), F.count(F.lit(1)).cast("int").alias("nodes"), (F.max("n") - F.min("n")).cast("int").alias("most_apart")).crossJoin(moved.select((F.col("moved") < 40).alias("stable")))


@query(f"WITH p AS ({_PLACED}), u AS (SELECT c_custkey, count(*) FILTER (node_id <> 3) AS n_up, arg_min(node_id, node_id * 7 % 5 * 100 + replica) FILTER (node_id <> 3) AS best FROM p GROUP BY 1) SELECT c_custkey, n_up, n_up >= 2 AS satisfied, CASE WHEN n_up >= 2 THEN best END AS node_id FROM u")
def place_read_plan(t, spark, sf):
    """Reads from the live replica with the least load."""
    return placement.plan_read(_placed(t, spark), "c_custkey", _nodes(spark).withColumn("load", F.col("node_id") * 7 % 5), 2, "load")


_RANKED = f"SELECT c_custkey, node_id, row_number() OVER (PARTITION BY c_custkey ORDER BY {_H.format(chr(39).join(['c_custkey || ', '/', ' || node_id']))} DESC, node_id DESC) - 1 AS replica"


@query(f"WITH a AS ({_RANKED} FROM customer, {_N} QUALIFY replica < 3), b AS ({_RANKED} FROM customer, {_N} WHERE node_id <> 5 QUALIFY replica < 3), gone AS (SELECT c_custkey FROM a WHERE node_id = 5), new AS (SELECT c_custkey, node_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.c_custkey = b.c_custkey AND a.node_id = b.node_id)) SELECT c_custkey, 0::BIGINT AS replica, 5::BIGINT AS from_node, node_id AS to_node FROM gone JOIN new USING (c_custkey)")
def place_move_list(t, spark, sf):
    """Each replica that moves when node 5 leaves, from where and to where."""
    return placement.move_list(_placed(t, spark), _placed(t, spark, 5), "c_custkey")


@query(f"WITH c AS (SELECT c_custkey, c_name AS k FROM customer), s AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 7 THEN 'sevens' ELSE 'all' END AS space FROM c), o AS (SELECT c_custkey, space, node_id, {_H.format(chr(39).join(['key || ', '/', ' || node_id']))} AS w FROM (SELECT *, (c_custkey % 10) || '-' || c_custkey AS key FROM s), {_N} WHERE space = 'all' OR rack = 1) SELECT (c_custkey % 10) || '-' || c_custkey AS key, space, arg_max(node_id, w) AS node_id FROM o GROUP BY ALL")
def place_keyspaces(t, spark, sf):
    """Keys with a prefix of their own go to the nodes of one rack."""
    spaces = spark.createDataFrame([("all", "", None), ("sevens", "7-", 1)], "space string, prefix string, rack int")
    keys = t("customer").select(F.concat_ws("-", (F.col("c_custkey") % 10).cast("string"), F.col("c_custkey").cast("string")).alias("key"))
    return placement.keyspaces(keys, "key", spaces, _nodes(spark))
