"""Placement of keys on nodes: rendezvous, ring, jump and table hashing, quorums, spread, rebalancing.

Node tables are small (a cluster's members) and are broadcast after a check of their size.
``hash60`` is a 60-bit hash that any SQL engine with md5 reproduces; ``fast`` hashes use xxhash64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import small

MOST_NODES = 10_000


def hash60(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def _nodes(nodes: DataFrame) -> DataFrame:
    return small(nodes, MOST_NODES)


def rendezvous(keys: DataFrame, key: str, nodes: DataFrame, replicas: int) -> DataFrame:
    """(key, replica, node_id): the nodes with the largest hash of key and node.

    The nodes go along as one array literal's worth of data on each row, so keys stay where
    they are: no shuffle, and the top-k is taken inside the row.
    """
    ids = _nodes(nodes).agg(F.sort_array(F.collect_list("node_id")).alias("ids")).scalar()
    scored = F.transform("ids", lambda n: F.struct(hash60(F.concat_ws("/", F.col(key).cast("string"), n.cast("string"))).alias("w"), n.alias("n")))
    best = F.slice(F.sort_array(scored, asc=False), 1, replicas)
    return keys.select(key, ids.alias("ids")).select(key, F.posexplode(best).alias("replica", "b")).select(key, F.col("replica").cast("long").alias("replica"), F.col("b.n").alias("node_id"))


def ring_points(nodes: DataFrame, points: int) -> DataFrame:
    """(point, node_id): ``points`` times weight positions of each node."""
    return nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.col("weight") * points - 1)).alias("i")).select(hash60(F.concat_ws("#", F.col("node_id").cast("string"), F.col("i").cast("string"))).alias("point"), "node_id")


def ring(keys: DataFrame, key: str, nodes: DataFrame, points: int = 40) -> DataFrame:
    """(key, node_id): the node, whatever its state, of the first ring point at or after the key's hash, wrapping around."""
    return ring_replicas(keys, key, nodes.select("node_id", "weight"), 1, points).select(key, "node_id")


def ring_replicas(keys: DataFrame, key: str, nodes: DataFrame, replicas: int, points: int = 40) -> DataFrame:
    """(key, replica, node_id): the first distinct nodes from the key's place on the ring on.

    Nodes that aren't up (column state, if there is one) are passed over. The ring, of checked size, is
    sorted once and goes to the tasks; each batch of keys is placed by binary search, so
    keys aren't shuffled. Fewer live nodes than replicas give as many as there are.
    """
    live = nodes.where("state = 'up'") if "state" in nodes.columns else nodes
    small(live, MOST_NODES)
    sorted_points = [(r["point"], r["node_id"]) for r in ring_points(live, points).orderBy("point", "node_id").collect()]
    at = keys.sparkSession.sparkContext.broadcast((np.array([p for p, _ in sorted_points], np.int64), np.array([n for _, n in sorted_points], np.int64)))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, owner = at.value
        follow: dict[int, list[int]] = {}  # replicas from each point that a key came to

        def walk(start: int) -> list[int]:
            found: dict[int, None] = {}
            for step in range(len(owner)):
                found.setdefault(int(owner[(start + step) % len(owner)]))
                if len(found) == replicas:
                    break
            return list(found)

        for f in frames:
            starts = np.searchsorted(where, f["__h"].to_numpy(np.int64)) % max(len(where), 1)
            for s in np.unique(starts).tolist():
                if s not in follow:
                    follow[s] = walk(s)
            lists = [follow[s] for s in starts.tolist()]
            rows = np.repeat(np.arange(len(f)), [len(x) for x in lists])
            yield pd.DataFrame({key: f[key].to_numpy()[rows], "replica": np.concatenate([np.arange(len(x)) for x in lists] or [[]]).astype(np.int64), "node_id": np.array([n for x in lists for n in x], np.int64)})

    hashed = keys.select(key, hash60(F.col(key)).alias("__h"))
    return hashed.mapInPandas(place, f"`{key}` {dict(hashed.dtypes)[key]}, replica bigint, node_id bigint")


def with_changes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """The node table after a log of changes (version, op, node_id, weight, state, rack).

    ``add`` puts a node, ``state`` changes the state of a node that is there, ``remove`` takes it out.
    Changes of a node apply by version; a state of an absent node is ignored. Each row keeps the version that last touched it.
    """
    columns = ["node_id", "weight", "state", "rack"]
    start = nodes.select(*columns, F.lit(0).cast("long").alias("version"), F.lit("add").alias("op"))
    log = start.unionByName(changes.select(*columns, F.col("version").cast("long"), "op"))
    upto = Window.partitionBy("node_id").orderBy("version")
    row = F.struct("weight", "rack")
    seen = log.withColumn("__put", F.last(F.when(F.col("op") != "state", F.struct("op", row.alias("row"), "state", F.col("version").alias("at"))), ignorenulls=True).over(upto))
    seen = seen.withColumn("__state", F.when(F.col("op") == "state", F.col("state")).otherwise(F.col("__put.state")))
    last = seen.groupBy("node_id").agg(F.max_by(F.struct("__put", "__state", "version"), "version").alias("r")).where("r.__put.op = 'add'")
    return last.select("node_id", F.col("r.__put.row.weight").alias("weight"), F.col("r.__state").alias("state"), F.col("r.__put.row.rack").alias("rack"), F.col("r.version").alias("version"))


def delta(nodes: DataFrame, since: int) -> DataFrame:
    """Rows that changed after a version; with ``with_changes`` of a full copy they bring it up to date."""
    return nodes.where(F.col("version") > since)


def plan_read(placed: DataFrame, key: str, nodes: DataFrame, need: int, load: str) -> DataFrame:
    """(key, n_up, satisfied, node_id): reads go to the live replica with the least load, if enough replicas live."""
    up = placed.join(_nodes(nodes.where("state = 'up'").select("node_id", load)), "node_id")
    best = up.groupBy(key).agg(F.count(F.lit(1)).alias("n_up"), F.min_by("node_id", F.struct(load, "replica")).alias("__best"))
    every = placed.select(key).distinct().join(best, key, "left")
    enough = F.coalesce(F.col("n_up") >= need, F.lit(False))
    return every.select(key, F.coalesce("n_up", F.lit(0)).cast("long").alias("n_up"), enough.alias("satisfied"), F.when(enough, F.col("__best")).alias("node_id"))


def move_list(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, replica, from_node, to_node): the replicas that a change of nodes moves; the nodes left and joined are paired in order."""
    left = before.join(after.select(key, "node_id"), [key, "node_id"], "left_anti")
    new = after.join(before.select(key, "node_id"), [key, "node_id"], "left_anti")
    numbered = lambda df: df.select(key, "node_id", (F.row_number().over(Window.partitionBy(key).orderBy("replica")) - 1).cast("long").alias("replica"))
    return numbered(left).withColumnRenamed("node_id", "from_node").join(numbered(new).withColumnRenamed("node_id", "to_node"), [key, "replica"], "full").select(key, "replica", "from_node", "to_node")


def keyspaces(keys: DataFrame, key: str, spaces: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, space, node_id): keys routed to the space with the longest prefix of theirs, then to a node of its rack by rendezvous.

    Spaces (space, prefix, rack) are few and broadcast; a null rack takes all nodes.
    """
    routed = keys.join(small(spaces, MOST_NODES), F.col(key).cast("string").startswith(F.col("prefix")), "left")
    best = routed.groupBy(key).agg(F.max_by(F.struct("space", "rack"), F.char_length("prefix")).alias("s")).select(key, "s.*")
    offers = _nodes(nodes.select("node_id", F.col("rack").alias("__rack")))
    weight = hash60(F.concat_ws("/", F.col(key).cast("string"), F.col("node_id").cast("string")))
    placed = best.where("space is not null").join(offers, F.col("rack").isNull() | (F.col("rack") == F.col("__rack")))
    return placed.groupBy(key, "space").agg(F.max_by("node_id", F.struct(weight, "node_id")).alias("node_id"))


#: Jumps that are folded in an expression; jumps number about the logarithm of the buckets, and a key that needs more raises.
JUMPS = 64


def jump(h: Column, buckets: int) -> Column:
    """Jump consistent hash of a non-negative 60-bit hash: a fold over jumps until one passes the last bucket.

    The generator is a linear congruence modulo 2**31 - 1, so nothing overflows.
    """
    start = F.struct(F.pmod(h, F.lit(2147483647)).alias("x"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s, _):
        x = (s["x"] * F.lit(48271) + F.lit(11)) % F.lit(2147483647)
        j = F.floor((s["j"] + 1) * (F.lit(2147483647.0) / (x + 1))).cast("long")
        return F.when(s["j"] >= buckets, s).otherwise(F.struct(x.alias("x"), s["j"].alias("b"), j.alias("j")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(JUMPS)), start, step)
    return F.when(end["j"] >= buckets, end["b"]).otherwise(F.raise_error(F.lit(f"a key has not settled in {JUMPS} jumps")))


def lookup_table(nodes: DataFrame, size: int) -> DataFrame:
    """A permutation table (slot, node_id), filled in turns: each node in turn takes the first free slot of its preference list.

    ``size`` is prime and the nodes are few (checked), so the table, which every key is looked up in, is filled
    on the driver; nodes' shares differ by one slot at most.
    """
    text = F.col("node_id").cast("string")
    ordered = nodes.select("node_id", (hash60(F.concat(F.lit("o"), text)) % size).alias("offset"), (hash60(F.concat(F.lit("s"), text)) % (size - 1) + 1).alias("skip"))
    small(ordered, MOST_NODES)
    rows, taken, turn = ordered.orderBy("node_id").collect(), {}, {}
    while rows and len(taken) < size:
        for r in rows:
            k = turn.get(r["node_id"], 0)
            while (slot := (r["offset"] + k * r["skip"]) % size) in taken:
                k += 1
            taken[slot], turn[r["node_id"]] = r["node_id"], k + 1
            if len(taken) == size:
                break
    return nodes.sparkSession.createDataFrame(sorted(taken.items()), "slot int, node_id long")


def plan_quorum(placed: DataFrame, key: str, nodes: DataFrame, need: int) -> DataFrame:
    """(key, n_up, satisfied, primary): replicas on nodes that are up against a quorum."""
    up = placed.join(_nodes(nodes.where("state = 'up'").select("node_id")), "node_id")
    live = up.groupBy(key).agg(F.count(F.lit(1)).alias("n_up"), F.min_by("node_id", "replica").alias("primary"))
    every = placed.select(key).distinct().join(live, key, "left")
    return every.select(key, F.coalesce("n_up", F.lit(0)).cast("long").alias("n_up"), F.coalesce(F.col("n_up") >= need, F.lit(False)).alias("satisfied"), "primary")


def spread(placed: DataFrame, key: str, nodes: DataFrame, level: str, least: int) -> DataFrame:
    """(key, n_distinct, satisfied): distinct values of a topology level among a key's replicas."""
    got = placed.join(_nodes(nodes.select("node_id", level)), "node_id").groupBy(key).agg(F.count_distinct(level).alias("n_distinct"))
    return got.withColumn("satisfied", F.col("n_distinct") >= least)


def moves(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(from_node, to_node, n): how many keys a change of nodes moves."""
    both = before.select(key, F.col("node_id").alias("from_node")).join(after.select(key, F.col("node_id").alias("to_node")), key)
    return both.where("from_node != to_node").groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("n"))


def checked(nodes: DataFrame, provider: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """``nodes`` with the states that a provider gives: it is called with batches of nodes as pandas frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(state=provider(f).to_numpy())

    return nodes.mapInPandas(run, nodes.schema)
