"""Queries over placement, search, durability, caches and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import cache, dictionary, placement, series
from ..sources import store
from ..streaming import flows
from .registry import query


def scratch(spark: SparkSession) -> str:
    """A folder of this session that all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lattica-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def _nodes(spark, skip: int | None = None):
    rows = [(i, 1 + i % 2, "down" if i == 3 else "up", i % 4) for i in range(8) if i != skip]
    return spark.createDataFrame(rows, "node_id long, weight int, state string, rack int")


_H = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_N = "(SELECT i AS node_id, 1 + i % 2 AS weight, CASE WHEN i = 3 THEN 'down' ELSE 'up' END AS state, i % 4 AS rack FROM range(0, 8) AS r(i))"
_PLACED = f"SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY {_H.format(chr(39).join(['c_custkey || ', '/', ' || node_id']))} DESC, node_id DESC) - 1 AS replica, node_id FROM customer, {_N} QUALIFY replica < 3"


def _placed(t, spark, skip=None):
    return placement.rendezvous(t("customer").select("c_custkey"), "c_custkey", _nodes(spark, skip), 3)


@query(_PLACED)
def place_rendezvous(t, spark, sf):
    return _placed(t, spark)


@query(f"WITH p AS (SELECT node_id, {_H.format(chr(39).join(['node_id || ', '#', ' || k']))} AS point FROM (SELECT node_id, unnest(range(0, weight * 40)) AS k FROM {_N})), c AS (SELECT c_custkey, {_H.format('c_custkey::VARCHAR')} AS h FROM customer) SELECT c_custkey, coalesce((SELECT arg_min(node_id, point) FROM p WHERE point >= h), (SELECT arg_min(node_id, point) FROM p)) AS node_id FROM c")
def place_ring(t, spark, sf):
    return placement.ring(t("customer").select("c_custkey"), "c_custkey", _nodes(spark))


@query("SELECT count(*) AS keys, true AS in_range, true AS only_to_new FROM customer")
def place_jump(t, spark, sf):
    """Growing from 10 to 11 buckets only moves keys to the new one."""
    h = placement.hash60(F.col("c_custkey"))
    both = t("customer").select(placement.jump(h, 10).alias("a"), placement.jump(h, 11).alias("b"))
    return both.agg(F.count(F.lit(1)).alias("keys"), F.bool_and(F.col("a").between(0, 9) & F.col("b").between(0, 10)).alias("in_range"), F.bool_and((F.col("a") == F.col("b")) | (F.col("b") == 10)).alias("only_to_new"))


@query("SELECT 101 AS slots, 8 AS nodes, true AS even")
def place_table(t, spark, sf):
    got = placement.lookup_table(_nodes(spark), 101).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return got.agg(F.sum("n").cast("int").alias("slots"), F.count(F.lit(1)).cast("int").alias("nodes"), (F.max("n") <= 3 * F.min("n")).alias("even"))


@query(f"WITH p AS ({_PLACED}), u AS (SELECT c_custkey, count(*) FILTER (node_id <> 3) AS n_up, arg_min(node_id, replica) FILTER (node_id <> 3) AS primary FROM p GROUP BY 1) SELECT c_custkey, n_up, n_up >= 3 AS satisfied, primary FROM u".replace("primary", '"primary"'))
def place_quorum(t, spark, sf):
    return placement.plan_quorum(_placed(t, spark), "c_custkey", _nodes(spark), 3)


@query(f"WITH p AS ({_PLACED}) SELECT c_custkey, count(DISTINCT node_id % 4) AS n_distinct, count(DISTINCT node_id % 4) >= 2 AS satisfied FROM p GROUP BY 1")
def place_affinity(t, spark, sf):
    return placement.spread(_placed(t, spark), "c_custkey", _nodes(spark), "rack", 2)


@query(f"WITH h AS (SELECT c_custkey, node_id, {_H.format(chr(39).join(['c_custkey || ', '/', ' || node_id']))} AS w FROM customer, {_N}), m AS (SELECT c_custkey, arg_max(node_id, w) AS a, arg_max(node_id, w) FILTER (node_id <> 5) AS b FROM h GROUP BY 1) SELECT a AS from_node, b AS to_node, count(*) AS n FROM m WHERE a <> b GROUP BY ALL")
def place_rebalance(t, spark, sf):
    """Keys that move when node 5 leaves."""
    first = _placed(t, spark).where("replica = 0")
    return placement.moves(first, _placed(t, spark, 5).where("replica = 0"), "c_custkey")


_TERMS = "SELECT doc_id, pos - 1 AS pos, term FROM (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n.,;:!?]+'), lambda x: length(x) > 2) AS w FROM documents))"


@query(f"SELECT term, doc_id, count(*) AS freq, min(pos) AS first_pos FROM ({_TERMS}) GROUP BY ALL")
def search_index(t, spark, sf):
    return dictionary.inverted_index(t("documents"), "doc_id", "text")


@query(f"SELECT doc_id, count(DISTINCT term) AS hits, count(*) AS freq FROM ({_TERMS}) WHERE term IN ('the', 'und', 'password') GROUP BY 1")
def search_query(t, spark, sf):
    got = dictionary.search(dictionary.inverted_index(t("documents"), "doc_id", "text"), "doc_id", ["the", "und", "password"])
    return got.select("doc_id", "hits", F.col("freq").cast("long").alias("freq"))


@query("SELECT c_custkey, c_acctbal * CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS v FROM customer WHERE c_custkey % 5 <> 0")
def wal_recover(t, spark, sf):
    """Puts, a snapshot, later changes and deletes, a batch that comes twice, and recovery."""
    db = store.Durable(spark, scratch(spark), "c_custkey", "c_custkey bigint, v double")
    c = t("customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    db.append(1, c.select("c_custkey", "v", F.lit("put").alias("op"), F.col("c_custkey").alias("lsn")))
    db.snapshot()
    third = c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("v") * 2).alias("v"), F.lit("put").alias("op"), (F.col("c_custkey") + 10**9).alias("lsn"))
    db.append(2, third)
    db.append(2, third)
    fifth = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit(None).cast("double").alias("v"), F.lit("del").alias("op"), (F.col("c_custkey") + 2 * 10**9).alias("lsn"))
    db.append(3, fifth)
    return db.recover()


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def json_emit(t, spark, sf):
    return store.json_rows(t("nation"), ["n_nationkey", "n_name"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_roundtrip(t, spark, sf):
    path = scratch(spark)
    store.write_json(t("nation"), path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@query()
def lru_replay(t, spark, sf):
    log = t("events").select((F.col("user_id") % 16).alias("shard"), "event_id", F.col("user_id").alias("key"))
    return cache.replay(log, "shard", "event_id", "key", 8)


@query("SELECT user_id, max(epoch_us(ts)) AS last, max(epoch_us(ts)) + 86400000000 <= 1705000000000000 AS expired FROM events GROUP BY 1")
def cache_ttl(t, spark, sf):
    e = t("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return cache.expired(e, "user_id", "ts", 86_400_000_000, 1_705_000_000_000_000)


@query("WITH e AS (SELECT user_id, max(event_id) AS last, arg_max(event_id % 7 + 1, event_id) AS w FROM events GROUP BY 1) SELECT user_id, last, w FROM e QUALIFY sum(w) OVER (ORDER BY last DESC, user_id DESC) > 50")
def cache_evict_weight(t, spark, sf):
    return cache.coldest(t("events").select("user_id", "event_id", (F.col("event_id") % 7 + 1).alias("weight")), "user_id", "event_id", "weight", 50)


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window(t, spark, sf):
    events = flows.read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.drain(flows.windows(events, "ts", "1 day", ["event_type"], "10 minutes"), "complete", scratch(spark))


_GAP = "SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > ts - INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events"


@query(f"SELECT min(ts) AS started, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM ({_GAP})) GROUP BY user_id, s")
def stream_session(t, spark, sf):
    events = flows.read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.drain(flows.sessions(events, "ts", "6 hours", ["user_id"], "10 minutes"), "complete", scratch(spark))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t, spark, sf):
    events = flows.read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.drain(flows.distinct_within(events, "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), "append", scratch(spark))


@query("SELECT user_id, count(*) AS writes, count(*) FILTER (d > 21600000000) AS expiries FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, value) AS d FROM events) GROUP BY 1")
def stream_ttl(t, spark, sf):
    events = flows.read_table(spark, sf, "events").select("user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return flows.drain(flows.expiring(events, "user_id", "us", "value", 21_600_000_000), "update", scratch(spark), ["user_id"])


@query("SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) // 3600000000 AS fired FROM events GROUP BY 1")
def stream_timer(t, spark, sf):
    events = flows.read_table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return flows.drain(flows.timers(events, "user_id", "us", 3_600_000_000), "update", scratch(spark), ["user_id"])


@query("SELECT l_shipdate, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-02-01' GROUP BY 1")
def log_range(t, spark, sf):
    from ..operators.rowstore import range_scan

    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    part = range_scan(t("lineitem"), "l_shipdate", stamp("1995-01-01"), stamp("1995-02-01"), high_open=True)
    return part.groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events QUALIFY false".replace(" QUALIFY false", " GROUP BY 1"))
def dashboard(t, spark, sf):
    got = series.moments(t("events"), ["event_type"], "value")
    return got.select("event_type", "n", "mean")
