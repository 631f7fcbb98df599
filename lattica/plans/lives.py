"""Queries over stores that compact, JSON containers, caches, timers and callbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, rowstore
from ..sources import store
from ..streaming import flows
from .registry import query
from .systems import scratch


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN -1.0 WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 7 = 0")
def wal_ops(t, spark, sf):
    """Puts, a clear, puts again, deletes, writes only where present or absent, and two compactions."""
    db = store.Durable(spark, scratch(spark), "c_custkey", "c_custkey bigint, v double")
    c = t("customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    made = lambda df, v, op, at: df.select(F.col("c_custkey"), v.cast("double").alias("v"), F.lit(op).alias("op"), (F.col("c_custkey") + at * 10**9).alias("lsn"))
    db.append(1, made(c, F.lit(0), "put", 0))
    db.append(2, spark.createDataFrame([(None, None, "clear", 10**9 - 1)], "c_custkey long, v double, op string, lsn long"))
    db.append(3, made(c, F.col("v"), "put", 1))
    db.compact()
    db.append(4, made(c.where("c_custkey % 5 = 0"), F.lit(None), "del", 2))
    db.append(5, made(c.where("c_custkey % 2 = 0"), F.col("v") + 1, "upd", 3))
    db.append(6, made(c.where("c_custkey % 35 = 0"), F.lit(-1), "new", 4).unionByName(made(c.where("c_custkey % 7 = 0 and c_custkey % 5 != 0"), F.lit(-1), "put", 4)))
    db.append(7, made(c.where("c_custkey % 3 = 0 and c_custkey % 5 != 0 and c_custkey % 7 != 0"), F.lit(99), "new", 5))
    db.compact()
    return db.recover()


@query("SELECT true AS first, false AS again, true AS due, false AS after, true AS intact, 1 AS snapshots, 0 AS batches, (SELECT count(*) FROM customer) AS n")
def wal_compact(t, spark, sf):
    """Compaction is due when the log outgrows the snapshot; it leaves one snapshot and no log, and refuses a batch that it has folded."""
    db = store.Durable(spark, scratch(spark), "c_custkey", "c_custkey bigint, v double")
    c = t("customer").select("c_custkey", F.col("c_acctbal").alias("v"), F.lit("put").alias("op"), F.col("c_custkey").alias("lsn"))
    first = db.append(1, c)
    db.snapshot()
    for k in range(2, 6):
        db.append(k, c.withColumn("lsn", F.col("lsn") + k * 10**9))
    due = db.should_compact()
    db.compact()
    row = (first, db.append(3, c), due, db.should_compact(), db.verify(), len(db._numbers("snapshot")), len(db._numbers("log")), db.recover().count())
    return spark.createDataFrame([row], "first boolean, again boolean, due boolean, after boolean, intact boolean, snapshots int, batches int, n long")


@query("SELECT l_orderkey, '[' || array_to_string(list_sort(list(l_linenumber)), ',') || ']' AS arr, '[' || array_to_string(list_sort(list_distinct(list(l_linenumber % 2))), ',') || ']' AS distinct_items FROM lineitem GROUP BY 1")
def json_arrays(t, spark, sf):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("arr"), F.sort_array(F.collect_list(F.col("l_linenumber") % 2)).alias("distinct_items"))
    return store.json_array(store.json_array(rows, "arr"), "distinct_items", distinct=True)


@query("""SELECT p_partkey, '{"' || p_partkey || '":"' || p_name || '"}' AS json, '{"a":true,"b":null,"c":"q\\"\\\\t\\tn\\n","d":[1.5,null]}' AS scalars FROM part""")
def json_maps(t, spark, sf):
    """Keys that are numbers become text; true, null, escapes and nested arrays."""
    scalars = F.to_json(F.struct(F.lit(True).alias("a"), F.lit(None).cast("string").alias("b"), F.lit('q"\\t\tn\n').alias("c"), F.array(F.lit(1.5), F.lit(None)).alias("d")), {"ignoreNullFields": "false"})
    return store.json_map(t("part").select("p_partkey", "p_name"), "p_partkey", "p_name").select("p_partkey", "json", scalars.alias("scalars"))


@query("SELECT 'VALUE' || n_regionkey AS head, count(*) AS lines FROM nation GROUP BY ALL")
def file_text(t, spark, sf):
    """Whole files as one string each: one file a region is written, and read back whole."""
    path = scratch(spark)
    rows = t("nation").select("n_regionkey", F.concat(F.lit("VALUE"), F.col("n_regionkey").cast("string")).alias("value"))
    rows.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    got = store.whole_files(spark, path)
    return got.groupBy(F.get(F.split("text", "\n"), F.lit(0)).alias("head")).agg(F.sum(F.regexp_count("text", F.lit("\n"))).alias("lines"))


_ENTRIES = "e AS (SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS uses FROM events GROUP BY 1)"


@query(f"WITH {_ENTRIES} SELECT 'lru' AS policy, * FROM (SELECT * FROM e ORDER BY last, user_id LIMIT (SELECT greatest(count(*) - 10, 0) FROM e)) UNION ALL SELECT 'lfu', * FROM (SELECT * FROM e ORDER BY uses, user_id LIMIT (SELECT greatest(count(*) - 10, 0) FROM e)) UNION ALL SELECT 'ttl', * FROM (SELECT * FROM e ORDER BY first, user_id LIMIT (SELECT greatest(count(*) - 10, 0) FROM e))")
def cache_policies(t, spark, sf):
    """Ten entries stay, by three policies."""
    log = t("events").select("user_id", "event_id")
    out = [cache.evict(log, "user_id", "event_id", 10, p).select(F.lit(p).alias("policy"), "user_id", "first", "last", "uses") for p in ("lru", "lfu", "ttl")]
    return out[0].union(out[1]).union(out[2])


@query(f"WITH {_ENTRIES} SELECT * FROM e WHERE user_id % 2 = 1 ORDER BY last, user_id LIMIT (SELECT greatest(count(*) - 10, 0) FROM e)")
def cache_veto(t, spark, sf):
    """Even keys are kept by a veto, whatever their age."""
    return cache.evict(t("events").select("user_id", "event_id"), "user_id", "event_id", 10, "lru", veto=F.col("user_id") % 2 == 0)


@query("SELECT least(uses - 1, 3) AS level, count(*) AS keys, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT o_custkey, count(*) AS uses, max(o_orderkey % 9) AS w FROM orders GROUP BY 1) GROUP BY 1")
def cache_levels(t, spark, sf):
    return cache.by_level(t("orders").select("o_custkey", (F.col("o_orderkey") % 9).alias("w")), "o_custkey", "w", 4)


@query("SELECT o_orderkey, CASE WHEN d <= 0 THEN -1 WHEN d < 256 THEN 0 WHEN d < 16384 THEN 1 WHEN d < 1048576 THEN 2 WHEN d < 67108864 THEN 3 ELSE 4 END AS level, CASE WHEN d <= 0 THEN 0 WHEN d < 256 THEN due % 256 WHEN d < 16384 THEN due // 256 % 64 WHEN d < 1048576 THEN due // 16384 % 64 WHEN d < 67108864 THEN due // 1048576 % 64 ELSE 0 END AS slot FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS due, o_orderkey * o_orderkey * 37 - 5000 AS d FROM orders)")
def timer_wheel(t, spark, sf):
    """Where a wheel of four levels keeps timers that are due at a square of their number."""
    due = F.col("o_orderkey") * F.col("o_orderkey") * 37
    at = t("orders").select("o_orderkey", flows.wheel_slot(due, F.lit(5000)).alias("w"))
    return at.select("o_orderkey", "w.level", "w.slot")


def _timed(spark, sf):
    return flows.read_table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))


_MS = "epoch_us(ts) // 1000"


@query(f"WITH m AS (SELECT max({_MS}) AS w FROM events), r AS (SELECT user_id, {_MS} AS ms, {_MS} - lag({_MS}) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT user_id, ms, sum(CASE WHEN gap > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms) AS run FROM r) SELECT user_id, count(*) AS writes, max(ms) + 3600000 AS lapsed_at FROM s GROUP BY user_id, run HAVING lapsed_at < (SELECT w FROM m)")
def stream_lapse(t, spark, sf):
    """Entries that lapse an hour after their last event, by timers on event time; what is left in the state at the end has not lapsed."""
    return flows.drain(flows.lapsing(_timed(spark, sf), "ts", "user_id", 3_600_000, "0 seconds"), "append", scratch(spark))


@query()
def stream_firing(t, spark, sf):
    """Hourly timers of each user that fire with the events since the last time."""
    return flows.drain(flows.firing(_timed(spark, sf), "ts", "user_id", 3_600_000, "0 seconds"), "append", scratch(spark))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def log_callback(t, spark, sf):
    """A callback over a log that is a stream: each batch is counted where it comes by."""
    path = scratch(spark)
    events = flows.read_table(spark, sf, "events").select("event_type")
    flows.for_each_change(events, lambda rows, batch: rows.groupBy("event_type").count().write.mode("overwrite").parquet(f"{path}/batch={batch}"), f"{path}-marks")
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("count").alias("n"))


@query("SELECT o_orderkey, o_totalprice, CAST(floor(o_totalprice) AS BIGINT) % 7 AS mark FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE o_totalprice >= 400000), 9e18)")
def rs_walk(t, spark, sf):
    """A walker called on every row in key order until it says stop, and what it makes of each row."""
    return rowstore.walk(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", lambda f: f.assign(mark=f["o_totalprice"].astype("int64") % 7), "o_orderkey bigint, o_totalprice double, mark bigint", F.col("o_totalprice") < 400000)
