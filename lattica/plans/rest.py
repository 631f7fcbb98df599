"""Queries over big-number sets, file formats, row membership, random draws, free codes, blobs, appends and health."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dictionary, placement, rowstore, scored, series
from ..operators.order import numbered
from .cluster import _WALK, _after
from .registry import query
from .systems import scratch

_BIG = "SELECT DISTINCT (o_custkey::HUGEINT * 1000000000000000000 * 1000000 + o_orderkey % 3)::DECIMAL(38,0) AS v FROM orders"


@query(f"SELECT v::VARCHAR AS v, row_number() OVER (ORDER BY v) - 1 AS pos, v > 5000000000000000000000000::DECIMAL(38,0) AS above FROM ({_BIG})")
def set_big(t, spark, sf):
    """An ordered set of numbers beyond 64 bits, with positions."""
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    v = (F.col("o_custkey").cast("decimal(12,0)") * F.lit(str(10**24)).cast("decimal(25,0)") + F.col("o_orderkey") % 3).cast("decimal(38,0)")
    values = numbered(t("orders").select(v.alias("v")).distinct(), "v", "pos")
    return values.select(F.col("v").cast("string").alias("v"), "pos", (F.col("v") > big(5 * 10**24)).alias("above"))


@query("SELECT f AS format, n_nationkey, n_name, n_regionkey FROM nation, (SELECT unnest(['csv', 'json', 'orc', 'parquet', 'text']) AS f)")
def store_formats(t, spark, sf):
    """A table through every file format."""
    path, rows = scratch(spark), t("nation").select("n_nationkey", "n_name", "n_regionkey")
    schema, out = rows.schema, []
    for name in ("csv", "json", "orc", "parquet"):
        rows.write.format(name).save(f"{path}/{name}")
        out.append(spark.read.format(name).schema(schema).load(f"{path}/{name}").select(F.lit(name).alias("format"), "*"))
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/text")
    out.append(spark.read.text(f"{path}/text").select(F.from_json("value", schema).alias("r")).select(F.lit("text").alias("format"), "r.*"))
    return reduce(lambda a, b: a.union(b), out)


@query("SELECT op, count(*) AS n FROM (SELECT '<' AS op FROM orders WHERE NOT o_custkey < 50 UNION ALL SELECT '<=' FROM orders WHERE NOT o_custkey <= 50 UNION ALL SELECT '>' FROM orders WHERE NOT o_custkey > 50 UNION ALL SELECT '>=' FROM orders WHERE NOT o_custkey >= 50 UNION ALL SELECT '=' FROM orders WHERE NOT o_custkey = 50 UNION ALL SELECT '!=' FROM orders WHERE NOT o_custkey <> 50) GROUP BY 1")
def rs_delete_ops(t, spark, sf):
    """What each kind of predicate leaves."""
    left = [rowstore.delete(t("orders"), rowstore.matches("o_custkey", op, 50)).select(F.lit(op).alias("op")) for op in rowstore.OPS]
    return reduce(lambda a, b: a.union(b), left).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey, l_returnflag) IN (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_quantity = 50) AS held FROM lineitem")
def rs_row_member(t, spark, sf):
    """Whether whole rows of two fields are in a store."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    stored = t("lineitem").where("l_quantity = 50").select("l_partkey", "l_returnflag")
    return rowstore.row_members(rows, stored, "held").select("l_orderkey", "l_linenumber", "held")


@query("SELECT c_nationkey, least(count(*), 3) AS popped, count(*) - least(count(*), 3) AS stay, 0::BIGINT AS both, 5::BIGINT AS draws, true AS inside FROM customer GROUP BY 1")
def sset_random_pop(t, spark, sf):
    """Random members taken out, and draws with repeats."""
    a = t("customer").select("c_nationkey", "c_custkey")
    gone, left = scored.random_pop(a, ["c_nationkey"], "c_custkey", 3)
    drawn = scored.random_draws(a, ["c_nationkey"], "c_custkey", 5)
    sides = gone.select("c_nationkey", "c_custkey", F.lit(1).alias("s")).union(left.select("c_nationkey", "c_custkey", F.lit(2)))
    per = sides.groupBy("c_nationkey", "c_custkey").agg(F.bit_or("s").alias("s"), F.count(F.lit(1)).alias("k"))
    counts = per.groupBy("c_nationkey").agg(F.count_if(F.col("s") == 1).alias("popped"), F.count_if(F.col("s") == 2).alias("stay"), F.count_if((F.col("s") == 3) | (F.col("k") > 1)).alias("both"))
    hits = drawn.join(a.withColumn("hit", F.lit(True)), ["c_nationkey", "c_custkey"], "left").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("draws"), F.bool_and(F.coalesce("hit", F.lit(False))).alias("inside"))
    return counts.join(hits, "c_nationkey")


@query("WITH d AS (SELECT p_type AS value, row_number() OVER (ORDER BY p_type) - 1 AS code FROM part GROUP BY 1), l AS (SELECT code FROM d WHERE code % 3 <> 1) SELECT (SELECT min(k) FROM range(0, 1000) AS r(k) WHERE k NOT IN (SELECT code FROM l)) AS free_code, (SELECT count(*) FROM l) AS held")
def dict_free_code(t, spark, sf):
    """The smallest code that no value holds."""
    words = dictionary.dictionary(t("part").select("p_type"), "p_type").where("code % 3 != 1")
    return dictionary.smallest_free(words).join(F.broadcast(words.agg(F.count(F.lit(1)).alias("held"))))


@query("SELECT o_orderkey, c_name::BLOB AS blob, octet_length(c_name::BLOB) AS size FROM orders JOIN customer ON o_custkey = c_custkey".replace("c_name::BLOB AS blob", "hex(c_name) AS blob"))
def heap_lookup(t, spark, sf):
    """Blobs read through their references."""
    blobs = t("customer").select(F.col("c_custkey").alias("ref"), F.encode("c_name", "UTF-8").alias("object"))
    got = rowstore.lookup(t("orders").select("o_orderkey", F.col("o_custkey").alias("ref")), blobs, "ref", ["object"]).where("found")
    return got.select("o_orderkey", F.hex("object").alias("blob"), F.octet_length("object").cast("long").alias("size"))


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 64 AS block, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 64 AS place, event_id FROM events")
def ts_append(t, spark, sf):
    """Series that grow at their end, in blocks of 64 values; an append fills the last block first."""
    e = t("events").select("user_id", "event_id")
    old = series.blocks(e.where("event_id % 1000 < 300 and event_id < 300"), ["user_id"], "event_id", 64)
    return series.append(old, e.where("not (event_id % 1000 < 300 and event_id < 300)"), ["user_id"], "event_id", 64)


@query("SELECT doc_id, left_grapheme(text, 3) AS head, length_grapheme(left(text, 60)) AS n FROM documents WHERE text IS NOT NULL AND NOT contains(left(text, 70), chr(13))")
def txt_grapheme_head(t, spark, sf):
    """The first three characters as a reader sees them, and how many such there are in 60 code points."""
    d = t("documents").select("doc_id", F.col("text").alias("s")).where("s is not null").where(~F.left("s", F.lit(70)).contains("\r"))
    return d.select("doc_id", text.grapheme_head(F.col("s"), 3).alias("head"), text.grapheme_count(F.left("s", F.lit(60))).alias("n"))


@query("SELECT o_orderkey, true AS same, false AS other FROM orders")
def txt_number_match(t, spark, sf):
    """Text against a number: equal if it reads as that number."""
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", text.matches_number(F.concat(F.lit("+00"), k.cast("string")), k).alias("same"), text.matches_number(F.concat(k.cast("string"), F.lit("x")), k).alias("other"))


@query("SELECT true AS ordered, true AS near")
def sys_clocks(t, spark, sf):
    """Wall clock in four units, of one instant."""
    now = F.current_timestamp()
    return spark.range(1).select(
        ((F.call_function("div", F.unix_micros(now), F.lit(1000)) == F.unix_millis(now)) & (F.call_function("div", F.unix_millis(now), F.lit(1000)) == F.unix_seconds(now))).alias("ordered"),
        (F.unix_seconds(now) > 1_700_000_000).alias("near"),
    )


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY NOT (count(*) OVER (PARTITION BY c_nationkey) > 6 AND row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 BETWEEN 2 AND 6)")
def sset_remove_rank_strict(t, spark, sf):
    """A range of ranks that isn't wholly inside a set removes nothing from it."""
    a = t("customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return scored.remove_ranks(a, ["c_nationkey"], "c_acctbal", "c_custkey", 2, 6, strict=True)


@query(_WALK)
def place_health(t, spark, sf):
    """States that a health provider gives: a function of each node's figures decides, and placement follows."""
    seen = _after(spark).drop("version").withColumn("cpu", F.when(F.col("state") == "up", 0.3).otherwise(0.99)).withColumn("state", F.lit("unknown"))
    checked = placement.checked(seen, lambda f: pd.Series(["up" if x < 0.9 else "down" for x in f["cpu"]]))
    return placement.ring_replicas(t("customer").select("c_custkey"), "c_custkey", checked, 3)
