"""Queries over sorted rows, key sets and scored sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary, keys, rowstore, scored
from ..operators.order import numbered
from .registry import query


@query("WITH s AS (SELECT event_type, user_id, round(sum(value), 4) AS score FROM events GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id DESC) AS place FROM s QUALIFY place <= 10")
def sset_leaderboard(t, spark, sf):
    """The users with the largest summed value of each event type."""
    sums = t("events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("score"))
    return scored.top(sums, ["event_type"], "score", "user_id", 10)


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000")
def rs_range_scan(t, spark, sf):
    from ..operators.bitmap import ranks

    part = rowstore.range_scan(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 2000)
    return part.join(ranks(part, "o_orderkey").withColumnRenamed("rank", "pos"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC")
def rs_scan_reverse(t, spark, sf):
    return rowstore.scan(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", forward=False)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE NOT o_totalprice < 400000), 9e18)")
def rs_take_while(t, spark, sf):
    return rowstore.take_while(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], F.col("o_totalprice") < 400000)


@query("SELECT arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS first_o_orderkey, arg_min(o_custkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS first_o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_o_orderkey, arg_max(o_custkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_o_custkey FROM orders")
def rs_first_last(t, spark, sf):
    return rowstore.first_last(t("orders"), ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_custkey"])


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 5) AS mean, min(value) AS low, max(value) AS high FROM events WHERE event_id BETWEEN 500 AND 5000 GROUP BY 1")
def rs_range_agg(t, spark, sf):
    part = rowstore.range_scan(t("events"), "event_id", 500, 5000)
    return part.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 5).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT l_orderkey, l_linenumber, p_name, p_size, p_partkey IS NOT NULL AS found FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def rs_lookup(t, spark, sf):
    probes = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    got = rowstore.lookup(probes, t("part").where("p_size > 10"), "p_partkey", ["p_name", "p_size"])
    return got.drop("p_partkey")


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def rs_upsert_fold(t, spark, sf):
    return rowstore.upsert(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT s_nationkey AS k, s_suppkey AS v FROM supplier UNION ALL SELECT c_nationkey, c_custkey FROM customer")
def rs_insert_bag(t, spark, sf):
    a = t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v"))
    return rowstore.bag_insert(a, t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v")))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT o_orderkey <= 5000")
def rs_delete_pred(t, spark, sf):
    return rowstore.delete(t("orders").select("o_orderkey", "o_orderstatus"), rowstore.matches("o_orderkey", "<=", 5000))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rs_delete_keys(t, spark, sf):
    gone = t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return rowstore.delete_keys(t("customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query("SELECT user_id, event_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, event_type, 1 AS n FROM events UNION ALL SELECT user_id, event_type, 100 FROM events WHERE event_id < 100) GROUP BY ALL")
def rs_counter(t, spark, sf):
    e = t("events")
    start = e.where("event_id < 100").select("user_id", "event_type", F.lit(100).cast("long").alias("n"))
    return rowstore.counters(e.select("user_id", "event_type", F.lit(1).cast("long").alias("n")), ["user_id", "event_type"], "n", start)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 2")
def rs_position(t, spark, sf):
    """The last but one order of each customer: position -2 of its list."""
    return rowstore.positions(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], -2).drop("o_orderdate")


@query("SELECT k, row_number() OVER (ORDER BY (CASE WHEN n IS NOT NULL THEN 1 ELSE 2 END), n, k) - 1 AS pos FROM (SELECT DISTINCT k, TRY_CAST(k AS BIGINT) AS n FROM (SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation UNION ALL SELECT n_name FROM nation))")
def rs_mixed_order(t, spark, sf):
    """Numbers before strings, each by value."""
    rows = t("nation").select(F.col("n_nationkey").cast("string").alias("k")).union(t("nation").select("n_name")).distinct()
    n = F.col("k").try_cast("bigint")
    keyed = rows.select("k", F.struct(*rowstore.mixed_order(n.alias("n"), F.col("k").alias("s"))).alias("o"))
    return numbered(keyed.select("k", "o.type_rank", "o.n", "o.s"), "type_rank", "pos", ["n", "s"]).select("k", "pos")


_DICTS = "a AS (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer WHERE c_nationkey < 20 GROUP BY 1), b AS (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier WHERE s_nationkey > 5 GROUP BY 1)"


def _dicts(t):
    a = t("customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"))
    return a, t("supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"))


@query(f"WITH {_DICTS} SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.k = b.k")
def dict_merge_keep(t, spark, sf):
    return rowstore.merge(*_dicts(t), "k", "v", replace=False)


@query(f"WITH {_DICTS} SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k")
def dict_merge_replace(t, spark, sf):
    return rowstore.merge(*_dicts(t), "k", "v", replace=True)


@query("WITH d AS (SELECT p_brand AS value, count(*) AS refs FROM part GROUP BY 1), c AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM d) SELECT p_partkey, code FROM part JOIN c ON p_brand = value")
def dict_encode(t, spark, sf):
    parts = t("part").select("p_partkey", "p_brand")
    return dictionary.encode(parts, "p_brand", dictionary.dictionary(parts, "p_brand"))


@query("SELECT p_type AS value, row_number() OVER (ORDER BY p_type) - 1 AS code0, refs FROM (SELECT p_type, count(*) - count(*) FILTER (p_size < 25) AS refs FROM part GROUP BY 1) WHERE refs > 0")
def dict_refcount(t, spark, sf):
    parts = t("part")
    left = dictionary.release(dictionary.dictionary(parts, "p_type"), parts.where("p_size < 25"), "p_type")
    return numbered(left, "value", "code0").select("value", "code0", "refs")


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 10 INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
def key_intersect_bag(t, spark, sf):
    li = t("lineitem")
    return keys.intersect_bag(li.where("l_quantity < 10").select(F.col("l_partkey").alias("k")), li.where("l_discount > 0.05").select(F.col("l_partkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def key_difference(t, spark, sf):
    return keys.difference(t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O') (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a)")
def key_symdiff(t, spark, sf):
    li = t("lineitem")
    return keys.symmetric_difference(li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), li.where("l_linestatus = 'O'").select(F.col("l_partkey").alias("k")))


@query("WITH p AS (SELECT p_partkey FROM part WHERE p_size < 45) SELECT l_suppkey, bool_and(l_partkey IN (SELECT p_partkey FROM p)) AS is_subset FROM lineitem GROUP BY 1")
def set_subset(t, spark, sf):
    return keys.is_subset(t("lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")), t("part").where("p_size < 45"), "l_suppkey", "p_partkey")


@query("WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS g FROM orders GROUP BY 1) SELECT o_custkey, min(o_custkey) OVER (PARTITION BY g) AS same_as FROM s")
def set_equal(t, spark, sf):
    return keys.same_sets(t("orders"), "o_custkey", "o_orderstatus")


_R = "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1"
_V = "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) - 1"


def _accounts(t):
    return t("customer").select("c_nationkey", "c_custkey", "c_acctbal")


@query(f"SELECT c_nationkey, c_custkey, c_acctbal, {_R} AS rank, {_V} AS rev_rank FROM customer")
def sset_rank(t, spark, sf):
    return scored.ranked(_accounts(t), ["c_nationkey"], "c_acctbal", "c_custkey")


@query(f"SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY {_R} = 3 UNION ALL SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY {_V} = 1")
def sset_by_rank(t, spark, sf):
    a = _accounts(t)
    return scored.by_rank(a, ["c_nationkey"], "c_acctbal", "c_custkey", 3).union(scored.by_rank(a, ["c_nationkey"], "c_acctbal", "c_custkey", -2))


@query("SELECT c_nationkey, count(*) FILTER (c_acctbal BETWEEN 0 AND 5000) AS n FROM customer GROUP BY 1")
def sset_count_by_score(t, spark, sf):
    return scored.count_by_score(_accounts(t), ["c_nationkey"], "c_acctbal", 0, 5000)


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 2000")
def sset_range_by_score(t, spark, sf):
    return rowstore.range_scan(_accounts(t), "c_acctbal", 1000, 2000, high_open=True)


@query(f"SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY {_V} >= 5")
def sset_pop_max(t, spark, sf):
    """What is left after the five largest of each set are taken."""
    return scored.pop(_accounts(t), ["c_nationkey"], "c_acctbal", "c_custkey", 5)[1]


@query(f"SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY {_R} < 5")
def sset_pop_min(t, spark, sf):
    return scored.pop(_accounts(t), ["c_nationkey"], "c_acctbal", "c_custkey", 5, largest=False)[0]


@query(f"SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY NOT ({_R} >= 2 AND {_V} >= 2)")
def sset_remove_rank_range(t, spark, sf):
    return scored.remove_ranks(_accounts(t), ["c_nationkey"], "c_acctbal", "c_custkey", 2, -3)


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE NOT c_acctbal BETWEEN -100 AND 3000")
def sset_remove_score_range(t, spark, sf):
    return rowstore.delete(_accounts(t), F.col("c_acctbal").between(-100, 3000))


_U = "WITH u AS (SELECT c_nationkey AS member, 2.0 * min(c_acctbal) AS score FROM customer WHERE c_nationkey < 20 GROUP BY 1 UNION ALL SELECT s_nationkey, 0.5 * max(s_acctbal) FROM supplier WHERE s_nationkey > 3 GROUP BY 1)"


def _sets(t):
    a = t("customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("member")).agg(F.min("c_acctbal").alias("score"))
    return [a, t("supplier").where("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("member")).agg(F.max("s_acctbal").alias("score"))], [2.0, 0.5]


def _rounded(df):
    return df.withColumn("score", F.round("score", 4))


@query(f"{_U} SELECT member, round(sum(score), 4) AS score FROM u GROUP BY 1")
def sset_union_sum(t, spark, sf):
    return _rounded(scored.union(*_sets(t), "member", "score", "sum"))


@query(f"{_U} SELECT member, round(min(score), 4) AS score FROM u GROUP BY 1")
def sset_union_min(t, spark, sf):
    return _rounded(scored.union(*_sets(t), "member", "score", "min"))


@query(f"{_U} SELECT member, round(max(score), 4) AS score FROM u GROUP BY 1")
def sset_union_max(t, spark, sf):
    return _rounded(scored.union(*_sets(t), "member", "score", "max"))


@query(f"{_U} SELECT member, round(sum(score), 4) AS score FROM u GROUP BY 1 HAVING count(*) = 2")
def sset_intersect(t, spark, sf):
    return _rounded(scored.intersect(*_sets(t), "member", "score", "sum"))


@query("SELECT c_nationkey AS member, min(c_acctbal) AS score FROM customer WHERE c_nationkey < 20 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey > 3) GROUP BY 1")
def sset_difference(t, spark, sf):
    (a, b), _ = _sets(t)
    return scored.difference(a, [b], "member")


@query("SELECT c_nationkey, least(5, count(*)) AS n, true AS inside FROM customer GROUP BY 1")
def sset_random_members(t, spark, sf):
    """Distinct random members: their number, and that all are members."""
    a = _accounts(t)
    some = scored.random_members(a, ["c_nationkey"], "c_custkey", 5)
    hit = some.join(a.select("c_custkey", F.lit(True).alias("hit")), "c_custkey", "left")
    return hit.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n"), F.bool_and(F.coalesce("hit", F.lit(False))).alias("inside"))
