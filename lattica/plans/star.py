"""Relational queries around the containers: outer joins, cubes, as-of and range joins, a pricing summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keys
from .registry import query


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def sem_full_join(t, spark, sf):
    o = t("orders").where("o_totalprice > 300000").select("o_custkey", "o_orderkey")
    return t("customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "full").drop("o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def sem_semi_join(t, spark, sf):
    o = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def sem_cube(t, spark, sf):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def sem_rollup(t, spark, sf):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def sem_grouping_sets(t, spark, sf):
    o = t("orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p.user_id, p.ts, p.event_id, (SELECT arg_max(v.value, struct_pack(a := v.ts, b := v.value)) FROM (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v WHERE v.user_id = p.user_id AND v.ts <= p.ts) AS asof_value FROM events p WHERE p.event_type = 'purchase'")
def sem_asof(t, spark, sf):
    """Each purchase with the user's last view at or before it."""
    e = t("events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return keys.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, "user_id", "ts", "value")


@query("SELECT p_partkey, r.k FROM part JOIN (SELECT n_nationkey AS k, 900 + 40 * n_nationkey AS low, 960 + 40 * n_nationkey AS high FROM nation) r ON p_retailprice BETWEEN low AND high")
def sem_range_join(t, spark, sf):
    r = t("nation").select(F.col("n_nationkey").alias("k"), (900 + 40 * F.col("n_nationkey")).alias("low"), (960 + 40 * F.col("n_nationkey")).alias("high"))
    return keys.range_join(t("part").select("p_partkey", "p_retailprice"), r, "p_retailprice", "low", "high", 64).select("p_partkey", "k")


@query("SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS change FROM orders")
def sem_lag(t, spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("change"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def star_pricing(t, spark, sf):
    li = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_revenue(t, spark, sf):
    small = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = t("customer").select("c_custkey", "c_nationkey").join(small, F.col("c_nationkey") == F.col("n_nationkey"))
    o = t("orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name", "r_name")
    li = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("net"), 2).alias("revenue"))
