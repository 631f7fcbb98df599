"""Queries over bitmaps, prefix sums, series and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitmap, prefix, series, sketch
from .registry import query


def _users(t):
    return t("events").select("event_type", "user_id")


_E = "(SELECT DISTINCT user_id FROM events WHERE event_type = '{}')"
_A, _B, _C = (_E.format(x) for x in ("click", "purchase", "error"))


@query(f"{_A[1:-1]} INTERSECT {_B[1:-1]} INTERSECT {_C[1:-1]}")
def bm_and(t, spark, sf):
    return bitmap.combine(_users(t), "event_type", "user_id", ["click", "purchase", "error"], "and")


@query(f"{_A[1:-1]} UNION {_B[1:-1]} UNION {_C[1:-1]}")
def bm_or(t, spark, sf):
    return bitmap.combine(_users(t), "event_type", "user_id", ["click", "purchase", "error"], "or")


@query(f"SELECT user_id FROM ({_A} UNION ALL {_B} UNION ALL {_C}) GROUP BY 1 HAVING count(*) % 2 = 1")
def bm_xor(t, spark, sf):
    return bitmap.combine(_users(t), "event_type", "user_id", ["click", "purchase", "error"], "xor")


@query(f"{_A[1:-1]} EXCEPT {_B[1:-1]}")
def bm_andnot(t, spark, sf):
    return bitmap.combine(_users(t), "event_type", "user_id", ["click", "purchase"], "andnot")


@query("WITH s AS (SELECT DISTINCT l_orderkey AS pos FROM lineitem WHERE l_quantity > 45), c AS (SELECT DISTINCT pos // 8192 AS c FROM s) SELECT pos FROM (SELECT unnest(range(c * 8192, c * 8192 + 8192)) AS pos FROM c) EXCEPT SELECT pos FROM s")
def bm_not_chunks(t, spark, sf):
    return bitmap.complement(t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("pos")).distinct(), "pos")


@query("SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS rank FROM (SELECT DISTINCT l_orderkey AS pos FROM lineitem)")
def bm_rank(t, spark, sf):
    return bitmap.ranks(t("lineitem").select(F.col("l_orderkey").alias("pos")), "pos")


@query("SELECT k, pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS k FROM (SELECT DISTINCT l_orderkey AS pos FROM lineitem)) WHERE k IN (1, 10, 100, 1000)")
def bm_select(t, spark, sf):
    return bitmap.select_kth(t("lineitem").select(F.col("l_orderkey").alias("pos")), "pos", [0, 1, 10, 100, 1000, 10**12])


@query("SELECT event_type, count(DISTINCT user_id) FILTER (user_id BETWEEN 10 AND 60) AS n FROM events GROUP BY 1")
def bm_range_count(t, spark, sf):
    return bitmap.range_count(t("events"), "event_type", "user_id", 10, 60)


@query("SELECT p_size::BIGINT AS pos FROM part WHERE p_size < 10 UNION SELECT * FROM range(5, 21)")
def bm_set_range(t, spark, sf):
    return bitmap.set_range(t("part").where("p_size < 10").select(F.col("p_size").alias("pos")), "pos", 5, 20)


@query("SELECT DISTINCT p_size AS pos FROM part WHERE NOT p_size BETWEEN 5 AND 20")
def bm_clear_range(t, spark, sf):
    return bitmap.clear_range(t("part").select(F.col("p_size").alias("pos")), "pos", 5, 20)


@query("SELECT pos FROM (SELECT DISTINCT p_size::BIGINT AS pos FROM part WHERE p_size % 3 = 0 UNION ALL SELECT * FROM range(5, 21)) GROUP BY 1 HAVING count(*) = 1")
def bm_flip_range(t, spark, sf):
    return bitmap.flip_range(t("part").where("p_size % 3 = 0").select(F.col("p_size").alias("pos")), "pos", 5, 20)


@query("""WITH d AS (SELECT DISTINCT event_type AS g, user_id FROM events), s AS (SELECT g, count(*) AS n FROM d GROUP BY 1),
    p AS (SELECT x.g AS a, y.g AS b, count(*) AS c FROM d x JOIN d y USING (user_id) WHERE x.g < y.g GROUP BY ALL)
    SELECT x.g AS a, y.g AS b, round(coalesce(c, 0) / (x.n + y.n - coalesce(c, 0)), 6) AS jaccard, round(2 * coalesce(c, 0) / (x.n + y.n), 6) AS dice,
    round(coalesce(c, 0) / least(x.n, y.n), 6) AS overlap, x.n + y.n - 2 * coalesce(c, 0) AS hamming FROM s x JOIN s y ON x.g < y.g LEFT JOIN p ON p.a = x.g AND p.b = y.g""")
def bm_similarity(t, spark, sf):
    return bitmap.similarity(_users(t), "event_type", "user_id")


@query("SELECT count(DISTINCT l_orderkey) AS n FROM lineitem")
def bm_packed_count(t, spark, sf):
    return bitmap.packed_count(t("lineitem"), "l_orderkey")


_DAYS = "d AS (SELECT date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS idx, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY 1)"


def _days(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    day = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long")
    return t("orders").groupBy(day.alias("idx")).agg(F.sum(cents).alias("v"))


@query(f"WITH {_DAYS} SELECT idx, v, CAST(sum(v) OVER (ORDER BY idx) AS BIGINT) AS prefix FROM d")
def px_prefix(t, spark, sf):
    return prefix.prefix_sums(_days(t), "idx", "v", block=64)


_RANGES = "r AS (SELECT * FROM (VALUES (1, 0, 100), (2, 365, 730), (3, 50, 40), (4, 100000, 200000)) AS r(q, lo, hi))"


def _ranges(spark):
    return spark.createDataFrame([(1, 0, 100), (2, 365, 730), (3, 50, 40), (4, 100000, 200000)], "q int, lo int, hi int")


@query(f"WITH {_DAYS}, {_RANGES} SELECT q, lo, hi, CAST(coalesce(sum(v), 0) AS BIGINT) AS result FROM r LEFT JOIN d ON idx BETWEEN lo AND hi GROUP BY ALL")
def px_range(t, spark, sf):
    return prefix.range_aggregate(_days(t), _ranges(spark), "idx", "v", "sum")


@query(f"WITH {_DAYS}, {_RANGES} SELECT q, lo, hi, min(v) AS result FROM r LEFT JOIN d ON idx BETWEEN lo AND hi GROUP BY ALL")
def px_range_min(t, spark, sf):
    return prefix.range_aggregate(_days(t), _ranges(spark), "idx", "v", "min")


@query(f"WITH {_DAYS}, {_RANGES} SELECT q, lo, hi, max(v) AS result FROM r LEFT JOIN d ON idx BETWEEN lo AND hi GROUP BY ALL")
def px_range_max(t, spark, sf):
    return prefix.range_aggregate(_days(t), _ranges(spark), "idx", "v", "max")


@query(f"WITH {_DAYS}, p AS (SELECT idx, sum(v) OVER (ORDER BY idx) AS s FROM d) SELECT target, min(idx) AS idx FROM p, (SELECT unnest([1, 1000000000, 50000000000]) AS target) WHERE s >= target GROUP BY 1")
def px_lower_bound(t, spark, sf):
    return prefix.lower_bound(_days(t), [1, 10**9, 5 * 10**10, 10**17], "idx", "v")


@query(f"WITH {_DAYS} SELECT idx, v, CAST(sum(v) OVER w AS BIGINT) AS w_sum, min(v) OVER w AS w_min, max(v) OVER w AS w_max FROM d WINDOW w AS (ORDER BY idx ROWS 6 PRECEDING)")
def px_sliding(t, spark, sf):
    return prefix.sliding(_days(t), "idx", "v", 6)


@query(f"WITH {_DAYS} SELECT idx, CASE WHEN idx BETWEEN 100 AND 400 THEN 7 ELSE v END AS v FROM d")
def px_range_update(t, spark, sf):
    return prefix.range_assign(_days(t), "idx", "v", 100, 400, 7)


@query(f"WITH {_DAYS} SELECT idx, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM d UNION ALL SELECT * FROM (VALUES (3, 5), (4, -6), (999999, 1))) GROUP BY 1")
def px_point_update(t, spark, sf):
    return prefix.point_add(_days(t), spark.createDataFrame([(3, 5), (4, -6), (999999, 1)], "idx long, v long"), "idx", "v")


@query("SELECT o_custkey, CAST(product(1 + o_orderkey % 3) AS BIGINT) AS p FROM orders GROUP BY 1")
def agg_product(t, spark, sf):
    """Products of small integers, exact in 64 bits."""
    return series.products(t("orders").select("o_custkey", (1 + F.col("o_orderkey") % 3).cast("long").alias("f")), "o_custkey", "f").withColumnRenamed("product", "p")


@query("SELECT user_id, count(*) FILTER (value < 50) AS low, count(*) FILTER (value >= 50) AS high, count(DISTINCT event_type) AS kinds, round(sum(-value), 3) AS negated FROM events GROUP BY 1")
def agg_folds(t, spark, sf):
    return t("events").groupBy("user_id").agg(F.count_if(F.col("value") < 50).alias("low"), F.count_if(F.col("value") >= 50).alias("high"), F.count_distinct("event_type").alias("kinds"), F.round(F.sum(-F.col("value")), 3).alias("negated"))


_M = "count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(var_pop(value) * count(value), 3) AS m2, round(var_pop(value), 5) AS var_pop, round(stddev_pop(value), 5) AS stddev_pop"


@query(f"SELECT event_type, {_M} FROM events GROUP BY 1")
def agg_m2_stats(t, spark, sf):
    return series.moments(t("events"), ["event_type"], "value")


_TS = "s AS (SELECT user_id, event_id, epoch_us(ts) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events), e AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY seq) AS d FROM s), f AS (SELECT *, CASE WHEN seq = 0 THEN v WHEN seq = 1 THEN d ELSE d - lag(d) OVER (PARTITION BY user_id ORDER BY seq) END AS dd FROM e)"


def _series(t):
    return t("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("v"))


@query(f"WITH {_TS} SELECT user_id, event_id, seq, dd FROM f")
def ts_dod_encode(t, spark, sf):
    return series.dod_encode(_series(t), ["user_id"], ["v", "event_id"], "v").drop("v")


@query("SELECT user_id, event_id, epoch_us(ts) AS v FROM events")
def ts_dod_roundtrip(t, spark, sf):
    coded = series.dod_encode(_series(t), ["user_id"], ["v", "event_id"], "v").select("user_id", "event_id", "seq", "dd")
    return series.dod_decode(coded, ["user_id"], "v").select("user_id", "event_id", "v")


@query(f"WITH {_TS} SELECT user_id, CAST(sum(CASE WHEN seq < 2 THEN 64 WHEN dd = 0 THEN 1 WHEN dd BETWEEN -63 AND 64 THEN 9 WHEN dd BETWEEN -255 AND 256 THEN 12 WHEN dd BETWEEN -2047 AND 2048 THEN 16 WHEN dd BETWEEN -8191 AND 8192 THEN 19 WHEN dd BETWEEN -524287 AND 524288 THEN 26 WHEN dd BETWEEN -2147483647 AND 2147483648 THEN 39 WHEN dd BETWEEN -140737488355327 AND 140737488355328 THEN 56 ELSE 72 END) AS BIGINT) AS bits FROM f GROUP BY 1")
def ts_dod_bits(t, spark, sf):
    coded = series.dod_encode(_series(t), ["user_id"], ["v", "event_id"], "v")
    return coded.groupBy("user_id").agg(F.sum(F.when(F.col("seq") < 2, F.lit(64)).otherwise(series.dod_size(F.col("dd")))).alias("bits"))


@query("SELECT user_id, event_id, value FROM events")
def ts_xor_roundtrip(t, spark, sf):
    return series.xor_decode(series.xor_encode(t("events"), ["user_id"], ["event_id"], "value"), ["user_id"], ["event_id"])


@query()
def ts_xor_bits(t, spark, sf):
    return series.xor_encode(t("events"), ["user_id"], ["event_id"], "value").groupBy("user_id").agg(F.sum("bits").alias("bits"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id, {_M} FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) BETWEEN 3 AND 22) GROUP BY 1")
def ts_slice_stats(t, spark, sf):
    return series.slice_stats(t("events"), ["user_id"], ["ts", "event_id"], "value", 2, 22)


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def ts_last_n(t, spark, sf):
    return series.last_n(t("events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "value")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def ts_bucket(t, spark, sf):
    return series.buckets(t("events"), "ts", "1 hour", ["event_type"], "value")


@query("SELECT event_type, count(DISTINCT user_id) AS exact, true AS within FROM events GROUP BY 1")
def hll_distinct(t, spark, sf):
    """Sketched distinct users, reported as: exact number, and whether the estimate is within six standard errors."""
    e = t("events")
    got = sketch.estimate(sketch.distinct_sketch(e, ["event_type"], "user_id"))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return exact.join(got, "event_type").select("event_type", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), 6 * 1.04 / 128 * F.col("exact"))).alias("within"))


@query("SELECT count(DISTINCT l_partkey) AS exact, true AS within FROM lineitem")
def hll_union(t, spark, sf):
    """Sketches of parts by ship mode of return, merged."""
    li = t("lineitem")
    got = sketch.estimate(sketch.merge_sketches(sketch.distinct_sketch(li, ["l_returnflag", "l_linestatus"], "l_partkey"), []))  # one row
    exact = li.agg(F.count_distinct("l_partkey").alias("exact"))
    return exact.select("exact", (F.abs(got.scalar() - F.col("exact")) <= 6 * 1.04 / 128 * F.col("exact")).alias("within"))


@query("SELECT count(*) AS members, true AS none_lost, true AS few_false FROM customer WHERE c_custkey % 2 = 0")
def bloom_membership(t, spark, sf):
    """Even customers are added; all must be found, and at most 1 % of the odd ones."""
    c = t("customer").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("member"))
    bits = sketch.bloom_bits(c.where("member"), "c_custkey")
    got = sketch.bloom_contains(c, "c_custkey", sketch.bloom(c.where("member"), "c_custkey", bits), bits)
    return got.agg(F.count_if("member").alias("members"), F.bool_and(~F.col("member") | F.col("maybe")).alias("none_lost"), (F.count_if(~F.col("member") & F.col("maybe")) <= 0.01 * F.count_if(~F.col("member"))).alias("few_false"))


@query("SELECT count(DISTINCT l_suppkey) AS keys, true AS never_less, true AS near FROM lineitem")
def cms_counts(t, spark, sf):
    li = t("lineitem")
    width = sketch.count_min_width(li, "l_suppkey")
    est = sketch.count_min_estimate(li, "l_suppkey", sketch.count_min(li, "l_suppkey", width), width)
    exact = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    both = exact.join(est, "l_suppkey")
    return both.agg(F.count(F.lit(1)).alias("keys"), F.bool_and(F.col("estimate") >= F.col("n")).alias("never_less"), (F.sum(F.col("estimate") - F.col("n")) <= 0.01 * F.sum("n")).alias("near"))


@query("WITH c AS (SELECT user_id, least(count(*), 7) AS n, max(epoch_us(ts)) AS m FROM events GROUP BY 1) SELECT user_id, n, CAST(floor(n * pow(0.5, (1800000000000000 - m) / 43200000000000.0)) AS BIGINT) AS decayed FROM c")
def cbf_decay(t, spark, sf):
    return sketch.decayed(_series(t), ["user_id"], "v", 1_800_000_000_000_000, 43_200_000_000_000)
