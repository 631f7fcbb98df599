"""More queries over bitmaps, matrices, arrays with prefix sums, and counting filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitmap, prefix, sketch
from .registry import query


def _bits(t):
    return t("events").select("event_type", F.col("user_id").alias("pos"))


@query("SELECT event_type, min(user_id) AS low, max(user_id) AS high FROM events GROUP BY 1")
def bm_first_last(t, spark, sf):
    return bitmap.first_last(_bits(t), "event_type", "pos")


@query("SELECT count(*) > 0 AS intersects FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')")
def bm_intersects(t, spark, sf):
    return bitmap.intersects(_bits(t), "event_type", "pos", "click", "error")


@query("SELECT c_custkey AS pos, c_custkey IN (SELECT o_custkey FROM orders) AS bit FROM customer")
def bm_get(t, spark, sf):
    return bitmap.get_bits(t("orders").select(F.col("o_custkey").alias("pos")), t("customer").select(F.col("c_custkey").alias("pos")), "pos")


@query("SELECT DISTINCT o_custkey AS pos FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) UNION SELECT c_custkey FROM customer WHERE c_custkey % 8 = 0")
def bm_set(t, spark, sf):
    """Single bits set and cleared."""
    changes = t("customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 8 == 0).alias("bit"))
    return bitmap.set_bits(t("orders").select(F.col("o_custkey").alias("pos")), changes, "pos")


@query("SELECT DISTINCT o_custkey AS pos FROM orders ORDER BY 1 LIMIT 20")
def bm_first_n(t, spark, sf):
    return bitmap.first_n(t("orders").select(F.col("o_custkey").alias("pos")), "pos", 20)


@query("SELECT DISTINCT l_linestatus AS g, l_orderkey AS pos FROM lineitem")
def bm_pack_roundtrip(t, spark, sf):
    """Positions to packed bitmaps and back."""
    rows = t("lineitem").select(F.col("l_linestatus").alias("g"), F.col("l_orderkey").alias("pos"))
    return bitmap.unpack(bitmap.pack(rows, "g", "pos"), "g", "pos")


@query("SELECT c_nationkey AS r, c_custkey % 16 AS c, CAST(bit_or(c_custkey) & 7 AS BIGINT) AS v, c_nationkey * 16 + c_custkey % 16 AS pos FROM customer GROUP BY ALL HAVING v <> 0")
def bm_matrix(t, spark, sf):
    """A sparse matrix of 3-bit values with row-major positions."""
    cells = t("customer").groupBy(F.col("c_nationkey").alias("r"), (F.col("c_custkey") % 16).alias("c")).agg(F.bit_or("c_custkey").alias("v"))
    return bitmap.matrix_positions(bitmap.matrix(cells, "r", "c", "v", 3), "r", "c", 16)


_V = "v AS (SELECT o_custkey AS idx, count(*) AS v FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1)"


def _values(t):
    return t("orders").where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("idx")).agg(F.count(F.lit(1)).alias("v"))


@query(f"WITH {_V}, e AS (SELECT unnest(range((SELECT min(idx) FROM v), (SELECT max(idx) + 1 FROM v))) AS idx) SELECT e.idx, coalesce(v, 0) AS v FROM e LEFT JOIN v ON e.idx = v.idx")
def px_filled(t, spark, sf):
    """A dense array over all indexes between the ends."""
    return prefix.filled(_values(t), "idx", "v")


@query(f"WITH {_V}, n AS (SELECT idx, CASE WHEN idx % 2 = 0 THEN 50 ELSE v END AS v FROM v UNION ALL SELECT max(idx) + 10, 9 FROM v), e AS (SELECT unnest(range((SELECT min(idx) FROM n), (SELECT max(idx) + 1 FROM n))) AS idx) SELECT e.idx, coalesce(v, 0) AS v FROM e LEFT JOIN n ON e.idx = n.idx")
def px_assign(t, spark, sf):
    """Values replaced, and one put beyond the end, which zeros fill up to."""
    v = _values(t)
    new = v.where("idx % 2 = 0").select("idx", F.lit(50).cast("long").alias("v")).union(v.agg((F.max("idx") + 10).alias("idx")).select("idx", F.lit(9).cast("long").alias("v")))
    return prefix.assign(v, new, "idx", "v")


@query(f"WITH {_V} SELECT idx, 0::BIGINT AS v, count(*) OVER () AS n FROM v")
def px_cleared(t, spark, sf):
    v = _values(t)
    return prefix.cleared(v, "v").crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).alias("n"))))


@query(f"WITH {_V}, s AS (SELECT idx, CAST(sum(v) OVER (ORDER BY idx) AS BIGINT) AS prefix FROM v) SELECT a.idx, coalesce(prefix, 0) AS prefix FROM (SELECT idx FROM v WHERE idx % 5 = 0 UNION ALL SELECT -7 UNION ALL SELECT 1000000000) a LEFT JOIN s ON a.idx = s.idx")
def px_query_points(t, spark, sf):
    """Prefix sums at given indexes, 0 outside the array."""
    v = _values(t)
    asked = v.where("idx % 5 = 0").select("idx").union(spark.createDataFrame([(-7,), (10**9,)], "idx long"))
    return prefix.query_points(prefix.prefix_sums(v, "idx", "v", block=256), asked, "idx")


_P = "SELECT user_id AS g, event_id AS idx, CASE WHEN user_id % 2 = 0 OR event_id % 3 > 0 THEN event_id END AS w, CASE WHEN user_id % 2 = 1 AND event_id % 3 = 0 THEN event_id / 2.0 END AS r FROM events"


@query(f"WITH p AS ({_P}) SELECT g, idx, CASE WHEN count(r) OVER (PARTITION BY g) = 0 THEN CAST(sum(w) OVER s AS BIGINT) END AS prefix_whole, CASE WHEN count(r) OVER (PARTITION BY g) > 0 THEN round(sum(coalesce(r, w)) OVER s, 3) END AS prefix_real FROM p WINDOW s AS (PARTITION BY g ORDER BY idx)")
def px_promoted(t, spark, sf):
    """Prefix sums of mixed values: groups with a real value become doubles."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = t("events").select(u.alias("g"), e.alias("idx"), F.when((u % 2 == 0) | (e % 3 > 0), e).alias("w"), F.when((u % 2 == 1) & (e % 3 == 0), e / 2.0).alias("r"))
    return prefix.promoted_sums(rows, "idx", "w", "r", ["g"]).select("g", "idx", "prefix_whole", F.round("prefix_real", 3).alias("prefix_real"))


@query("SELECT count(*) AS keys, true AS never_below, true AS mostly_exact, CAST(sum(n // 2) AS BIGINT) AS halves, CAST(sum(n // 4) AS BIGINT) AS quarters FROM (SELECT least(count(*), 7) AS n FROM lineitem GROUP BY l_partkey)")
def cbf_filter(t, spark, sf):
    """A counting filter never estimates below the capped count, and rarely above; halves and quarters of the counts of its keys follow its cells."""
    rows = t("lineitem").select("l_partkey")
    filled = sketch.counting_filter(rows, "l_partkey", 1 << 26)
    named = lambda f, name: sketch.counting_estimate(rows, "l_partkey", f, 1 << 26).withColumnRenamed("estimate", name)
    counts = rows.groupBy("l_partkey").agg(F.least(F.count(F.lit(1)), F.lit(sketch.CELL_MOST)).alias("n"))
    every = counts.join(named(filled, "e"), "l_partkey").join(named(sketch.halved(filled), "half"), "l_partkey").join(named(sketch.halved(filled, 2), "quarter"), "l_partkey")
    exact = F.col("e") == F.col("n")
    return every.agg(
        F.count(F.lit(1)).alias("keys"), F.bool_and(F.col("e") >= F.col("n")).alias("never_below"), (F.avg(exact.cast("int")) > 0.99).alias("mostly_exact"),
        F.sum(F.when(exact, F.col("half")).otherwise(F.shiftright("n", 1))).alias("halves"), F.sum(F.when(exact, F.col("quarter")).otherwise(F.shiftright("n", 2))).alias("quarters"),
    )


@query("SELECT user_id AS cell, least(count(*), 7)::INTEGER AS n, CAST(floor(least(count(*), 7) * 0.6) AS INTEGER) AS by_factor, true AS rounded, NULL::INTEGER AS emptied FROM events GROUP BY 1")
def cbf_decay_factor(t, spark, sf):
    """Cells times 0.6, rounded down and rounded at random, and times 1/8, on cells that hold one key each."""
    cells = t("events").groupBy(F.col("user_id").alias("cell")).agg(F.least(F.count(F.lit(1)), F.lit(7)).cast("int").alias("n"))
    down, chance, none = sketch.decayed_by(cells, 0.6), sketch.decayed_by(cells, 0.6, seed=5), sketch.decayed_by(cells, 0.125)
    named = lambda df, name: df.select("cell", F.col("n").alias(name))
    every = cells.join(named(down, "d"), "cell", "left").join(named(chance, "c"), "cell", "left").join(named(none, "emptied"), "cell", "left")
    d, c = F.coalesce("d", F.lit(0)), F.coalesce("c", F.lit(0))
    return every.select("cell", "n", d.alias("by_factor"), ((c == d) | (c == d + 1)).alias("rounded"), "emptied")
