"""Queries over changes of arrays, lists, scored sets and row stores, and over their cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays, dictionary, lists, rowstore, scored
from .registry import query

#: The items of an order as a small array, in both engines.
_A = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1"
_S = "SELECT l_orderkey, list_sort(list(l_partkey)) AS a FROM lineitem GROUP BY 1"


def _text(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def _array(t, ordered: bool = False):
    """Orders have few lines each."""
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    got = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("a") if ordered else F.transform(items, lambda x: x["l_partkey"]).alias("a"))
    return got, F.col("a")


@query(f"SELECT l_orderkey, array_to_string([-2, -1] || a || [7, 8], ',') AS pushed FROM ({_A})")
def arr_push(t, spark, sf):
    """Two items at the tail and two at the head, one after the other."""
    rows, a = _array(t)
    return rows.select("l_orderkey", _text(arrays.push_head(arrays.push_tail(a, F.lit(7), F.lit(8)), F.lit(-1), F.lit(-2))).alias("pushed"))


@query(f"SELECT l_orderkey, array_to_string(a[:2] || CASE WHEN len(a) >= 2 THEN [-5, -6] ELSE [] END || a[3:], ',') AS made, array_to_string(a[:-2] || [-7] || a[-1:], ',') AS before_last FROM ({_A})")
def arr_insert(t, spark, sf):
    rows, a = _array(t)
    return rows.select("l_orderkey", _text(arrays.insert(a, 2, F.lit(-5), F.lit(-6))).alias("made"), _text(arrays.insert(a, -1, F.lit(-7))).alias("before_last"))


@query(f"SELECT l_orderkey, array_to_string(list_sort(a || [100]), ',') AS made, len(list_filter(a, lambda x: x < 100)) AS place FROM ({_S})")
def arr_insert_sorted(t, spark, sf):
    rows, a = _array(t, ordered=True)
    hundred = F.lit(100).cast("bigint")
    return rows.select("l_orderkey", _text(arrays.insert_sorted(a, hundred)).alias("made"), arrays.first_at_or_after(a, hundred).cast("long").alias("place"))


@query(f"SELECT l_orderkey, array_to_string(CASE WHEN len(a) > 1 THEN a[:1] || [0] || a[3:] ELSE a END, ',') AS replaced, array_to_string(a[:-2] || [a[-1] + 10], ',') AS raised FROM ({_A})")
def arr_replace(t, spark, sf):
    """The second item replaced; the last raised by ten."""
    rows, a = _array(t)
    return rows.select("l_orderkey", _text(arrays.replace(a, 1, 0)).alias("replaced"), _text(arrays.increment(a, -1, 10)).alias("raised"))


@query(f"SELECT l_orderkey, array_to_string(a[:1] || a[4:], ',') AS middle, array_to_string(a[3:], ',') AS head, array_to_string(a[:-3], ',') AS tail, len(a[:2]) AS left_n, len(a[3:]) AS right_n FROM ({_A})")
def arr_delete_range(t, spark, sf):
    """Without two items from the second on; without the first two; without the last two; cut in two."""
    rows, a = _array(t)
    left, right = arrays.split(a, 2)
    return rows.select("l_orderkey", _text(arrays.delete(a, 1, 2)).alias("middle"), _text(arrays.delete_head(a, 2)).alias("head"), _text(arrays.delete_tail(a, 2)).alias("tail"), F.size(left).cast("long").alias("left_n"), F.size(right).cast("long").alias("right_n"))


@query(f"SELECT l_orderkey, a[2] AS second, a[-1] AS last, CAST(list_position(a, a[-1]) - 1 AS BIGINT) AS first_of_last, len(a) - list_position(list_reverse(a), a[1]) AS last_of_first, CASE WHEN list_position(list_filter(a, lambda x, i: i % 2 = 1), a[3]) > 0 THEN CAST(2 * (list_position(list_filter(a, lambda x, i: i % 2 = 1), a[3]) - 1) AS BIGINT) END AS among_even FROM ({_A})")
def arr_find(t, spark, sf):
    """Items by position, and positions of items: from the front, from the back, and among every second item only."""
    rows, a = _array(t)
    last, first, third = arrays.get(a, -1), arrays.get(a, 0), arrays.get(a, 2)
    return rows.select("l_orderkey", arrays.get(a, 1).alias("second"), last.alias("last"), arrays.find(a, last).cast("long").alias("first_of_last"), arrays.find_last(a, first).cast("long").alias("last_of_first"), arrays.find(a, third, skip=1).cast("long").alias("among_even"))


@query(f"WITH s AS ({_S}), o AS (SELECT o_orderkey, o_custkey FROM orders) SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x IN (1, 5, 9, 20, 50, 100)))), ',') AS both_, array_to_string(list_sort(a || [5, 5]), ',') AS merged FROM s")
def arr_sorted_sets(t, spark, sf):
    """Intersection with a fixed sorted array, and a merge that keeps repeats."""
    rows, a = _array(t, ordered=True)
    fixed = lambda *v: F.array(*[F.lit(x).cast("bigint") for x in v])
    return rows.select("l_orderkey", _text(arrays.intersect_sorted(a, fixed(1, 5, 9, 20, 50, 100))).alias("both_"), _text(arrays.merge_sorted(a, fixed(5, 5))).alias("merged"))


@query("WITH s AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey} ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(a[2:], lambda x: x.n || ':' || x.p), ',') AS rest, a[1].p AS first_part FROM s")
def arr_structs(t, spark, sf):
    """An array of structs: a field of the first item, and the others after it is deleted."""
    rows = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")))).alias("a"))
    rest = F.transform(arrays.delete(F.col("a"), 0), lambda x: F.concat_ws(":", x["n"].cast("string"), x["p"].cast("string")))
    return rows.select("l_orderkey", F.array_join(rest, ",").alias("rest"), arrays.get(F.col("a"), 0)["p"].alias("first_part"))


_L = "l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_id AS value FROM events)"


def _list(t):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return t("events").select("user_id", place.cast("long").alias("pos"), F.col("event_id").alias("value"))


def _new(t):
    """Two items for each customer number, which may be a user or not."""
    c = t("customer").select(F.col("c_custkey").cast("bigint").alias("user_id"))
    return c.select("user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("o")).withColumn("value", -F.col("user_id") * 10 - F.col("o"))


_NEW = "n AS (SELECT c_custkey AS user_id, o, -c_custkey * 10 - o AS value FROM customer, (VALUES (1), (2)) AS x(o))"


@query(f"WITH {_L}, {_NEW} SELECT user_id, pos, value FROM l UNION ALL SELECT user_id, coalesce((SELECT max(pos) + 1 FROM l WHERE l.user_id = n.user_id), 0) + o - 1, value FROM n")
def list_push_tail(t, spark, sf):
    return lists.push_tail(_list(t), _new(t), "user_id", "o")


@query(f"WITH {_L}, {_NEW} SELECT user_id, pos + CASE WHEN user_id IN (SELECT user_id FROM n) THEN 2 ELSE 0 END AS pos, value FROM l UNION ALL SELECT user_id, 2 - o, value FROM n")
def list_push_head(t, spark, sf):
    return lists.push_head(_list(t), _new(t), "user_id", "o")


@query(f"WITH {_L}, {_NEW} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY p, is_old, o) - 1 AS pos, value FROM (SELECT user_id, pos AS p, 1 AS is_old, 0 AS o, value FROM l UNION ALL SELECT user_id, 3, 0, o, value FROM n)")
def list_insert(t, spark, sf):
    """Items before position 3."""
    return lists.insert(_list(t), _new(t).withColumn("at", F.lit(3)), "user_id", "at", "o")


@query(f"WITH {_L} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS pos, value FROM l WHERE pos % 3 <> 1")
def list_delete(t, spark, sf):
    rows = _list(t)
    return lists.delete(rows, rows.where("pos % 3 = 1"), "user_id")


@query(f"WITH {_L} SELECT user_id, pos, CASE WHEN pos IN (0, 2) THEN -user_id ELSE value END AS value FROM l")
def list_replace(t, spark, sf):
    rows = _list(t)
    new = rows.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 2, 10**9)])).alias("pos"), (-F.col("user_id")).alias("value"))
    return lists.replace(rows, new, "user_id")


@query(f"WITH {_L}, s AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM l) SELECT 'head' AS what, user_id, pos, value FROM s WHERE pos < 2 UNION ALL SELECT 'tail', user_id, pos, value FROM s WHERE pos >= n - 1 UNION ALL SELECT 'rest', user_id, pos - 2, value FROM s WHERE pos >= 2")
def list_pop(t, spark, sf):
    """Two items from the head, what that leaves, and one from the tail."""
    rows = _list(t)
    (head, rest), (tail, _) = lists.pop(rows, "user_id", 2), lists.pop(rows, "user_id", 1, tail=True)
    named = lambda df, what: df.select(F.lit(what).alias("what"), "user_id", "pos", "value")
    return named(head, "head").union(named(tail, "tail")).union(named(rest, "rest"))


@query(f"WITH {_L} SELECT user_id, (pos + 1) % count(*) OVER (PARTITION BY user_id) AS pos, value FROM l")
def list_rotate(t, spark, sf):
    return lists.rotate(_list(t), "user_id")


_OLD = "a AS (SELECT c_nationkey AS g, c_custkey AS member, c_custkey * 3 AS score FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_nationkey AS g, c_custkey AS member, c_custkey * 7 + 1 AS score FROM customer WHERE c_custkey % 2 = 0)"
_BOTH = "coalesce(a.g, b.g) AS g, coalesce(a.member, b.member) AS member"


def _scored(t):
    c = t("customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("member"))
    return c.where("member % 3 != 0").withColumn("score", F.col("member") * 3), c.where("member % 2 = 0").withColumn("score", F.col("member") * 7 + 1)


@query(f"WITH {_OLD} SELECT {_BOTH}, coalesce(b.score, a.score) AS score FROM a FULL JOIN b ON a.g = b.g AND a.member = b.member")
def sset_add(t, spark, sf):
    return scored.add(*_scored(t), ["g"], "score", "member")


@query(f"WITH {_OLD} SELECT {_BOTH}, coalesce(a.score, b.score) AS score FROM a FULL JOIN b ON a.g = b.g AND a.member = b.member")
def sset_add_nx(t, spark, sf):
    return scored.add(*_scored(t), ["g"], "score", "member", "nx")


@query(f"WITH {_OLD} SELECT a.g, a.member, coalesce(b.score, a.score) AS score FROM a LEFT JOIN b ON a.g = b.g AND a.member = b.member")
def sset_add_xx(t, spark, sf):
    return scored.add(*_scored(t), ["g"], "score", "member", "xx")


@query(f"WITH {_OLD} SELECT {_BOTH}, coalesce(a.score, 0) + coalesce(b.score, 0) AS score FROM a FULL JOIN b ON a.g = b.g AND a.member = b.member")
def sset_incr(t, spark, sf):
    return scored.add(*_scored(t), ["g"], "score", "member", "incr")


@query(f"WITH {_OLD} SELECT true AS removed, * FROM a WHERE member IN (SELECT member FROM b) UNION ALL SELECT false, * FROM a WHERE member NOT IN (SELECT member FROM b)")
def sset_remove(t, spark, sf):
    """Removed members come back with their scores."""
    gone, left = scored.remove(*_scored(t), ["g"], "member")
    return gone.select(F.lit(True).alias("removed"), "g", "member", "score").union(left.select(F.lit(False), "g", "member", "score"))


@query(f"WITH {_OLD} SELECT b.g, b.member, a.score, a.score IS NOT NULL AS present FROM b LEFT JOIN a ON a.g = b.g AND a.member = b.member")
def sset_scores(t, spark, sf):
    a, b = _scored(t)
    return scored.scores(a, b, ["g"], "score", "member").withColumn("present", F.col("score").isNotNull())


@query(f"WITH {_OLD} SELECT 'up' AS way, g, member, score, row_number() OVER (PARTITION BY g ORDER BY score, member) AS place FROM a WHERE score >= 100 QUALIFY place <= 3 UNION ALL SELECT 'down', g, member, score, row_number() OVER (PARTITION BY g ORDER BY score DESC, member DESC) AS place FROM a WHERE score <= 100 QUALIFY place <= 3")
def sset_scan_from(t, spark, sf):
    """Three rows of each set from score 100 on, upwards and downwards."""
    a, _ = _scored(t)
    up, down = (scored.scan_from(a, ["g"], "score", "member", 100, 3, forward) for forward in (True, False))
    return up.select(F.lit("up").alias("way"), "g", "member", "score", "place").union(down.select(F.lit("down"), "g", "member", "score", "place"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def rs_scan_pages(t, spark, sf):
    """A scan in four pages, resumed by cursor: every row once."""
    from functools import reduce

    rows = t("orders").select("o_orderkey", "o_totalprice")
    return reduce(lambda a, b: a.union(b), [rowstore.page(rows, "o_orderkey", k, 4) for k in range(4)])


@query("SELECT o_orderkey // 1000 AS chunk, count(*) AS n, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY 1")
def rs_dump(t, spark, sf):
    got = rowstore.dump(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 1000)
    return got.select("chunk", F.size("rows").cast("long").alias("n"), _text(F.transform("rows", lambda r: r["o_orderkey"])).alias("keys"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def rs_point_update(t, spark, sf):
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    return rowstore.update(rows, "o_orderkey", rows.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")), "o_orderstatus")


@query("SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AS taken, o_orderkey, o_custkey FROM orders")
def rs_get_and_delete(t, spark, sf):
    got, left = rowstore.get_and_delete(t("orders").select("o_orderkey", "o_custkey"), t("lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return got.select(F.lit(True).alias("taken"), "o_orderkey", "o_custkey").union(left.select(F.lit(False), "o_orderkey", "o_custkey"))


@query("SELECT o_custkey, o_orderkey FROM orders LEFT JOIN (SELECT c_custkey, 2 AS gone FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey QUALIFY gone IS NULL OR row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > gone")
def rs_delete_one(t, spark, sf):
    """Two instances less of every even key of a bag."""
    gone = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return rowstore.delete_one(t("orders").select("o_custkey", "o_orderkey"), gone.union(gone), "o_custkey", "o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE false")
def rs_truncate(t, spark, sf):
    return rowstore.truncate(t("orders")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT probe, (SELECT min(l_partkey) FROM lineitem WHERE l_quantity = 50 AND l_partkey >= probe) AS l_partkey FROM (SELECT p_partkey AS probe FROM part)")
def rs_at_or_after(t, spark, sf):
    """For every part number the first key at or after it."""
    stored = t("lineitem").where("l_quantity = 50").select("l_partkey")
    return rowstore.at_or_after(stored, t("part").select(F.col("p_partkey").alias("probe")), "l_partkey", 64)


_DICT = "d AS (SELECT p_brand AS value, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM part GROUP BY 1)"


@query(f"WITH {_DICT} SELECT code, value, count(*) AS n, min(p_partkey) AS first_part FROM part JOIN d ON p_brand = value WHERE code IN (1, 3) GROUP BY ALL")
def dict_lookup_by_code(t, spark, sf):
    """Rows keyed by dictionary codes, resolved through the dictionary: lookup by value, then by code."""
    parts = t("part").select("p_partkey", "p_brand")
    words = dictionary.dictionary(parts, "p_brand")
    coded = dictionary.encode(parts, "p_brand", words)
    got = rowstore.lookup(coded.where("code in (1, 3)"), words, "code", ["value"])
    return got.groupBy("code", "value").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


@query("WITH a AS (SELECT c_nationkey AS k, max(c_custkey) AS v FROM customer WHERE c_nationkey < 20 GROUP BY 1), b AS (SELECT s_nationkey AS k, max(s_suppkey) AS v FROM supplier WHERE s_nationkey > 5 GROUP BY 1) SELECT a.k, coalesce(b.v, a.v) AS v FROM a LEFT JOIN b ON a.k = b.k")
def dict_put_present(t, spark, sf):
    a = t("customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_custkey").alias("v"))
    return rowstore.put_present(a, t("supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_suppkey").alias("v")), "k", "v")


@query("SELECT held, count(*) AS buckets, CAST(sum(held) AS BIGINT) AS n FROM (SELECT o_custkey % 64 AS b, count(*) AS held FROM orders GROUP BY 1) GROUP BY 1")
def dict_stats(t, spark, sf):
    """How many buckets of a hash table hold how many entries."""
    return rowstore.bucket_sizes(t("orders"), F.pmod(F.col("o_custkey"), F.lit(64)))
