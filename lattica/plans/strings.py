"""Queries over string, number and identifier functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, numbers, text
from ..operators.order import numbered
from .registry import query


def _names(t):
    return t("part").select("p_partkey", F.col("p_name").alias("s"))


def _docs(t):
    return t("documents").select("doc_id", F.col("text").alias("s"))


@query("SELECT p_partkey, instr(p_name, 'a') - 1 AS first_a, CASE WHEN instr(reverse(p_name), 'a') = 0 THEN -1 ELSE length(p_name) - instr(reverse(p_name), 'a') END AS last_a, CASE WHEN len(string_split(p_name, 'e')) > 2 THEN length(array_to_string(string_split(p_name, 'e')[1:2], 'e')) ELSE -1 END AS second_e FROM part")
def txt_find(t, spark, sf):
    return _names(t).select("p_partkey", text.find(F.col("s"), "a").alias("first_a"), text.find_last(F.col("s"), "a").alias("last_a"), text.find_nth_char(F.col("s"), "e", 1).alias("second_e"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS the, (length(text) - length(replace(text, chr(10), ''))) AS feeds FROM documents")
def txt_count(t, spark, sf):
    return _docs(t).select("doc_id", text.count(F.col("s"), "the").alias("the"), text.count(F.col("s"), "\n").alias("feeds"))


@query("SELECT p_partkey, starts_with(p_name, 'a') AS starts, ends_with(p_name, 'e') AS ends, contains(p_name, 'ed') AS holds FROM part")
def txt_prefix_suffix(t, spark, sf):
    return _names(t).select("p_partkey", F.col("s").startswith("a").alias("starts"), F.col("s").endswith("e").alias("ends"), F.col("s").contains("ed").alias("holds"))


@query("SELECT doc_id, substring(text, 6, 10) AS mid, substring(text, 2, greatest(length(text) - 2, 0)) AS inner_part, left(text, 3) AS head FROM documents")
def txt_substr(t, spark, sf):
    return _docs(t).select("doc_id", text.substring(F.col("s"), 5, 10).alias("mid"), text.slice_inclusive(F.col("s"), 1, -2).alias("inner_part"), text.slice_inclusive(F.col("s"), 0, 2).alias("head"))


@query("SELECT p_partkey, trim(p_name, 'aeiou ') AS trimmed, length(p_name) - length(ltrim(p_name, 'abcdefghij')) AS spanned FROM part")
def txt_trim(t, spark, sf):
    return _names(t).select("p_partkey", text.trim(F.col("s"), "aeiou ").alias("trimmed"), text.span(F.col("s"), "abcdefghij").alias("spanned"))


@query("SELECT doc_id, len(CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END) AS n, coalesce(array_to_string((CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END)[1:2], '|'), '') AS first_two FROM (SELECT doc_id, string_split(text, ' de ') AS p FROM documents)")
def txt_split(t, spark, sf):
    return _docs(t).select("doc_id", F.size(text.split(F.col("s"), " de ")).cast("long").alias("n"), F.array_join(text.split(F.col("s"), " de ", 2), "|").alias("first_two"))


@query("SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, translate(p_brand, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, (CASE WHEN lower(p_name) < lower(p_type) THEN -1 WHEN lower(p_name) > lower(p_type) THEN 1 ELSE 0 END)::BIGINT AS cmp FROM part")
def txt_case(t, spark, sf):
    return t("part").select("p_partkey", text.ascii_upper(F.col("p_name")).alias("up"), text.ascii_lower(F.col("p_brand")).alias("low"), text.compare_ignoring_case(F.col("p_name"), F.col("p_type")).alias("cmp"))


@query("SELECT p_partkey, translate(p_name, 'ho', '01') AS mapped FROM part")
def txt_translate(t, spark, sf):
    return _names(t).select("p_partkey", text.translate(F.col("s"), "ho", "01").alias("mapped"))


@query("SELECT p_partkey, p_type GLOB '*A*' AS a, p_brand GLOB 'Brand#?2' AS b FROM part")
def txt_glob(t, spark, sf):
    return t("part").select("p_partkey", text.glob(F.col("p_type"), "*A*").alias("a"), text.glob(F.col("p_brand"), "Brand#?2").alias("b"))


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes FROM documents")
def txt_utf8_len(t, spark, sf):
    return _docs(t).select("doc_id", text.length(F.col("s")).alias("chars"), text.byte_length(F.col("s")).alias("bytes"))


@query("SELECT doc_id, length_grapheme(text) AS clusters FROM documents")
def txt_grapheme(t, spark, sf):
    return _docs(t).select("doc_id", text.grapheme_count(F.col("s")).alias("clusters"))


@query("SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, true), (5, false), (6, false), (7, false)) AS v(k, valid)")
def txt_utf8_valid(t, spark, sf):
    """ASCII, two-, three- and four-byte characters; overlong, surrogate and too large sequences."""
    rows = [(1, b"abc"), (2, "é".encode()), (3, "日".encode()), (4, "😀".encode()), (5, b"\xc0\xaf"), (6, b"\xed\xa0\x80"), (7, b"\xf4\x90\x80\x80")]
    return spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "k int, b binary").select("k", F.is_valid_utf8(F.col("b").cast("string")).alias("valid"))


_WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{4DBF}\x{4E00}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"


@query(rf"SELECT doc_id, length(text) - len(regexp_extract_all(text, '[\p{{Cc}}\p{{Cf}}\p{{Mn}}\p{{Me}}]')) + len(regexp_extract_all(text, '{_WIDE}')) AS width FROM documents")
def txt_width(t, spark, sf):
    return _docs(t).select("doc_id", text.display_width(F.col("s")).alias("width"))


@query("SELECT doc_id, '\"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\"' AS repr FROM documents")
def txt_repr(t, spark, sf):
    return _docs(t).select("doc_id", text.escaped(F.col("s")).alias("repr"))


@query("SELECT doc_id, left(text, list_filter(range(0, 26), lambda k: strlen(left(text, k)) <= 25)[-1]) AS head FROM documents")
def txt_truncate_bytes(t, spark, sf):
    return _docs(t).select("doc_id", text.truncate_bytes(F.col("s"), 25).alias("head"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS joined FROM orders GROUP BY 1")
def txt_join(t, spark, sf):
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("joined"))


@query("SELECT k, a FROM (VALUES (1, ['a', 'b c', 'd']), (2, ['x y', 'z']), (3, NULL), (4, []::VARCHAR[])) AS v(k, a)")
def txt_shell_split(t, spark, sf):
    rows = [(1, "a 'b c' d"), (2, '"x y" z'), (3, "open 'quote"), (4, "")]
    return spark.createDataFrame(rows, "k int, s string").select("k", text.shell_split(F.col("s")).alias("a"))


_KEYS = "SELECT unnest([p_name, p_brand, CAST(p_partkey AS VARCHAR), CAST(p_retailprice AS VARCHAR), '-' || CAST(p_size AS VARCHAR), '99999999999999999999', '']) AS s FROM part"


def _texts(t):
    p = t("part")
    return p.select(F.explode(F.array("p_name", "p_brand", F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("string"), F.concat(F.lit("-"), F.col("p_size").cast("string")), F.lit("99999999999999999999"), F.lit(""))).alias("s"))


@query(f"SELECT DISTINCT s, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN TRY_CAST(s AS BIGINT) END AS n, CASE WHEN regexp_full_match(s, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(s AS DOUBLE) END AS d FROM ({_KEYS})")
def num_parse(t, spark, sf):
    return _texts(t).select("s", numbers.parse_long(F.col("s")).alias("n"), numbers.parse_double(F.col("s")).alias("d")).distinct()


@query("SELECT o_orderkey, length(CAST(o_orderkey * 7919 AS VARCHAR)) AS digits, regexp_full_match(CAST(o_orderkey AS VARCHAR), '[0-9]+') AS all_digits FROM orders")
def num_digit_count(t, spark, sf):
    return t("orders").select("o_orderkey", numbers.digit_count(F.col("o_orderkey") * 7919).alias("digits"), text.is_digits(F.col("o_orderkey").cast("string")).alias("all_digits"))


@query("SELECT * FROM (VALUES ('12GB', 12000000000), ('12 GB', 12000000000), ('12   GB', 12000000000), ('1.5kib', 1536), ('7', 7), ('x', NULL), ('3 parsecs', NULL)) AS v(s, n)")
def human_bytes(t, spark, sf):
    rows = [(s,) for s in ("12GB", "12 GB", "12   GB", "1.5kib", "7", "x", "3 parsecs")]
    return spark.createDataFrame(rows, "s string").select("s", numbers.human_to_bytes(F.col("s")).alias("n"))


@query("SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.5f GiB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.5f MiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.5f KiB', b / 1024.0) ELSE b || ' B' END AS human FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 31 AS b FROM orders)")
def bytes_human(t, spark, sf):
    return t("orders").select("o_orderkey", numbers.bytes_to_human(F.col("o_orderkey") * F.col("o_orderkey") * 31, "GiB").alias("human"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey <= 1 THEN 0 ELSE CAST(round(log2(o_orderkey) * 10) AS BIGINT) END AS est, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
def num_estimates(t, spark, sf):
    return t("orders").select("o_orderkey", numbers.log_estimate(F.col("o_orderkey")).alias("est"), numbers.to_long_saturating(F.col("o_totalprice")).alias("whole"))


@query("SELECT CAST(e AS INTEGER) AS e, CAST(pow(10, e) AS BIGINT) AS p FROM range(0, 16) AS r(e)")
def num_ten_power(t, spark, sf):
    return spark.range(16).select(F.col("id").cast("int").alias("e"), F.col("id")).select("e", numbers.ten_power(F.col("id")).cast("long").alias("p"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS back FROM lineitem")
def num_half_float(t, spark, sf):
    """Small whole numbers survive half precision."""
    return t("lineitem").select("l_orderkey", "l_linenumber", numbers.half_decode(numbers.half_encode(F.col("l_quantity"))).alias("back"))


_ID = "(epoch_us(ts) // 1000 % 4398046511104) * 1048576 + event_id % 1048576"


def _ids(t):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return t("events").select("event_id", ids.compose(ns, F.col("event_id"), "ms64").alias("id"))


@query(f"SELECT event_id, {_ID} AS id, epoch_us(ts) // 1000 % 4398046511104 AS ticks, event_id % 1048576 AS low FROM events")
def id64_fields(t, spark, sf):
    i = _ids(t)
    return i.select("event_id", "id", ids.ticks(F.col("id"), "ms64").alias("ticks"), ids.random_part(F.col("id"), "ms64").alias("low"))


@query(f"SELECT event_id, {_ID} AS id, 13 AS n, row_number() OVER (ORDER BY {_ID}, event_id) AS place FROM events")
def id64_base36(t, spark, sf):
    """Base-36 text decodes to the id, has 13 digits, and sorts as the ids do."""
    coded = numbered(_ids(t).withColumn("b", ids.base36(F.col("id"))), "b", "place", ["event_id"])
    return coded.select("event_id", ids.from_base36(F.col("b")).alias("id"), F.char_length("b").alias("n"), (F.col("place") + 1).alias("place"))


@query(f"SELECT event_id, {_ID} AS id, 13 AS n, rank() OVER (ORDER BY {_ID}) AS place FROM events")
def id64_base36_all(t, spark, sf):
    """As id64_base36, over every event. Places are running counts by text within chunks of 36 ** 7 ids (75 s), and offsets between them."""
    from pyspark.sql import Window

    coded = _ids(t).withColumn("b", ids.base36(F.col("id"))).withColumn("c", F.substring("b", 1, 6))
    before = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coded.groupBy("c").agg(F.count(F.lit(1)).alias("k")).select("c", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("o"))
    place = (F.col("o") + F.rank().over(Window.partitionBy("c").orderBy("b"))).cast("long")
    return coded.join(offsets, "c").select("event_id", ids.from_base36(F.col("b")).alias("id"), F.char_length("b").alias("n"), place.alias("place"))


@query("SELECT event_id, upper(lpad(hex(epoch_us(ts) * 1000), 16, '0') || lpad(hex(event_id), 16, '0')) AS id, epoch_us(ts) * 1000 AS ns FROM events")
def id128_fields(t, spark, sf):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return t("events").select("event_id", ids.wide(ns, F.col("event_id")).alias("id")).withColumn("ns", ids.wide_ts(F.col("id")))


@query("SELECT event_id, CAST(list_sum(list_transform(range(0, 20), lambda k: (((user_id >> k) & 1) << (2 * k + 1)) | ((((event_id % 1048576) >> k) & 1) << (2 * k)))) AS BIGINT) AS z FROM events")
def id_interleave(t, spark, sf):
    return t("events").select("event_id", ids.interleave(F.col("user_id"), F.col("event_id") % 1048576).alias("z"))


@query("SELECT n_name, n_name NOT LIKE '%/%' AS base, '/data/' || n_name || '/x' AS full_path, '10.0.0.' || n_nationkey || ':' || (8000 + n_nationkey) AS v4, '[fe80::' || n_nationkey || ']:80' AS v6, substr(sha256(n_nationkey::VARCHAR), 1, 16) AS hexes FROM nation")
def sys_paths_addresses(t, spark, sf):
    from ..functions import system

    k = F.col("n_nationkey")
    return t("nation").select(
        "n_name", system.is_base_name(F.col("n_name")).alias("base"), system.absolute_path(F.concat(F.lit("./"), F.col("n_name"), F.lit("//x")), "/data/").alias("full_path"),
        system.address(F.concat(F.lit("10.0.0."), k.cast("string")), 8000 + k).alias("v4"), system.address(F.concat(F.lit("fe80::"), k.cast("string")), F.lit(80)).alias("v6"), system.random_hex(k).alias("hexes"),
    )


@query("SELECT o_orderkey, CAST(o_orderkey::HUGEINT * o_orderkey * 1000003 // 97 AS BIGINT) AS q, CAST(o_orderkey::HUGEINT * o_orderkey * 1000003 % 97 AS BIGINT) AS r, CASE WHEN o_orderkey * 3 - 500 BETWEEN -128 AND 127 THEN 1 WHEN o_orderkey * 3 - 500 BETWEEN -32768 AND 32767 THEN 2 ELSE 4 END AS width, CAST((o_orderkey % 9)::HUGEINT ** 7 AS BIGINT) AS p FROM orders")
def num_big(t, spark, sf):
    from ..functions import system

    k = F.col("o_orderkey")
    q, r = system.big_divide(system.big(k) * system.big(k) * 1000003, F.lit(97))
    return t("orders").select("o_orderkey", q.cast("long").alias("q"), r.cast("long").alias("r"), system.int_width(k * 3 - 500).alias("width"), system.big_power(k % 9, 7).cast("long").alias("p"))


@query("SELECT o_orderkey, CASE WHEN s >= 1 THEN printf('%.4f s', s) WHEN s >= 0.001 THEN printf('%.4f ms', s * 1000) ELSE printf('%.4f us', s * 1000000) END AS human FROM (SELECT o_orderkey, o_totalprice / 100000000.0 * (CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 1 END) AS s FROM orders)")
def num_human_seconds(t, spark, sf):
    from ..functions import system

    s = F.col("o_totalprice") / 100000000.0 * F.when(F.col("o_orderkey") % 2 == 0, 1000).otherwise(1)
    return t("orders").select("o_orderkey", system.human_seconds(s).alias("human"))


@query("SELECT l_suppkey, array_to_string(list_sort(list(l_partkey))[1:3], ',') AS head, count(*) AS n, list_sort(list(l_partkey))[-1] AS last FROM lineitem GROUP BY 1")
def list_slices(t, spark, sf):
    """Lists as arrays: first items, length, last item."""
    items = F.sort_array(F.collect_list("l_partkey"))
    return t("lineitem").groupBy("l_suppkey").agg(F.array_join(F.transform(F.slice(items, 1, 3), lambda x: x.cast("string")), ",").alias("head"), F.count(F.lit(1)).alias("n"), F.element_at(items, -1).alias("last"))
