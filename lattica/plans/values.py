"""Queries over code points, bytes, exact numbers and identifier variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, numbers, system, text
from .registry import query


def _docs(t):
    return t("documents").select("doc_id", F.col("text").alias("s"))


@query("SELECT doc_id, unicode(text)::BIGINT AS first_point, hex(encode(chr(unicode(text)))) AS encoded FROM documents WHERE length(text) > 0")
def txt_code_point(t, spark, sf):
    """The first code point of each text from its bytes, and its bytes from the number."""
    d = _docs(t).where(F.char_length("s") > 0)
    point = text.code_point(F.encode("s", "UTF-8"))
    return d.select("doc_id", point.alias("first_point"), F.hex(text.code_point_bytes(point)).alias("encoded"))


@query("SELECT doc_id, strlen(left(text, 50)) AS bytes_of_50, CAST((length(hex(encode(left(text, 50)))) / 2) AS BIGINT) AS again, least(50, length(text)) AS chars FROM documents")
def txt_byte_offset(t, spark, sf):
    """A character position as a byte offset, and back."""
    at = text.byte_offset(F.col("s"), 50)
    back = text.char_index(F.left("s", F.lit(50)), 10**6)
    return _docs(t).select("doc_id", at.alias("bytes_of_50"), F.octet_length(F.left("s", F.lit(50))).cast("long").alias("again"), back.alias("chars"))


@query(r"SELECT doc_id, regexp_matches(text, '^\pL') AS letter, regexp_matches(text, '^\p{Nd}') AS digit, regexp_matches(text, '^[\pZ\t-\r]') AS space FROM documents")
def txt_classes(t, spark, sf):
    s = F.col("s")
    return _docs(t).select("doc_id", text.is_letter(s).alias("letter"), text.is_digit(s).alias("digit"), text.is_space(s).alias("space"))


@query("SELECT p_partkey, length(p_name) - length(ltrim(p_name, 'abcdefgh')) AS spanned, CASE WHEN ltrim(p_name, 'abcdefgh') = '' THEN -1 ELSE length(p_name) - length(ltrim(p_name, 'abcdefgh')) END AS not_any, instr(translate(p_name, 'eio', 'eee'), 'e') - 1 AS any_, CASE WHEN instr(translate(p_name, 'eio', 'eee'), 'e') > 0 THEN instr(translate(p_name, 'eio', 'eee'), 'e') - 1 ELSE length(p_name) END AS before_any FROM part")
def txt_spans(t, spark, sf):
    s = F.col("p_name")
    return t("part").select("p_partkey", text.span(s, "abcdefgh").alias("spanned"), text.find_not_any(s, "abcdefgh").alias("not_any"), text.find_any(s, "eio").alias("any_"), text.span_not(s, "eio").alias("before_any"))


@query("SELECT p_partkey, p_name || '/' || p_size || '/' || lpad(p_partkey::VARCHAR, 8, '0') AS joined, printf('%s has size %d and price %.2f', p_name, p_size, p_retailprice) AS formatted, rpad(p_name, 12, '.') AS padded FROM part")
def txt_format(t, spark, sf):
    """Concatenation, plain and formatted, and padding."""
    k = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    return t("part").select(
        "p_partkey", F.concat_ws("/", "p_name", F.col("p_size").cast("string"), k).alias("joined"),
        F.concat(F.col("p_name"), F.format_string(" has size %d and price ", "p_size"), numbers.fixed(F.col("p_retailprice"), 2)).alias("formatted"), text.pad_width(F.col("p_name"), 12, ".").alias("padded"),
    )


@query("SELECT k, rank() OVER (ORDER BY len, n) AS place FROM (SELECT 'v' || (c_custkey % 120) || '.x' AS k, 0 AS len, c_custkey % 120 AS n FROM customer GROUP BY ALL)")
def txt_natural_order(t, spark, sf):
    """Digit runs in order of their values: v9.x before v10.x. The distinct names are few; each counts those before it."""
    names = t("customer").select(F.concat(F.lit("v"), (F.col("c_custkey") % 120).cast("string"), F.lit(".x")).alias("k")).distinct()
    keyed = names.withColumn("key", text.natural_key(F.col("k")))
    before = F.broadcast(keyed.limit(1000).select(F.col("key").alias("other")))
    return keyed.join(before, F.col("other") <= F.col("key")).groupBy("k").agg(F.count(F.lit(1)).alias("place"))


@query("SELECT p_partkey, (CASE WHEN left(p_name, 4) < left(p_type, 4) THEN -1 WHEN left(p_name, 4) > left(p_type, 4) THEN 1 ELSE 0 END)::BIGINT AS cmp FROM part")
def txt_compare_first(t, spark, sf):
    return t("part").select("p_partkey", text.compare_first(F.col("p_name"), F.col("p_type"), 4).alias("cmp"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[a-m].*[^aeiou]$') AS range_set, regexp_matches(p_brand, '^Brand#[1-3]$') AS digits, regexp_matches(p_name, '^.* .*$') AS blank, regexp_matches(p_type, '(?i)^eco*') AS folded FROM part")
def txt_glob_sets(t, spark, sf):
    """Ranges, complements, escapes and case folding."""
    n = F.col("p_name")
    return t("part").select("p_partkey", text.glob(n, "[a-m]*[^aeiou]").alias("range_set"), text.glob(F.col("p_brand"), r"Brand\#[1-3]").alias("digits"), text.glob(n, "* *").alias("blank"), text.glob(F.col("p_type"), "eco*", ignore_case=True).alias("folded"))


@query("SELECT doc_id, true AS valid, true AS damaged_is_not FROM documents WHERE text IS NOT NULL")
def txt_utf8_all(t, spark, sf):
    """Every text is valid, and none is with a stray continuation byte put before it."""
    b = F.encode("s", "UTF-8")
    return _docs(t).where("s is not null").select("doc_id", text.is_valid_utf8(b).alias("valid"), (~text.is_valid_utf8(F.concat(F.unhex(F.lit("80")), b))).alias("damaged_is_not"))


@query("SELECT p_partkey, p_name AS one, p_brand || ' x' AS two, 3::BIGINT AS n FROM part")
def txt_shell_args(t, spark, sf):
    """Names with blanks survive quoting."""
    line = F.concat(F.lit("'"), F.col("p_name"), F.lit("' \""), F.col("p_brand"), F.lit(" x\"  a\\ b"))
    args = text.shell_split(line)
    return t("part").select("p_partkey", F.get(args, F.lit(0)).alias("one"), F.get(args, F.lit(1)).alias("two"), F.size(args).cast("long").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 0 THEN -1 ELSE o_orderkey END AS cmp_base, (CASE WHEN o_orderkey::DECIMAL(38,2) < o_totalprice::DECIMAL(38,2) THEN -1 WHEN o_orderkey::DECIMAL(38,2) > o_totalprice::DECIMAL(38,2) THEN 1 ELSE 0 END)::BIGINT AS cmp, 1::BIGINT AS beyond FROM orders")
def num_compare_exact(t, spark, sf):
    """Whole numbers against doubles by value; 2 ** 53 + 1 is above 2 ** 53, which a cast to double would lose."""
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", k.alias("cmp_base"), numbers.compare_exact(k, F.col("o_totalprice")).alias("cmp"), numbers.compare_exact(F.lit((1 << 53) + 1).cast("long"), F.lit(float(1 << 53))).alias("beyond"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS unsigned_text, o_totalprice = trunc(o_totalprice) AS lossless, o_orderkey * 255 AS from_hex, o_orderkey % 512 AS from_octal FROM orders")
def num_parse_forms(t, spark, sf):
    """Unsigned, hexadecimal and octal text, and whether a double is a whole number."""
    k = F.col("o_orderkey")
    return t("orders").select(
        "o_orderkey", numbers.parse_unsigned(k.cast("string")).cast("string").alias("unsigned_text"), numbers.is_lossless(F.col("o_totalprice")).alias("lossless"),
        numbers.parse_radix(F.concat(F.lit("0x"), F.hex(k * 255))).alias("from_hex"), numbers.parse_radix(F.concat(F.lit("0"), F.conv((k % 512).cast("string"), 10, 8))).alias("from_octal"),
    )


@query("SELECT o_orderkey, o_totalprice::VARCHAR AS shortest, printf('%.1f', o_totalprice) AS one, printf('%08d', o_orderkey) AS padded FROM orders WHERE o_totalprice < 1000000")
def num_to_text(t, spark, sf):
    """Shortest text of doubles, rounded text, and padded whole numbers."""
    o = t("orders").where("o_totalprice < 1000000")
    return o.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("double").cast("string").alias("shortest"), numbers.fixed(F.col("o_totalprice"), 1).alias("one"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("padded"))


@query("SELECT CAST(e AS INTEGER) AS e, '1' || repeat('0', e) AS p FROM range(0, 38) AS r(e)")
def num_ten_power_exact(t, spark, sf):
    """All 38 powers of ten, exact."""
    return spark.range(38).select(F.col("id").cast("int").alias("e"), numbers.ten_power(F.col("id")).cast("string").alias("p"))


@query("SELECT o_orderkey, CAST(round(greatest(a, b) + 10 * log2(1 + pow(2.0, -abs(a - b) / 10.0))) AS BIGINT) AS added, CAST(round(pow(2.0, a / 10.0)) AS BIGINT) AS back FROM (SELECT o_orderkey, o_orderkey % 200 AS a, o_custkey % 200 AS b FROM orders)")
def num_log_estimates(t, spark, sf):
    a, b = F.col("o_orderkey") % 200, F.col("o_custkey") % 200
    return t("orders").select("o_orderkey", numbers.log_add(a, b).alias("added"), numbers.log_inverse(a).alias("back"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS back FROM lineitem")
def num_brain_float(t, spark, sf):
    """Small whole numbers survive bfloat16."""
    return t("lineitem").select("l_orderkey", "l_linenumber", numbers.brain_decode(numbers.brain_encode(F.col("l_quantity"))).alias("back"))


@query("SELECT o_orderkey, (CASE WHEN o_orderkey::HUGEINT * 10000000000000000 < o_custkey::HUGEINT * 30000000000000000 THEN -1 WHEN o_orderkey::HUGEINT * 10000000000000000 > o_custkey::HUGEINT * 30000000000000000 THEN 1 ELSE 0 END)::BIGINT AS cmp FROM orders")
def num_big_compare(t, spark, sf):
    """Products beyond 64 bits."""
    k, c = (system.big(F.col(x)) for x in ("o_orderkey", "o_custkey"))
    return t("orders").select("o_orderkey", system.big_compare(k * F.lit(10**16), c * F.lit(3 * 10**16)).alias("cmp"))


@query("SELECT count(*) AS n, count(*) AS distinct_hashes, true AS case_folds, true AS seeds_differ FROM part")
def sys_hashes(t, spark, sf):
    """64-bit hashes of names with keys: no collision, equal for letters of either case, other for another seed."""
    name = F.concat_ws("#", "p_name", F.col("p_partkey").cast("string"))
    return t("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(system.hash64(name)).alias("distinct_hashes"),
        F.bool_and(system.hash64_ignoring_case(name) == system.hash64_ignoring_case(F.upper(name))).alias("case_folds"), F.bool_and(system.hash64(name, 1) != system.hash64(name, 2)).alias("seeds_differ"),
    )


@query("WITH a AS (SELECT o_orderkey, (o_orderkey + 1)::HUGEINT AS s FROM orders), b AS (SELECT o_orderkey, xor(s, (s * 8192) % 18446744073709551616) AS s FROM a), c AS (SELECT o_orderkey, xor(s, s // 128) AS s FROM b), d AS (SELECT o_orderkey, xor(s, (s * 131072) % 18446744073709551616) AS s FROM c) SELECT o_orderkey, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS step FROM d")
def sys_xorshift(t, spark, sf):
    """One step of the generator from every key."""
    return t("orders").select("o_orderkey", system.xorshift(F.col("o_orderkey") + 1).alias("step"))


_US = "epoch_us(ts)"


@query(f"SELECT event_id, ({_US} // 1000000 % 4194304) * 1024 + event_id % 1024 AS s32, ({_US} // 1000 % 67108864) * 64 + event_id % 64 AS ms32, {_US} // 1000000 % 4194304 AS s_ticks, 7 AS width, {_US} // 1000000 <= 4194303 AS fits FROM events")
def id32_fields(t, spark, sf):
    """The 32-bit layouts: composed, taken apart, and as 7 digits."""
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    s, ms = ids.compose(ns, F.col("event_id"), "s32"), ids.compose(ns, F.col("event_id"), "ms32")
    e = t("events").select("event_id", s.alias("s32"), ms.alias("ms32"), ids.fits(ns, "s32").alias("fits"))
    coded = ids.base36(F.col("s32"), ids.text_width("s32"))
    return e.select("event_id", ids.from_base36(coded).alias("s32"), "ms32", ids.ticks(F.col("s32"), "s32").alias("s_ticks"), F.char_length(coded).alias("width"), "fits")


@query(f"SELECT event_id, ({_US} // 1000000 % 8589934592) * 536870912 + event_id % 536870912 AS s64, ({_US} % 4503599627370496) * 1024 + event_id % 1024 AS us64 FROM events")
def id64_layouts(t, spark, sf):
    """The other 64-bit layouts."""
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return t("events").select("event_id", ids.compose(ns, F.col("event_id"), "s64").alias("s64"), ids.compose(ns, F.col("event_id"), "us64").alias("us64"))


@query("SELECT layout, unit_ns::BIGINT AS unit_ns, time_bits, random_bits, most_ticks, width FROM (VALUES ('ms32', 10**6, 26, 6, 67108863, 7), ('ms64', 10**6, 44, 20, 17592186044415, 13), ('s32', 10**9, 22, 10, 4194303, 7), ('s64', 10**9, 35, 29, 34359738367, 13), ('us64', 10**3, 54, 10, 18014398509481983, 13)) AS v(layout, unit_ns, time_bits, random_bits, most_ticks, width)".replace("10**9", "1000000000").replace("10**6", "1000000").replace("10**3", "1000"))
def id_layouts(t, spark, sf):
    """What each layout holds."""
    rows = [(k, unit, a, b, ids.most_ticks(k), ids.text_width(k)) for k, (unit, a, b) in ids.LAYOUTS.items()]
    return spark.createDataFrame(rows, "layout string, unit_ns long, time_bits int, random_bits int, most_ticks long, width int")


@query("SELECT event_id, user_id AS a, event_id % 1048576 AS b, false AS null_id FROM events")
def id_deinterleave(t, spark, sf):
    """Interleaved numbers taken apart again."""
    z = ids.interleave(F.col("user_id"), F.col("event_id") % 1048576)
    e = t("events").select("event_id", z.alias("z"))
    a, b = ids.deinterleave(F.col("z"))
    return e.select("event_id", a.alias("a"), b.alias("b"), ids.is_null_id(F.col("z") + 1).alias("null_id"))


@query(f"SELECT event_id, upper(lpad(hex({_US} * 1000), 16, '0') || lpad(hex({_US} * 1000 + event_id), 16, '0')) AS id FROM events")
def id_dual(t, spark, sf):
    """Two times in one id."""
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return t("events").select("event_id", ids.dual(ns, ns + F.col("event_id")).alias("id"))


@query("SELECT o_orderkey, o_orderkey * f AS n, NULL::BIGINT AS none FROM orders, (SELECT unnest(range(0, 6)) AS k, unnest([1, 1000, 1024, 1000000, 1048576, 1000000000]) AS f) WHERE o_orderkey % 6 = k")
def human_bytes_all(t, spark, sf):
    """Amounts with units, and a unit that isn't one."""
    k = F.col("o_orderkey")
    unit = F.get(F.array(*[F.lit(u) for u in ("", " kB", "KiB", "  M", "mib", "gb")]), (k % 6).cast("int"))
    return t("orders").select("o_orderkey", numbers.human_to_bytes(F.concat(k.cast("string"), unit)).alias("n"), numbers.human_to_bytes(F.concat(k.cast("string"), F.lit(" parsecs"))).alias("none"))
