"""Golden values and generated cases for the container operators."""

import bisect
import os
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import ids, numbers, text
from lattica.operators import arrays, bitmap, cache, keys, lists, order, placement, prefix, rowstore, scored, series, sketch
from lattica.sources import store
from lattica.streaming import flows


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_scored_union_and_intersection(spark):
    make = lambda x: spark.createDataFrame(x, "member string, score double")
    a, b = make([("a", 1.0), ("b", 2.0)]), make([("b", 3.0), ("c", 4.0)])
    assert rows(scored.union([a, b], [1, 1], "member", "score"), "member", "score") == [("a", 1.0), ("b", 5.0), ("c", 4.0)]
    a, b = make([("a", 1.0), ("b", 2.0), ("c", 3.0)]), make([("b", 10.0), ("c", 20.0)])
    assert rows(scored.intersect([a, b], [1, 1], "member", "score"), "member", "score") == [("b", 12.0), ("c", 23.0)]
    assert rows(scored.difference(a, [b], "member"), "member") == [("a",)]


def test_prefix_sums_and_bounds(spark):
    v = [3, 1, 4, 1, 5, 9, 2, 6]
    df = spark.createDataFrame(list(enumerate(v)), "idx long, v long")
    want = [(i, sum(v[: i + 1])) for i in range(len(v))]
    assert rows(prefix.prefix_sums(df, "idx", "v"), "idx", "prefix") == want
    assert rows(prefix.prefix_sums(df, "idx", "v", block=3), "idx", "prefix") == want
    df = spark.createDataFrame(list(enumerate([1, 2, 3, 4, 5])), "idx long, v long")
    assert rows(prefix.lower_bound(df, [6, 7, 16], "idx", "v"), "target", "idx") == [(6, 2), (7, 3)]
    df = spark.createDataFrame(list(enumerate([5, 2, 8, 1, 9])), "idx long, v long")
    q = spark.createDataFrame([(1, 0, 4)], "q int, lo int, hi int")
    assert rows(prefix.range_aggregate(df, q, "idx", "v", "min"), "result") == [(1,)]
    assert rows(prefix.range_aggregate(df, q, "idx", "v", "max"), "result") == [(9,)]


def test_bitmap_algebra(spark):
    rng = random.Random(3)
    a, b = set(rng.sample(range(500), 200)), set(rng.sample(range(500), 200))
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, pos long")
    for how, want in {"and": a & b, "or": a | b, "xor": a ^ b, "andnot": a - b}.items():
        assert {r[0] for r in bitmap.combine(df, "g", "pos", ["a", "b"], how).collect()} == want
    edges = [0, 8191, 8192, 8193, 16383, 16384, 65536]
    df = spark.createDataFrame([(x,) for x in edges], "pos long")
    assert rows(bitmap.ranks(df, "pos"), "pos", "rank") == list(zip(edges, range(7), strict=True))
    assert bitmap.complement(df.where("pos < 8192"), "pos").count() == 8190


def test_bag_keys_and_upsert(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (1,), (3,)], "k int")
    assert rows(keys.intersect_bag(a, b), "k") == [(1,), (1,), (3,)]
    assert rows(keys.symmetric_difference(a, b), "k") == [(2,)]
    log = spark.createDataFrame([(42, i, i) for i in range(100)], "k long, v long, t long")
    assert rows(rowstore.upsert(log, ["k"], ["t"]), "v") == [(99,)]
    edge = spark.createDataFrame([(-(2**63),), (0,), (2**63 - 1,)], "k long")
    assert [r[0] for r in rowstore.scan(edge, "k").collect()] == [-(2**63), 0, 2**63 - 1]


def test_take_while_stops_at_the_first_failure(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(10)], "k long, v long")
    assert rows(rowstore.take_while(df, ["k"], F.col("v") < 3), "k") == [(0,), (1,), (2,)]
    assert rows(rowstore.take_while(df, ["k"], F.col("v") < 3, forward=False), "k") == [(8,), (9,)]
    assert rowstore.take_while(df, ["k"], F.lit(True)).count() == 10


@pytest.mark.parametrize("values", [[5], [5, 5, 5], [1700000000000 + 1000 * i for i in range(50)], [0, 2**40, -(2**40), 7, 7]])
def test_delta_of_delta_round_trip(spark, values):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, i int, v long")
    coded = series.dod_encode(df, ["g"], ["i"], "v").select("g", "seq", "dd")
    assert [r["out"] for r in series.dod_decode(coded, ["g"], "out").orderBy("seq").collect()] == values


def test_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    s = lambda x: F.lit(x)
    assert get(text.split(s("left<=>right"), "<=>")) == ["left", "right"]
    assert get(text.split(s("a,b,"), ",")) == ["a", "b"]
    assert get(text.trim(s("--=-middle part==-"), "-=")) == "middle part"
    assert get(text.slice_inclusive(s("seven seas"), 2, -2)) == "ven sea"
    assert get(text.translate(s("banana"), "bn", "x7")) == "xa7a7a"
    assert get(text.find_last(s("abcabc"), "bc")) == 4
    assert get(text.find_nth_char(s("a.b.c"), ".", 1)) == 3
    assert get(text.truncate_bytes(s("aé日"), 4)) == "aé"
    assert get(text.display_width(s("a日é"))) == 4
    assert get(numbers.human_to_bytes(s("12   GB"))) == 12_000_000_000
    assert get(numbers.to_long_saturating(F.lit(1e300))) == 2**63 - 1
    assert get(numbers.half_decode(numbers.half_encode(F.lit(1.5)))) == 1.5
    assert get(ids.from_base36(ids.base36(F.lit(123456789012345)))) == 123456789012345
    assert get(ids.interleave(F.lit(1).cast("long"), F.lit(2).cast("long"))) == 0b0110


def test_sketches(spark):
    df = spark.range(100_000).withColumnRenamed("id", "x")
    got = sketch.estimate(sketch.distinct_sketch(df, [], "x")).first()[0]
    assert abs(got - 100_000) <= 6 * 1.04 / 128 * 100_000
    small = spark.range(2000).withColumnRenamed("id", "x")
    probe = sketch.bloom_contains(small, "x", sketch.bloom(small.where("x < 1000"), "x"))
    assert probe.where("x < 1000 and not maybe").count() == 0
    assert probe.where("x >= 1000 and maybe").count() <= 10


def test_segmented_lru_demotes_before_it_evicts():
    c = cache.SegmentedLRU(2)
    assert c.access("a") == (False, [])
    assert c.access("a") == (True, [])
    assert c.access("b") == (False, [])
    assert c.access("c") == (False, ["b"])
    assert c.at == {"a": 1, "c": 0}


def test_placement_is_stable(spark):
    nodes = spark.createDataFrame([(i, 1) for i in range(5)], "node_id long, weight int")
    k = spark.range(300).withColumnRenamed("id", "k")
    before = {r[0]: r[2] for r in placement.rendezvous(k, "k", nodes, 1).collect()}
    after = {r[0]: r[2] for r in placement.rendezvous(k, "k", nodes.where("node_id != 3"), 1).collect()}
    assert all(before[x] == after[x] for x in before if before[x] != 3)


def test_durable_store(spark, tmp_path):
    db = store.Durable(spark, str(tmp_path), "k", "k bigint, v string")
    put = lambda r: spark.createDataFrame([(k, v, op, n) for k, v, op, n in r], "k bigint, v string, op string, lsn bigint")
    assert db.recover().count() == 0
    assert db.append(1, put([(1, "a", "put", 1), (2, "b", "put", 2)]))
    assert not db.append(1, put([(9, "z", "put", 9)]))
    db.snapshot()
    db.append(2, put([(2, None, "del", 3), (3, "c", "put", 4)]))
    assert rows(db.recover(), "k", "v") == [(1, "a"), (3, "c")]
    bad = put([(1, "broken", "put", 5)]).withColumn("crc", F.lit(1).cast("long"))
    bad.write.parquet(f"{tmp_path}/log/b=3")
    assert rows(db.recover(), "k", "v") == [(1, "a"), (3, "c")]
    with pytest.raises(Exception, match="checksum"):
        db.recover(strict=True).collect()


def test_base36_places_every_event(spark, tmp_path):
    """5,000 events, none in the order of its id, some with the same id: all are placed by their text as by their number."""
    from lattica.plans.registry import QUERIES

    stamps = [((k * 7919) % 5000 // 2 * 37, k) for k in range(5000)] + [(0, k + 2**20) for k in range(3)] + [(0, k) for k in range(3)]
    df = spark.createDataFrame([(i, m) for m, i in stamps], "event_id long, m long")
    df.selectExpr("event_id", "timestamp_millis(1700000000000 + m) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["id64_base36_all"](spark, str(tmp_path)).collect()
    want = sorted((1700000000000 + m) % 2**42 * 2**20 + i % 2**20 for m, i in stamps)
    assert sorted(r["id"] for r in got) == want
    assert all(r["place"] == bisect.bisect_left(want, r["id"]) + 1 and r["n"] == 13 for r in got)


def test_arrays_at_their_ends(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    a, empty, none = F.array(*[F.lit(x) for x in (4, 7, 7, 9)]), F.array().cast("array<int>"), F.lit(None).cast("array<int>")
    assert [get(arrays.get(a, k)) for k in (0, 3, -1, -4, 4, -5)] == [4, 9, 9, 4, None, None]
    assert get(arrays.find(a, 7)) == 1 and get(arrays.find(a, 7, start=2)) == 2 and get(arrays.find(a, 8)) is None and get(arrays.find(empty, 1)) is None
    assert get(arrays.find_last(a, 7)) == 2 and get(arrays.find_last(a, 1)) is None
    assert get(arrays.insert(a, 4, F.lit(1))) == [4, 7, 7, 9, 1] and get(arrays.insert(a, 5, F.lit(1))) == [4, 7, 7, 9]
    assert get(arrays.insert_sorted(empty, F.lit(3))) == [3] and get(arrays.insert_sorted(a, F.lit(7))) == [4, 7, 7, 7, 9]
    assert get(arrays.delete(a, -2, 9)) == [4, 7] and get(arrays.delete(a, 7)) == [4, 7, 7, 9]
    assert get(arrays.replace(a, 9, 1)) == [4, 7, 7, 9] and get(arrays.increment(a, -4, 1)) == [5, 7, 7, 9]
    assert get(arrays.push_tail(none, F.lit(1))) is None and get(arrays.delete_head(a, 9)) == []


def test_lists_of_any_length(spark):
    df = spark.createDataFrame([("a", i, 10 * i) for i in range(4)] + [("b", 0, 5)], "g string, pos long, value long")
    whole = lambda d: {g: [v for _, _, v in sorted(r for r in map(tuple, d.collect()) if r[0] == g)] for g in ("a", "b", "c")}
    new = spark.createDataFrame([("a", 1, 71), ("a", 2, 72), ("c", 1, 73)], "g string, o long, value long")
    assert whole(lists.push_tail(df, new, "g", "o")) == {"a": [0, 10, 20, 30, 71, 72], "b": [5], "c": [73]}
    assert whole(lists.push_head(df, new, "g", "o")) == {"a": [72, 71, 0, 10, 20, 30], "b": [5], "c": [73]}
    assert whole(lists.insert(df, new.withColumn("at", F.lit(99)), "g", "at", "o")) == {"a": [0, 10, 20, 30, 71, 72], "b": [5], "c": [73]}
    assert whole(lists.rotate(df, "g", -1)) == {"a": [10, 20, 30, 0], "b": [5], "c": []}
    assert whole(lists.pop(df, "g", 9)[1]) == {"a": [], "b": [], "c": []}


def test_scored_upserts_keep_whole_numbers_exact(spark):
    make = lambda x: spark.createDataFrame(x, "g string, member string, score long")
    old, new = make([("s", "a", 2**53 + 1), ("s", "b", 5)]), make([("s", "a", 2), ("s", "c", 9)])
    got = lambda mode: {r["member"]: r["score"] for r in scored.add(old, new, ["g"], "score", "member", mode).collect()}
    assert got("set") == {"a": 2, "b": 5, "c": 9} and got("nx") == {"a": 2**53 + 1, "b": 5, "c": 9}
    assert got("xx") == {"a": 2, "b": 5} and got("incr") == {"a": 2**53 + 3, "b": 5, "c": 9}


def test_order_numbers_ties_nulls_and_small_tables(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, *range(9)]), i) for i in range(300)]
    df = spark.createDataFrame(data, "k int, i int").repartition(7)
    for desc in (False, True):
        want = sorted(data, key=lambda r: (r[0] is not None, (r[0] or 0) * (-1 if desc else 1), r[1] * (-1 if desc else 1)))
        got = sorted((r["p"], r["k"], r["i"]) for r in order.numbered(df, "k", "p", ["i"], desc=desc).collect())
        assert got == [(p, k, i) for p, (k, i) in enumerate(want)]
    sums = order.running_sum(df.where("k is not null"), "k", "i", "s", ["i"])
    assert sums.agg(F.max("s")).first()[0] == sum(i for k, i in data if k is not None)
    assert order.numbered(df.where("false"), "k", "p").count() == 0


def test_range_aggregates_match_plain_loops(spark):
    rng = random.Random(5)
    held = {i: rng.randint(-50, 50) for i in rng.sample(range(3000), 900)}
    df = spark.createDataFrame(list(held.items()), "idx long, v long")
    asked = [(q, *sorted(rng.sample(range(-50, 3200), 2))) for q in range(60)] + [(60, 9, 3), (61, 5000, 6000), (62, 7, 7)]
    for how, fold in (("sum", sum), ("min", min), ("max", max)):
        got = prefix.range_aggregate(df, spark.createDataFrame(asked, "q int, lo long, hi long"), "idx", "v", how, block=64).collect()
        for r in got:
            own = [v for i, v in held.items() if r["lo"] <= i <= r["hi"]]
            assert r["result"] == (fold(own) if own else 0 if how == "sum" else None)
        assert len(got) == len(asked)


def test_glob_shell_and_natural_order(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    for pattern, word, want in (("h[a-e]llo", "hello", True), ("h[^e]llo", "hello", False), (r"a\*b", "a*b", True), (r"a\*b", "axb", False), ("[]", "[]", True), ("x?z*", "xyz", True), ("a.c", "abc", False), ("[a-]x", "-x", True)):
        assert get(text.glob(F.lit(word), pattern)) is want, (pattern, word)
    import shlex

    for line in ("a b  c", "'x y' \"p q\"z", r'say \"hi\" "a\"b" c\ d', "", "  ", "''", 'e"" f'):
        assert get(text.shell_split(F.lit(line))) == shlex.split(line), line
    assert get(text.shell_split(F.lit("open 'quote"))) is None
    names = ["a2", "a10", "a1", "b", "a02b", "a2b", ""]
    keys_ = {n: get(text.natural_key(F.lit(n))) for n in names}
    assert sorted(names, key=keys_.get)[:3] == ["", "a1", "a2"] and keys_["a10"] > keys_["a2b"]
    for char in "aé日😀":
        assert get(text.code_point(F.encode(F.lit(char), "UTF-8"))) == ord(char)
        assert bytes(get(text.code_point_bytes(F.lit(ord(char))))) == char.encode()
    assert get(text.code_point_bytes(F.lit(0xD800))) is None and get(text.char_index(F.lit("aé日x"), 3)) == 2


def test_exact_numbers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    for x, digits in ((2.65645, 4), (0.5, 0 + 1), (1234567.125, 2), (-3.14159, 3), (0.0, 4), (999.99995, 4), (2.5e-5, 4), (1e-9, 4)):
        assert get(numbers.fixed(F.lit(x), digits)).lstrip("-") == f"{abs(x):.{digits}f}"
    big = 2**53
    assert get(numbers.compare_exact(F.lit(big + 1), F.lit(float(big)))) == 1 and get(numbers.compare_exact(F.lit(5), F.lit(5.5))) == -1
    assert get(numbers.compare_exact(F.lit(-(2**63)), F.lit(float("-inf")))) == 1 and get(numbers.compare_exact(F.lit(1), F.lit(float("nan")))) == -1
    assert str(get(numbers.parse_unsigned(F.lit(str(2**64 - 1))))) == str(2**64 - 1) and get(numbers.parse_unsigned(F.lit(str(2**64)))) is None
    assert get(numbers.parse_radix(F.lit("0x1F"))) == 31 and get(numbers.parse_radix(F.lit("017"))) == 15 and get(numbers.parse_radix(F.lit("19"))) == 19
    assert get(numbers.parse_any_double(F.lit("-INF"))) == float("-inf") and get(numbers.parse_any_double(F.lit("x"))) is None
    assert get(numbers.half_decode(numbers.half_encode(F.lit(None).cast("double")))) is None
    assert get(numbers.brain_decode(numbers.brain_encode(F.lit(3.140625)))) == 3.140625


def test_products(spark):
    df = spark.createDataFrame([(1, 2)] * 62 + [(2, -3), (2, -3), (2, 1), (3, 0), (3, 7)] + [(4, 2)] * 70 + [(5, -1)] * 3, "g int, v long")
    assert rows(series.products(df, "g", "v").where("g != 4"), "g", "product") == [(1, 2**62), (2, 9), (3, 0), (5, -1)]
    assert series.products(df, "g", "v").where("g = 4").first()["product"] is None


def test_update_streams_keep_the_last_row_of_every_key(spark, tmp_path):
    """One file a batch: keys of earlier batches stay in the result."""
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k, 10), (9, k)], "key long, v long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key long, v long").option("maxFilesPerTrigger", 1).parquet(source)
    got = flows.drain(stream.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "update", str(tmp_path), ["key"])
    assert rows(got, "key", "n") == [(0, 1), (1, 1), (2, 1), (9, 3)]


def test_timers_fire_by_the_watermark_and_stop_when_idle(spark, tmp_path):
    source = str(tmp_path / "in")
    stamps = [[(1, 100), (2, 600)], [(1, 1000), (1, 1600)], [(2, 9_100)], [(2, 20_000)]]
    seen = set()
    for k, batch in enumerate(stamps):
        df = spark.createDataFrame(batch, "key long, ms long").select("key", F.timestamp_millis("ms").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        for f in set(os.listdir(source)) - seen:  # files are taken in the order of their times
            os.utime(f"{source}/{f}", (1_600_000_000 + 60 * k,) * 2)
        seen = set(os.listdir(source))
    stream = spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    got = rows(flows.drain(flows.firing(stream, "ts", "key", 1000, "0 seconds"), "append", str(tmp_path)), "key", "fired_at", "count")
    assert got == [(1, 1100, 2), (1, 2100, 1), (2, 1600, 1), (2, 10_100, 1)]
    stream = spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    got = rows(flows.drain(flows.lapsing(stream, "ts", "key", 1000, "0 seconds"), "append", str(tmp_path)), "key", "writes", "lapsed_at")
    assert got == [(1, 3, 2600), (2, 1, 1600), (2, 1, 10_100)]


def test_node_changes(spark):
    nodes = spark.createDataFrame([(1, 1, "up", 0), (2, 2, "up", 1)], "node_id long, weight int, state string, rack int")
    log = spark.createDataFrame([(1, "remove", 1, None, None, None), (2, "state", 1, None, "down", None), (3, "add", 3, 5, "up", 2), (4, "state", 3, None, "down", None), (5, "state", 3, None, "up", None), (6, "state", 2, None, "down", None)], "version long, op string, node_id long, weight int, state string, rack int")
    got = rows(placement.with_changes(nodes, log), "node_id", "weight", "state", "rack", "version")
    assert got == [(2, 2, "down", 1, 6), (3, 5, "up", 2, 5)]
    keys_ = spark.range(50).withColumnRenamed("id", "k")
    placed = placement.ring_replicas(keys_, "k", placement.with_changes(nodes, log), 2)
    assert {r["node_id"] for r in placed.collect()} == {3} and placed.count() == 50


def test_durable_store_compacts_and_verifies(spark, tmp_path):
    db = store.Durable(spark, str(tmp_path), "k", "k bigint, v string")
    put = lambda r: spark.createDataFrame(r, "k bigint, v string, op string, lsn bigint")
    db.append(1, put([(1, "a", "put", 1), (2, "b", "put", 2), (1, "x", "new", 3), (3, "c", "upd", 4), (4, "d", "new", 5), (4, None, "del", 6), (4, "e", "new", 7), (2, "y", "upd", 8)]))
    assert rows(db.recover(), "k", "v") == [(1, "a"), (2, "y"), (4, "e")]
    db.compact()
    assert db.verify() and db._numbers("log") == [] and not db.append(1, put([(9, "z", "put", 99)]))
    db.append(2, put([(None, None, "clear", 20), (7, "late", "put", 19), (8, "kept", "put", 21)]))
    assert rows(db.recover(), "k", "v") == [(8, "kept")]
    spark.createDataFrame([(5, "forged")], "k bigint, v string").write.mode("append").parquet(f"{tmp_path}/snapshot/v=1")
    assert not db.verify()


def test_sliding_windows_cross_blocks(spark):
    rng = random.Random(6)
    v = [rng.randint(-9, 9) for _ in range(60)]
    df = spark.createDataFrame([(3 * i, x) for i, x in enumerate(v)], "idx long, v long")
    want = [(3 * i, sum(w), min(w), max(w)) for i in range(60) for w in [v[max(0, i - 4) : i + 1]]]
    assert rows(prefix.sliding(df, "idx", "v", 4, block=7), "idx", "w_sum", "w_min", "w_max") == want


def test_as_of_carries_values_over_ranges(spark):
    rng = random.Random(7)
    left = [(rng.choice([1, 2, None]), rng.randint(0, 400), i) for i in range(150)]
    right = {(rng.choice([1, 1, 1, 3]), t): rng.choice([None, t * 10]) for t in rng.sample(range(400), 120)}
    df = spark.createDataFrame(left, "k int, at int, i int")
    got = keys.as_of(df, spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k int, at int, v int"), "k", "at", "v")
    want = []
    for k, t, i in left:
        before = [(u, v) for (g, u), v in right.items() if g == k and u <= t and v is not None]
        want.append((i, max(before)[1] if before else -1))
    assert rows(got.select("i", F.coalesce("asof_v", F.lit(-1)).alias("v")), "i", "v") == sorted(want)
