"""Queries whose sketches and units depend on the number or size of keys, against their SQL on tables of many keys."""

import duckdb
from pyspark.sql import functions as F

from lattica.functions import numbers
from lattica.plans.registry import ORACLE, QUERIES


def same(spark, folder, name, table, frame):
    frame.write.parquet(f"{folder}/{table}.parquet")
    got = QUERIES[name](spark, str(folder)).toPandas()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = c.sql(ORACLE[name]).df()[list(got.columns)]
    key = list(got.columns)
    return got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()


def test_bloom_filter_grows_with_its_members(spark, tmp_path):
    assert same(spark, tmp_path, "bloom_membership", "customer", spark.range(300_000).withColumnRenamed("id", "c_custkey"))


def test_count_min_sketch_grows_with_its_keys(spark, tmp_path):
    assert same(spark, tmp_path, "cms_counts", "lineitem", spark.range(180_000).selectExpr("id % 60000 AS l_suppkey"))


def test_amounts_beyond_the_largest_unit(spark, tmp_path):
    assert same(spark, tmp_path, "bytes_human", "orders", spark.sql("SELECT explode(array(0, 5, 6, 181, 188329, 188330, 188331, 6026538, 9000000, 545460846)) AS k").selectExpr("cast(k AS bigint) AS o_orderkey"))
    human = numbers.bytes_to_human(F.col("id") * (1 << 40))
    assert [r[0] for r in spark.range(1, 2048, 1023).select(human).collect()] == ["1.00000 TiB", "1.00000 PiB", "1.99902 PiB"]
