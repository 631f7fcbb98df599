"""Dictionary encoding, reference counts and the search index built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code, refs): dense codes in value order and reference counts; only distinct values are ordered."""
    refs = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("refs"))
    return numbered(refs, "value", "code").select("value", "code", "refs")


def encode(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    return df.join(words.select(F.col("value").alias(column), "code"), column).drop(column)


def release(words: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The dictionary after references are dropped; values without references go."""
    less = gone.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("less"))
    left = words.join(less, "value", "left").withColumn("refs", F.col("refs") - F.coalesce("less", F.lit(0)))
    return left.where("refs > 0").drop("less")


def terms(text):
    """Lower-cased words over 2 characters, split at white space and . , ; : ! ?"""
    return F.filter(F.split(F.lower(text), r"[ \t\n.,;:!?]+"), lambda w: F.char_length(w) > 2)


def inverted_index(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(term, doc, freq, first_pos): counted per document before the shuffle by term."""
    placed = docs.select(doc, F.posexplode(terms(F.col(text))).alias("pos", "term"))
    return placed.groupBy("term", doc).agg(F.count(F.lit(1)).alias("freq"), F.min("pos").cast("long").alias("first_pos"))


def search(index: DataFrame, doc: str, query: list[str]) -> DataFrame:
    """(doc, hits, freq): documents with any of the terms."""
    return index.where(F.col("term").isin(query)).groupBy(doc).agg(F.count(F.lit(1)).alias("hits"), F.sum("freq").alias("freq"))


def smallest_free(words: DataFrame) -> DataFrame:
    """One row, free_code: the smallest code from 0 on that no value holds. A code's successor is looked up, so no order of all codes is made."""
    codes = words.select("code")
    after = codes.select((F.col("code") + 1).alias("code")).union(words.sparkSession.range(1).toDF("code"))
    return after.join(codes, "code", "left_anti").agg(F.min("code").alias("free_code"))
