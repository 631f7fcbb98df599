"""From raw documents to token ids: quality filter, line and near-duplicate removal, mixing, encoding.

Each stage takes the documents its predecessor kept and returns documents; the last returns
token ids. Stages are written as Parquet and read again, in ``run`` as by the caller.

Edge cases, in every stage: a null text counts as empty (and stays null where documents are returned,
but for line dedup, which returns the empty text); null ids, sources and languages are values of their own; repeated rows are documents of
their own until near-duplicate removal keeps one; very long texts are read whole; ties are decided by the row,
so reruns agree; an empty table gives an empty result; extra columns are carried, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import byte_bpe, common, line_crf, line_dedup, mixing, ngram_jaccard, sampling

TOKENIZER = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model scores at its threshold or above; it learns from labels outside the held-out fold.

    Without labels of both kinds every score is the share of good ones, so none or all stay. Equal texts get equal scores.
    """
    labels = common.table(spark, sf_dir, "labels")
    model = line_crf.train(docs, labels, sampling.remainder(F.col("doc_id"), 4) != 2)
    scored = line_crf.classify(docs, model, keep_text=True)
    return scored.where(F.col("score") >= line_crf.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; n_chars follows the text. All documents stay, be it with an empty text."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that with the smallest id, of these the one with the smallest key.

    A row's key is a hash of 128 bits of all its columns. Null ids come after all others, and rows
    with a null id that are near copies are a group like any other. Rows that share an id
    are decided one by one. Of equal rows one stays, except that rows without a shingle
    (null or wordless texts) link with nothing and all stay.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    parts = [F.xxhash64(F.lit(k), *[c.isNull() for c in every], *every).cast("string") for k in range(2)]
    keyed = docs.withColumn("__row", F.concat_ws(":", *parts))
    rows = ngram_jaccard.join(keyed.select("doc_id", "text", "__row"), with_component=True).where("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")
    found = common.cut(rows.groupBy("component", "doc_id", "__row").agg(F.count(F.lit(1)).alias("n")))
    first = common.cut(found.groupBy("component").agg(F.min(order).getField("__row").alias("first")))
    judged = found.join(first, "component").select("__row", (F.col("__row") == F.col("first")).alias("stays"), "n")
    judged = common.cut(judged.where("not stays or n > 1"))
    out = keyed.join(judged.select("__row"), "__row", "left_anti").select(*every)
    repeated = keyed.join(judged.where("stays").select("__row"), "__row", "left_semi")
    out = out.union(repeated.dropDuplicates(["__row"]).select(*every))
    return out.select(*every)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, documents that are taken twice being two rows; those without a word are never taken."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids and the tokens' byte offsets of every document of the mixture; an empty text has no id."""
    got = byte_bpe.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path(TOKENIZER))
    return got.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix),
    ("byte-level BPE", encode),
]

#: Classifier scores, keyed shuffles and token ids can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
