"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A store is a folder with three parts, each with one subfolder a batch: a ledger of signed
rows (+1 or -1 document, plus or minus its tokens), totals after the batch, and a marker.
A batch of changes (upsert or delete of a document's count) is turned into signed rows
against what the ledger holds of the same documents; the rows' sums are added to the last
totals. The marker is written last. Batches without a marker don't exist for readers and
are written over; a batch that has one is not applied again. Everything is written by
Spark's own writers, so tasks of lost executors are simply run again.

A commit costs what its batch does: the ledger is laid out by buckets of the documents' hash, and only the
buckets that the batch touches are read. Every COMPACT_EVERY batches the ledger is folded into one
base, whose rows are those of the documents counted now, so what is read doesn't grow with history.

Changes are joined to the ledger by document and version, which are spread evenly; sums by
group are partly added up before the shuffle, so one source may hold any share of the rows.

Edge cases: a null text counts 0 tokens and still is a document; null sources and languages
are groups of their own; of several changes to one document and version in a batch the last
in order of ``seq`` counts; on a tie upserts win over deletes, then more tokens, then the larger source and
language; equal rows are one change; deletes of unknown documents do nothing; all rows with a null
document id are one document; very long texts are counted whole; an empty batch only adds a marker; extra columns of the changes are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GROUP = ("source", "lang", "version")
LEDGER = "doc_id {id}, version string, source string, lang string, docs bigint, tokens bigint, bucket int"
#: Buckets of the ledger, and batches after which it is folded.
BUCKETS, COMPACT_EVERY = 64, 8


class Rollup:
    """One store under ``path``."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint") -> None:
        self.spark, self.path, self.ledger_schema = spark, path, LEDGER.format(id=id_type)

    def committed(self) -> list[int]:
        """Numbers of the committed batches."""
        return self._numbers("commits")

    def _numbers(self, part: str) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/{part}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName().removeprefix("batch=")) for p in found if fs.exists(hadoop.Path(p, "_SUCCESS")))

    def _read(self, part: str, batches: list[int], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.path}/{part}").parquet(*[f"{self.path}/{part}/batch={b}" for b in batches])
        return rows.drop("batch")

    def _bases(self) -> list[int]:
        """Batches up to which the ledger is folded in a finished base."""
        return self._numbers("base")

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """The documents counted now: one row for each document and version, of all or some buckets."""
        done, bases = self.committed(), [b for b in self._bases() if b in self.committed()]
        rows = self._read("ledger", [b for b in done if not bases or b > bases[-1]], self.ledger_schema)
        if bases:
            rows = rows.unionByName(self._read("base", bases[-1:], self.ledger_schema))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy("doc_id", *GROUP, "bucket").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs > 0")

    def compact(self) -> None:
        """Fold the ledger of the committed batches into a base. Older parts are no longer read."""
        if done := self.committed():
            self._write(self.ledger(), "base", done[-1])

    def _write(self, rows: DataFrame, part: str, batch: int) -> None:
        # one file a bucket: rows of a bucket meet in one task, which documents' hashes keep even
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{part}/batch={batch}")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens after the last committed batch."""
        done = self.committed()
        return self._read("totals", done[-1:], "source string, lang string, version string, n_docs bigint, n_tokens bigint")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, source, lang, version, n_tokens, op, seq); false if the batch was applied before."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} is older than the last one, {done[-1]}")
        if "seq" not in changes.columns:
            changes = changes.withColumn("seq", F.lit(0))
        upsert = F.col("op") != "delete"
        rank = F.struct("seq", upsert.alias("upsert"), F.when(upsert, F.coalesce("n_tokens", F.lit(0))).alias("tokens"), F.col("source").alias("source"), F.col("lang").alias("lang"))
        wanted = changes.groupBy("doc_id", "version").agg(F.max(rank).alias("r"))  # merged before the shuffle
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        wanted = common.cut(wanted.select("doc_id", "version", "r.source", "r.lang", "r.upsert", F.col("r.tokens").cast("long").alias("tokens"), bucket))
        touched = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
        ledger, keys = self.ledger(touched), wanted.select(F.col("doc_id").alias("__id"), F.col("version").alias("__v"))
        old = ledger.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("version").eqNullSafe(F.col("__v")), "left_semi")
        names = ("doc_id", "version", "source", "lang", "docs", "tokens", "bucket")
        signed = old.select("doc_id", "version", "source", "lang", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"), "bucket")
        fresh = wanted.where("upsert").withColumn("docs", F.lit(1).cast("long")).select(*names)
        self._write(signed.select(*names).union(fresh), "ledger", batch)
        common.drop(wanted)
        delta = self._read("ledger", [batch], self.ledger_schema).groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        totals = self.totals().unionByName(delta).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0")
        totals.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        marker = self.spark.range(0, 1, 1, 1).select(F.lit(batch).alias("batch"))
        marker.write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        since = [b for b in done if not (bases := self._bases()) or b > bases[-1]]
        if len(since) + 1 >= COMPACT_EVERY:
            self.compact()
        return True


def counts(docs: DataFrame, tokens, version: str, op: str = "upsert", id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Changes of ``docs``: its ids, sources, languages and ``tokens`` (a Column) under ``version``."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"), F.lit(version).alias("version"), tokens.cast("long").alias("n_tokens"), F.lit(op).alias("op"))


def new_store(spark: SparkSession) -> Rollup:
    import uuid

    return Rollup(spark, f"{common.shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
