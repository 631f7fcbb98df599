"""Reading tables, JSON emission, and a durable store: snapshot plus change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object a row, keys in order, nulls left out."""
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def json_array(df: DataFrame, column: str, distinct: bool = False) -> DataFrame:
    """Arrays as JSON arrays; a set loses its repeats."""
    return df.withColumn(column, F.to_json(F.array_distinct(column) if distinct else F.col(column)))


def json_map(df: DataFrame, key: str, value: str, name: str = "json") -> DataFrame:
    """One JSON object with a single key a row: keys are text whatever their type."""
    return df.withColumn(name, F.to_json(F.create_map(F.col(key).cast("string"), F.col(value))))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one string."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


class Durable:
    """A keyed table as versions of a snapshot and a log of changes.

    Layout under ``path``: snapshot/v=N, log/b=N and current/p=N (a pointer, written last).
    A change has the key, the columns, op, lsn and a checksum over all of these. Ops:
    'put' writes a row, 'del' removes it, 'upd' writes it only where the key is present, 'new' only
    where it is absent, 'clear' (null key) removes every row of a smaller lsn. Recovery takes the pointed
    snapshot and folds the later changes by key and lsn; rows with a wrong checksum are
    skipped, or fail the recovery if ``strict``. A snapshot keeps its rows' number and a sum of their checksums.
    """

    #: Compaction is due when the log has more bytes than this, or than so many times the snapshot.
    LOG_BYTES, LOG_RATIO = 64 << 20, 2.0

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str) -> None:
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def _numbers(self, part: str) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/{part}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))

    def columns(self) -> list[str]:
        return [c for c in self.spark.createDataFrame([], self.schema).columns]

    def checksum(self):
        return F.crc32(F.to_json(F.struct(*self.columns(), "op", "lsn")).cast("binary"))

    def append(self, batch: int, changes: DataFrame) -> bool:
        """Add a batch of changes; false if the batch is there already, or went into the snapshot."""
        pointers = self._numbers("current")
        folded = self.spark.read.parquet(f"{self.path}/current/p={pointers[-1]}").first()["batch"] if pointers else -1
        if batch <= folded or batch in self._numbers("log"):
            return False
        changes.withColumn("crc", self.checksum()).write.mode("overwrite").parquet(f"{self.path}/log/b={batch}")
        return True

    def log(self, after: int = -1) -> DataFrame:
        batches = [b for b in self._numbers("log") if b > after]
        schema = f"{self.schema}, op string, lsn bigint, crc bigint"
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/log/b={b}" for b in batches])

    def recover(self, strict: bool = False) -> DataFrame:
        """The table now."""
        pointers = self._numbers("current")
        base, after = self.spark.createDataFrame([], self.schema), -1
        if pointers:
            at = self.spark.read.parquet(f"{self.path}/current/p={pointers[-1]}").first()
            base, after = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshot/v={at['version']}"), at["batch"]
        log = self.log(after)
        good = F.col("crc") == self.checksum()
        if strict:
            log = log.withColumn("op", F.when(good, F.col("op")).otherwise(F.raise_error(F.lit("a change has a wrong checksum"))))
        log = log.where(good)
        rows = base.select(*self.columns(), F.lit("put").alias("op"), F.lit(-1).cast("bigint").alias("lsn")).unionByName(log.drop("crc"))
        cleared = F.coalesce(log.where("op = 'clear'").agg(F.max("lsn").alias("at")).scalar(), F.lit(-2).cast("bigint"))
        rows = rows.where((F.col("op") != "clear") & (F.col("lsn") > cleared))
        rest = [c for c in rows.columns if c != self.key]
        # whether the key is there before a change hangs on the last put, del or new before it
        before = Window.partitionBy(self.key).orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
        there = F.coalesce(F.last(F.when(F.col("op").isin("put", "new"), True).when(F.col("op") == "del", False), ignorenulls=True).over(before), F.lit(False))
        applies = F.when(F.col("op") == "upd", F.col("__there")).when(F.col("op") == "new", ~F.col("__there")).otherwise(True)
        conditional = rows.select(self.key).join(rows.where("op in ('upd', 'new')").select(self.key).distinct(), self.key, "left_semi").distinct()
        plain = rows.join(conditional, self.key, "left_anti")
        judged = rows.join(conditional, self.key, "left_semi").withColumn("__there", there).where(applies).drop("__there")
        last = plain.unionByName(judged).groupBy(self.key).agg(F.max_by(F.struct(*rest), "lsn").alias("r")).where("r.op != 'del'")
        return last.select(*[F.col(c) if c == self.key else F.col(f"r.{c}").alias(c) for c in self.columns()])

    def row_sum(self):
        """A sum of the rows' checksums, in any order."""
        return F.coalesce(F.sum(F.crc32(F.to_json(F.struct(*self.columns())).cast("binary"))), F.lit(0))

    def snapshot(self) -> int:
        """Write the table as a new version, then point at it; older versions stay readable."""
        version = max([0, *self._numbers("current")]) + 1
        batch = max([-1, *self._numbers("log")])
        self.recover().write.mode("overwrite").parquet(f"{self.path}/snapshot/v={version}")
        made = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshot/v={version}")
        marks = made.agg(F.count(F.lit(1)).alias("rows"), self.row_sum().alias("crc_sum"))
        marks.select(F.lit(version).alias("version"), F.lit(batch).alias("batch"), "rows", "crc_sum").write.mode("overwrite").parquet(f"{self.path}/current/p={version}")
        return version

    def verify(self) -> bool:
        """Whether the pointed snapshot holds the rows that were written to it."""
        pointers = self._numbers("current")
        if not pointers:
            return True
        at = self.spark.read.parquet(f"{self.path}/current/p={pointers[-1]}").first()
        now = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshot/v={at['version']}").agg(F.count(F.lit(1)).alias("rows"), self.row_sum().alias("crc_sum")).first()
        return (now["rows"], now["crc_sum"]) == (at["rows"], at["crc_sum"])

    def _bytes(self, part: str, numbers: list[int]) -> int:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        prefix = {"log": "b", "snapshot": "v"}[part]
        total = 0
        for n in numbers:
            folder = hadoop.Path(f"{self.path}/{part}/{prefix}={n}")
            total += folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
        return total

    def should_compact(self) -> bool:
        """Whether the log has outgrown its bound or the snapshot."""
        pointers = self._numbers("current")
        log = self._bytes("log", self._numbers("log"))
        return log > self.LOG_BYTES or bool(pointers) and log > self.LOG_RATIO * self._bytes("snapshot", pointers[-1:])

    def compact(self) -> int:
        """A new snapshot; then log batches, snapshots and pointers that it replaces are deleted. Readers must not hold older ones."""
        version, folded = self.snapshot(), self._numbers("log")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        old = [f"log/b={b}" for b in folded] + [f"snapshot/v={v}" for v in self._numbers("snapshot") if v < version] + [f"current/p={p}" for p in self._numbers("current") if p < version]
        for name in old:
            folder = hadoop.Path(f"{self.path}/{name}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return version
