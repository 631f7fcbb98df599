"""Helpers shared by the text operators: words, ASCII lower case, lineage cuts, joins."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters that are none of these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as array<string>; null and blank texts have none."""
    return F.filter(F.split(text_or_empty(text), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is the fast path. It is exact where the other characters are left alone by
    it, which is tested on those characters only; the rest take ``translate``.
    """
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    plain = (F.octet_length(text) == F.length(text)) | (F.lower(other) == other)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """This session's folder in the one that ``spark.checkpoint.dir`` names, which all executors share.

    Only a local session, as in tests, gets a temporary folder where that is unset; on a
    cluster such a folder would be another one on each machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lattica-"))
    return sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a table written to the shared folder and read again. ``drop`` deletes it."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` wrote. What was made of them must have been cut itself."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, text_col: str, id_col: str | None = None, nulls: bool = False) -> DataFrame:
    """__id (if named), __text (a null is empty unless ``nulls``) and __rest, a struct of all other columns, so that none can clash with an operator's own."""
    rest = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col) and not isinstance(f.dataType, T.NullType)]
    rest = F.struct(*rest) if rest else F.lit(None).cast("int")
    text = F.col(f"`{text_col}`")
    first = [F.col(f"`{id_col}`").alias("__id")] if id_col else []
    return docs.select(*first, (text.cast("string") if nulls else text_or_empty(text)).alias("__text"), rest.alias("__rest"))


def unpacked(docs: DataFrame, text_col: str, made: dict[str, Column], id_col: str | None = None, text: Column | None = None) -> list[Column]:
    """What to select of a packed frame: the columns of ``docs`` in their order, the text only if given, then ``made``, which replaces columns of its names."""
    out = []
    for f in docs.schema:
        if f.name == id_col:
            out.append(F.col("__id").alias(f.name))
        elif f.name == text_col:
            out += [] if text is None else [text.alias(f.name)]
        elif f.name not in made:
            out.append((F.lit(None) if isinstance(f.dataType, T.NullType) else F.col("__rest").getField(f.name)).alias(f.name))
    return out + [c.alias(name) for name, c in made.items()]


def with_fields(df: DataFrame, names: list[str], ddl: str) -> T.StructType:
    """The schema of the columns ``names`` of ``df`` and then those of ``ddl``."""
    fields = {f.name: f for f in df.schema}
    return T.StructType([fields[n] for n in names] + T.StructType.fromDDL(ddl).fields)


#: Bits of a membership filter at most (16 MB) and for each key.
MEMBER_BITS, BITS_A_KEY = 1 << 27, 16
#: Where in a 64-bit key its probes begin.
_PROBES = (0, 18, 37)


def members(keys: DataFrame):
    """A broadcast Bloom filter of ``keys`` (one column of 64-bit hashes), of 2 MB a million keys and 16 MB at most, for ``is_member``.

    A filter that is too small for its keys only lets more rows through to the exact join after it.
    """
    (name,) = keys.columns
    bits = min(MEMBER_BITS, 1 << max(16, (BITS_A_KEY * keys.count() - 1).bit_length()))
    place = F.explode(F.array(*[F.shiftrightunsigned(name, k).bitwiseAND(F.lit(bits - 1)) for k in _PROBES]))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    filled = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()
    filled[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(filled)


def is_member(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` (int64) may be among those of the filter."""
    found, keys = np.ones(len(keys), bool), keys.view(np.uint64)
    for k in _PROBES:
        place = (keys >> np.uint64(k)) & np.uint64(64 * len(filled) - 1)
        found &= (filled[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


#: Bytes of a narrow table that may be broadcast. They are counted before each use.
BROADCAST_BYTES = 8 << 20


def attach(big: DataFrame, small: DataFrame, key: str, salt_by: str, salts: int = 32, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of ``small`` (one row a key, already cut, numbers beside the key) to ``big`` on a null-safe key.

    Broadcast if ``small`` has at most ``most_bytes``. Beyond that both sides are
    salted, so that a key holding a third of ``big`` is spread over ``salts`` tasks.
    """
    right = small.withColumnRenamed(key, "__key")
    size = small.agg(F.sum(F.lit(16 * len(small.columns)) + F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)))).first()[0] or 0
    if size <= most_bytes:
        return big.join(F.broadcast(right), big[key].eqNullSafe(right["__key"]), "left").drop("__key")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("__salt0", F.pmod(F.xxhash64(F.col(salt_by)), F.lit(salts)).cast("int"))
    on = left[key].eqNullSafe(right["__key"]) & (left["__salt0"] == right["__salt"])
    return left.join(right, on, "left").drop("__key", "__salt", "__salt0")
