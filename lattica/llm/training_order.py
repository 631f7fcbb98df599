"""Training-order materialisation: a keyed permutation places every sequence in a global slot.

Token ids of documents are cut into sequences of ``length`` ids, the last one padded. The
sequences are numbered 0 .. n-1 in order of document id; a keyed Feistel network over a
domain slightly larger than n, walked along its cycle until it falls below n, is a bijection
of 0 .. n-1, so slots need no sort of random keys, no state and no coordination. Slots are
range-partitioned into shards of ``per_shard`` records of fixed size. A reader finds slot s
in shard s // per_shard at byte (s % per_shard) * stride, and resumes from a slot alone.

Numbering takes two levels: totals of fixed partitions of the range-sorted documents (one
row a partition) and running totals inside them, so no task sees all documents.

Shards are files of raw little-endian 16-bit ids, a record being ``length`` ids and one 0.
They are written by Spark's own text sink, whose record separator is that 0; so they can be
on any store, and lost tasks are written again. Shards of one key and input are the same
bytes whenever they are written.

Edge cases: null ids or texts give one sequence that holds the end-of-document id only; repeated rows are sequences of their own; documents with a null id come first; very long
texts are cut whole, block by block; an empty table gives no shard; extra columns are carried to the index, whatever their names, and replaced where they
clash with results; ids must fit in 16 bits beside the two special ones, which given ids are raised by.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .npbytes import BLOCK, IS_SPACE, blocks, hashes, runs, tidy

LENGTH = 512
PER_SHARD = 8192
KEY = 20240607
ROUNDS = 4
#: Ids below this are kept for padding (0) and the end of a document (1).
SPECIAL = 2
VOCABULARY = 65536
#: The modulus of the round function, a prime, and the unrolled steps of the walk.
PRIME = 2147483647
WALK = 64


def round_keys(key: int, rounds: int = ROUNDS) -> list[int]:
    """A 31-bit odd number for each round, from the key by a fixed mixing rule."""
    out, x = [], key & 0x7FFFFFFF
    for k in range(rounds):
        x = (x * 1103515245 + 12345 + k) & 0x7FFFFFFF
        out.append(x | 1)
    return out


def halves(n: int) -> tuple[int, int]:
    """(A, B) with A * B >= n, about equal, and A * B - n < A: the network's domain is Z_A x Z_B."""
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-max(n, 1) // a))


def _once(x: Column, a: int, b: int, keys: list[int]) -> Column:
    right = x % F.lit(b)
    left = ((x - right) / F.lit(b)).cast("long")
    for k, key in enumerate(keys):
        seen = right if k % 2 == 0 else left
        mixed = ((seen + F.lit(key % 65521)) * F.lit(key)) % F.lit(PRIME)
        mixed = mixed + (mixed - mixed % F.lit(65536)) / F.lit(65536)
        if k % 2 == 0:
            left = (left + mixed.cast("long")) % F.lit(a)
        else:
            right = (right + mixed.cast("long")) % F.lit(b)
    return left * F.lit(b) + right


def permute(df: DataFrame, index: str, slot: str, n: int, key: int = KEY) -> DataFrame:
    """Adds ``slot``, a bijection of 0 .. n-1 applied to the long column ``index``.

    The domain has fewer than A of A * B places outside 0 .. n-1, so a step of the walk
    leaves it with a chance of 1 - 1 / B, and after A steps at the latest. WALK steps are
    unrolled in an array fold; should a walk be longer, the query fails and no slot is wrong.
    """
    a, b = halves(n)
    once = lambda x: _once(x, a, b, round_keys(key))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("__x"), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    out = df.withColumn("__x", once(F.col(index))).withColumn(slot, F.when(F.col("__x") < n, F.col("__x")).otherwise(walked)).drop("__x")
    return out.withColumn(slot, F.when(F.col(slot) < n, F.col(slot)).otherwise(F.raise_error(F.lit("the permutation's walk did not end")).cast("long")))


def invert(slot: int, n: int, key: int = KEY) -> int:
    """The index placed at a slot: what a reader needs to trace a record."""
    a, b = halves(n)
    x = slot
    while True:
        left, right = divmod(x, b)
        for k, own in reversed(list(enumerate(round_keys(key)))):
            seen = right if k % 2 == 0 else left
            mixed = (seen + own % 65521) * own % PRIME
            mixed += mixed // 65536
            if k % 2 == 0:
                left = (left - mixed) % a
            else:
                right = (right - mixed) % b
        x = left * b + right
        if x < n:
            return x


def _cut(length: int, hashed: bool):
    """Texts (hashed words) or lists of ids to records: id, place in the document, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, ids, first in _hashed(batch.column("__in")) if hashed else _listed(batch.column("__in")):
                rows, places, records = [], [], []
                for i in range(end - begin):
                    own = ids[first[i] : first[i + 1]]
                    for place, a in enumerate(range(0, len(own), length)):
                        piece = own[a : a + length]
                        rows.append(begin + i)
                        places.append(place)
                        records.append(np.pad(piece, (0, length - len(piece))).astype("<u2").tobytes())
                own_ids = batch.column("__rid").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([own_ids, pa.array(places, pa.int64()), pa.array(records, pa.binary())], ["__rid", "__rno", "record"])

    return tidy(run)


def _hashed(column: pa.Array):
    """Ids of words by hash, then the end-of-document id."""
    for begin, end, data, offsets in blocks(column, BLOCK):
        start, stop, text = runs(~IS_SPACE[data], offsets)
        own = (hashes(data, start, stop) % np.uint64(VOCABULARY - SPECIAL)).astype(np.int64) + SPECIAL
        counts = np.bincount(text, minlength=end - begin) + 1
        first = np.concatenate(([0], np.cumsum(counts)))
        ids = np.ones(first[-1], np.int64)
        ids[np.arange(len(own)) + text] = own
        yield begin, end, ids, first


def _listed(column: pa.Array):
    """Given ids, raised by SPECIAL so that none is taken for padding or an end, then the end-of-document id."""
    for i, own in enumerate(column):
        ids = np.array([*(x + SPECIAL for x in own.as_py() or []), 1], np.int64)
        if ids[:-1].min(initial=SPECIAL) < SPECIAL or ids.max() >= VOCABULARY:
            raise ValueError("an id does not fit in 16 bits beside the special ones")
        yield i, i + 1, ids, np.array([0, len(ids)])


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", ids_col: str | None = None, length: int = LENGTH) -> DataFrame:
    """(__rid, __rno, record): id, place in the document and bytes of each sequence. Ids come from ``ids_col`` or from hashed words."""
    taken = F.col(f"`{ids_col}`") if ids_col else common.text_or_empty(F.col(f"`{text_col}`"))
    whole = docs.select(F.col(f"`{id_col}`").alias("__rid"), taken.alias("__in"))
    return whole.mapInArrow(_cut(length, ids_col is None), common.with_fields(whole, ["__rid"], "__rno bigint, record binary"))


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", ids_col: str | None = None, length: int = LENGTH) -> DataFrame:
    """A row for each sequence: carried columns, seq_no and n_tokens; only counts are taken of texts or ids, no record is made."""
    source = ids_col or text_col
    n = F.greatest(F.size(F.coalesce(F.col(f"`{ids_col}`"), F.array().cast(docs.schema[ids_col].dataType))), F.lit(0)) if ids_col else common.n_words(F.col(f"`{text_col}`"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (source, id_col)]
    counted = common.cut(docs.select(F.col(f"`{id_col}`").alias("__id"), (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("__rest"), (n + 1).cast("long").alias("__n")))
    placed = counted.select("__id", "__rest", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("__n") - 1, F.lit(length)))).alias("seq_no"))
    return placed.select("__id", "__rest", "seq_no", F.least(F.lit(length).cast("long"), F.col("__n") - F.col("seq_no") * length).alias("n_tokens"))


def place(seqs: DataFrame, key: int = KEY, per_shard: int = PER_SHARD, length: int = LENGTH) -> tuple[DataFrame, int]:
    """``seqs`` (__id, seq_no, ...) with seq_index, slot, shard and byte_offset (the offset in the shard), and the number of sequences."""
    ordered = common.cut(seqs.repartitionByRange(_parts(seqs), "__id", "seq_no").withColumn("__part", F.spark_partition_id()))
    totals = common.cut(ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")))
    n = totals.agg(F.sum("n")).first()[0] or 0
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    ahead = totals.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy("__part").orderBy(F.col("__id").asc_nulls_first(), "seq_no")
    out = ordered.join(F.broadcast(ahead), "__part").withColumn("seq_index", F.col("__ahead") + F.row_number().over(within) - 1).drop("__part", "__ahead")
    out = permute(out, "seq_index", "slot", n, key).withColumn("shard", F.floor(F.col("slot") / per_shard))
    return out.withColumn("byte_offset", (F.col("slot") % per_shard) * F.lit(stride(length))), n


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def stride(length: int = LENGTH) -> int:
    """Bytes of a record."""
    return 2 * (length + 1)


def write_shards(placed: DataFrame, path: str, n: int, per_shard: int = PER_SHARD) -> None:
    """One file a shard, under ``path``/shard=k, its records in order of slots."""
    shards = max(1, -(-n // per_shard))
    parts = min(shards, 100_000)
    rows = placed.select(F.col("record").cast("string").alias("value"), "shard", "slot").repartitionByRange(parts, "shard").sortWithinPartitions("shard", "slot")
    rows.drop("slot").write.mode("overwrite").option("lineSep", "\x00\x00").partitionBy("shard").text(path)


def read_slots(spark: SparkSession, path: str, first: int, count: int, per_shard: int = PER_SHARD, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The ids of ``count`` slots from ``first`` on (clear of padding only at the end), for a reader that resumes.

    Seeks to the first record of each shard and reads record by record: memory holds one record.
    Ids that came from ``ids_col`` are those plus SPECIAL; 1 ends a document and 0 is padding.
    """
    hadoop, size = spark.sparkContext._jvm.org.apache.hadoop.fs, stride(length)
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray
    for shard in range(first // per_shard, (first + count - 1) // per_shard + 1):
        folder = hadoop.Path(f"{path}/shard={shard}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return
        for status in fs.globStatus(hadoop.Path(folder, "part-*")):
            low, high = max(first - shard * per_shard, 0), min(first + count - shard * per_shard, per_shard, status.getLen() // size)
            if low >= high:
                continue
            stream = fs.open(status.getPath())
            try:
                stream.seek(low * size)
                for _ in range(low, high):
                    yield np.frombuffer(bytes(read(stream, size)), "<u2", length)
            finally:
                stream.close()


def materialise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str | None = "text", ids_col: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Writes the shards and returns their index: a row for each sequence, without its record.

    Sequences are counted and placed first, without records; then each record is made once and shuffled to its seat.
    """
    placed, n = place(sequences(docs, id_col, text_col, ids_col, length), key, per_shard, length)
    index = common.cut(placed)
    # rows that share id and place in the document are told apart by their number among them
    same = lambda a, b, order: F.row_number().over(Window.partitionBy(a, b).orderBy(order))
    seated = index.select("__id", F.col("seq_no").alias("__no"), "slot", "shard", "n_tokens").withColumn("__k", same("__id", "__no", F.struct("n_tokens", "slot"))).drop("n_tokens")
    made = records(docs, id_col, text_col, ids_col, length).withColumn("__rk", same("__rid", "__rno", F.struct(_filled("record", length), "record")))
    on = F.col("__rid").eqNullSafe(F.col("__id")) & (F.col("__rno") == F.col("__no")) & (F.col("__rk") == F.col("__k"))
    write_shards(made.join(seated, on), path, n, per_shard)
    names = {"seq_no", "n_tokens", "seq_index", "slot", "shard", "byte_offset"}
    source = ids_col or text_col
    carried = [F.col("__id").alias(id_col) if c == id_col else F.col("__rest").getField(c).alias(c) for c in docs.columns if c not in names | {source}]
    return index.select(*carried, "seq_no", "n_tokens", "seq_index", "slot", "shard", "byte_offset")


def _filled(record: str, length: int) -> Column:
    """Bytes of a record before its padding: more of them, more tokens (its ids are never 0)."""
    return F.octet_length(F.rtrim(F.hex(record), F.lit("0")))
