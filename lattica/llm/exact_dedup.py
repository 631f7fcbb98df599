"""Exact deduplication by content-defined chunk recipes.

A text (A-Z lower-cased) is cut into chunks where a rolling hash of its last bytes hits a
mask, so equal texts always have equal chunks. A document's recipe is its ordered list of
chunk hashes and lengths. Documents with different recipes differ; only documents that
share a recipe go on, and their chunks are verified by content: chunks are deduplicated by
hash and bytes, and a hash found with two contents makes its chunks be told apart. Then
documents are equal exactly if their lists of verified chunk identifiers are equal.

Whole texts never leave their task, at any size: a filter of the shared recipes is broadcast, each
task cuts the suspected texts again, and their distinct chunks are shuffled, after
deduplication in the task. Groups are formed by counts and maxima, so a group may be of any size.

Edge cases: null counts as the empty text, whose recipe is empty; texts of any length are
cut by the same rule; on ties of the id (repeated rows) each row is a member of the group
and all rows with the kept id are kept; a null id is below all others, so it is kept only where
all ids of its group are null; an empty table gives an empty result; extra columns
are carried, whatever their names, and replaced where they clash with results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .npbytes import tidy

AVERAGE = 2048
LONGEST = 16384
SPAN = 32
#: Bits of a chunk's hash. Fewer only make more chunks to be told apart by content.
HASH_BITS = 64
#: Bytes of text that a task handles at once, apart from single longer texts.
BLOCK = 2 << 20


def _gear() -> np.ndarray:
    """256 mixed words, one for each byte value, from a fixed integer mixing rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


GEAR = _gear()


def boundaries(data: np.ndarray, average: int = AVERAGE, longest: int = LONGEST) -> np.ndarray:
    """Chunk ends of one text (bytes). Depends on nothing but its bytes."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    rolled, k = GEAR[data], 1
    while k < SPAN:  # doubling: after it, rolled[i] sums GEAR[data[i-j]] << j for j < SPAN
        g = rolled.copy()
        g[k:] += rolled[:-k] << np.uint32(k)
        rolled, k = g, 2 * k
    hits = np.flatnonzero((rolled >> np.uint32(8)) & np.uint32(average - 1) == 0) + 1
    ends, last = [], 0
    for e in [*hits.tolist(), n]:
        while e - last > longest:
            last += longest
            ends.append(last)
        if e - last >= average // 4 or (e == n and e > last):
            last = e
            ends.append(e)
    return np.array(ends, np.int64)


def chunks(data: bytes, bits: int = HASH_BITS) -> list[tuple[int, bytes]]:
    """(hash, bytes) of each chunk, in order; the hash is cut to ``bits``."""
    out, start = [], 0
    for end in boundaries(np.frombuffer(data, np.uint8)).tolist():
        piece = data[start:end]
        out.append((int(np.uint64(xxhash.xxh3_64_intdigest(piece) >> (64 - bits)).view(np.int64)), piece))
        start = end
    return out


def digest(recipe: list[tuple[int, bytes]]) -> bytes:
    """128 bits of the hashes and lengths of a recipe."""
    return xxhash.xxh3_128_digest(np.array([(h, len(b)) for h, b in recipe], np.int64).tobytes())


def _recipes(bits: int):
    """Adds recipe and its digest (d1, d2) in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends, digests = [], [0], []
            for text in batch.column("__text"):
                own = chunks(text.as_py().encode(), bits)
                found += [h for h, _ in own]
                ends.append(len(found))
                digests.append(digest(own))
            recipe = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int64()))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEPT], recipe, pa.array(halves[:, 0]), pa.array(halves[:, 1])], [*KEPT, "recipe", "d1", "d2"])

    return tidy(run)


KEPT = ["__id", "__rest", "__sha"]


def _suspected(texts: pa.Array, filled: np.ndarray, bits: int) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(row, chunks) of the texts whose recipe may be in the filter."""
    for i, text in enumerate(texts):
        own = chunks(text.as_py().encode(), bits)
        if common.is_member(filled, np.frombuffer(digest(own)[:8], np.int64))[0]:
            yield i, own


def _pieces(wanted, bits: int):
    """(text) to distinct (hash, piece) of suspected texts, within blocks of them."""
    schema = pa.schema([("hash", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = {}, 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.int64()), pa.array([b for _, b in seen], pa.binary())], schema=schema)
        for batch in batches:
            for _, own in _suspected(batch.column("__text"), wanted.value, bits):
                for h, piece in own:
                    if (h, piece) not in seen:
                        seen[h, piece] = True
                        held += len(piece)
                if held > 4 * BLOCK:
                    yield out()
                    seen, held = {}, 0
        if seen:
            yield out()

    return tidy(run)


def _numbered(wanted, bits: int):
    """(sha, text) to (sha, place, hash, piece): every chunk of the documents that may have an ambiguous hash."""
    schema = pa.schema([("__sha", pa.string()), ("place", pa.int32()), ("hash", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in _suspected(batch.column("__text"), wanted.value, bits):
                sha = batch.column("__sha")[i].as_py()
                yield pa.RecordBatch.from_pydict({"__sha": [sha] * len(own), "place": list(range(len(own))), "hash": [h for h, _ in own], "piece": [b for _, b in own]}, schema=schema)

    return tidy(run)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = HASH_BITS) -> DataFrame:
    """``docs`` without the text, with keep_id, group_size, kept, text_sha256 and recipe.

    Of equal texts the row with the largest id is kept.
    """
    whole = common.packed(docs, text_col, id_col).withColumn("__text", common.ascii_lower(F.col("__text"))).withColumn("__sha", F.sha2(F.col("__text").cast("binary"), 256))
    made = common.cut(whole.mapInArrow(_recipes(hash_bits), common.with_fields(whole, KEPT, "recipe array<bigint>, d1 bigint, d2 bigint")))

    shared = made.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = common.members(common.cut(shared.select("d1")))
    pieces = common.cut(whole.select("__text").mapInArrow(_pieces(wanted, hash_bits), "hash bigint, piece binary").distinct())
    ambiguous = common.cut(pieces.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))

    listed = made.withColumn("variants", F.array().cast("array<int>"))
    if not ambiguous.isEmpty():  # chunks of one hash and several contents are numbered by content
        numbers = pieces.join(ambiguous, "hash").select("hash", "piece", (F.row_number().over(Window.partitionBy("hash").orderBy("piece")) - 1).alias("variant"))
        doubtful = common.cut(made.select("d1", "__sha", F.explode("recipe").alias("hash")).join(ambiguous, "hash").select("d1", "__sha").distinct())
        every = whole.select("__sha", "__text").mapInArrow(_numbered(common.members(doubtful.select("d1")), hash_bits), "__sha string, place int, hash bigint, piece binary")
        every = every.dropDuplicates(["__sha", "place"]).join(doubtful.select("__sha").distinct(), "__sha")
        numbered = every.join(numbers, ["hash", "piece"], "left").groupBy("__sha").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("variant", F.lit(-1)).alias("variant")))).alias("v"))
        variants = common.cut(numbered.select("__sha", F.transform("v", lambda x: x["variant"]).alias("variants")))
        listed = made.join(variants, "__sha", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<int>")))
    same = ["d1", "d2", "recipe", "variants"]
    groups = common.cut(listed.groupBy(*same).agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    common.drop(pieces)
    out = listed.join(groups, same, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return out.select(*common.unpacked(docs, text_col, {
        "keep_id": keep, "group_size": F.coalesce("group_size", F.lit(1)).cast("long"), "kept": keep.eqNullSafe(F.col("__id")), "text_sha256": F.col("__sha"), "recipe": F.col("recipe"),
    }, id_col))
