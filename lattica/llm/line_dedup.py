"""Removal of lines that many documents share, with two Bloom filters.

A line's key is the line stripped of white space at both ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points found in at least ``min_docs`` documents lose all their
lines except those in the document with the largest id.

Pass 1: every task fills two filters of one size, for keys seen once and keys seen twice
or more; the filters are merged by segment (what is once in two parts is twice in both).
Pass 2: only keys that the merged "twice" filter holds leave their task, are pre-aggregated
and confirmed by their whole text. Pass 3: documents with lines to drop get the list of
their keys by a join on the id, at every size; so each text is shuffled once. A filter too small for its keys lets more keys through to the exact
count; it never loses one.

Sizes: partial filters are sent as positions of set bits while that is shorter, so what
is shuffled grows with the lines and not with tasks times bits. The filter has BITS_A_LINE bits a line, a power of two up to ``max_bits``; that bound
is what tasks hold, what the driver merges and what is broadcast. Partial filters are made
by at most MOST_PARTS tasks.

Edge cases: a null or empty text is one empty line; several lines of one document with one
key count as one document; repeated rows count as documents of their own, and rows tied on
the largest id all keep the line; an empty table gives an empty result; very long texts are split whole; extra columns are
carried, whatever their names, and replaced where they clash with results. A null id is below all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .npbytes import tidy

MIN_CHARS = 20
MIN_DOCS = 3
BITS_A_LINE = 16
MAX_BITS = 1 << 29
PROBES = 3
SEGMENT = 8192
MOST_PARTS = 8192
STRIP = common.SPACE_CHARS.encode()


def keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The key of each line, None for lines whose key is too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(STRIP).lower()
        out.append(key if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars else None)
    return out


def key_hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


class Filters:
    """Bits for keys seen once and keys seen at least twice."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return np.stack([(low + np.uint64(i) * high) & np.uint64(self.bits - 1) for i in range(PROBES)]).astype(np.int64)

    @staticmethod
    def holds(filled: np.ndarray, places: np.ndarray) -> np.ndarray:
        return ((filled[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)

    @staticmethod
    def put(filled: np.ndarray, places: np.ndarray) -> None:
        np.bitwise_or.at(filled, (places >> 3).ravel(), (np.uint8(1) << (places & 7).astype(np.uint8)).ravel())

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of keys, one for each document that holds the key."""
        found, times = np.unique(hashes, return_counts=True)
        places = self.places(found)
        self.put(self.twice, places[:, (times > 1) | self.holds(self.once, places).astype(bool)])
        self.put(self.once, places)


def pack(segment: np.ndarray) -> bytes:
    """A segment's bitmap, or the 16-bit positions of its set bits where that is shorter."""
    spots = np.flatnonzero(np.unpackbits(segment, bitorder="little")).astype("<u2")
    return spots.tobytes() if spots.nbytes < segment.nbytes else segment.tobytes()


def unpack(packed: bytes, size: int) -> np.ndarray:
    if len(packed) == size:
        return np.frombuffer(packed, np.uint8)
    bits = np.zeros(8 * size, np.uint8)
    bits[np.frombuffer(packed, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


def _partial(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None
        for batch in batches:
            filters = filters or Filters(bits)
            hashes = [h for text in batch.column(0) for h in {key_hash(k) for k in keys(text.as_py().encode(), min_chars) if k is not None}]
            filters.add(np.array(hashes, np.uint64))
        if filters is None:
            return
        size = min(SEGMENT, bits // 8)
        once, twice = filters.once.reshape(-1, size), filters.twice.reshape(-1, size)
        some = np.flatnonzero(once.any(axis=1))
        for part in np.array_split(some, max(1, len(some) // 256)):
            yield pa.RecordBatch.from_pydict({"segment": pa.array(part, pa.int32()), "once": [pack(once[i]) for i in part], "twice": [pack(twice[i]) for i in part]})

    return run


def _merge(size: int):
    def run(parts):
        import pandas as pd

        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for a, b in zip(parts["once"], parts["twice"], strict=True):
            a = unpack(a, size)
            twice |= unpack(b, size) | (once & a)
            once |= a
        return pd.DataFrame({"segment": [parts["segment"].iloc[0]], "twice": [pack(twice)]})

    return run


def _suspects(shared, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(shared.value, np.uint8)
        filters = Filters(8)
        filters.bits = 8 * len(packed)
        for batch in batches:
            ids, found, hashes = [], [], []
            for i, text in enumerate(batch.column("__text")):
                own = dict.fromkeys(k for k in keys(text.as_py().encode(), min_chars) if k is not None)
                ids += [i] * len(own)
                found += own
                hashes += map(key_hash, own)
            if hashes:
                hit = np.flatnonzero(filters.holds(packed, filters.places(np.array(hashes, np.uint64))))
                yield pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(np.array(ids)[hit])), pa.array([found[i] for i in hit], pa.binary())], ["__id", "key"])

    return tidy(run)


def _rewrite(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("__text"), batch.column("__drop").to_pylist(), strict=True):
                data = text.as_py()
                n_lines.append(data.count("\n") + 1)
                if drop:
                    gone = set(drop)
                    lines = data.encode().split(b"\n")
                    stay = [x for x, k in zip(lines, keys(b"\n".join(lines), min_chars), strict=True) if k is None or k not in gone]
                    n_dropped.append(len(lines) - len(stay))
                    data = b"\n".join(stay).decode()
                else:
                    n_dropped.append(0)
                texts.append(data)
            made = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__rest"), *made], ["__id", "__rest", "__text", "n_lines", "n_dropped"])

    return tidy(run)


def twice_seen(texts: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> bytes:
    """The merged filter of keys in two or more of ``texts`` (one column): bits / 8 bytes, whatever the input."""
    if texts.rdd.getNumPartitions() > MOST_PARTS:
        texts = texts.coalesce(MOST_PARTS)
    parts = texts.mapInArrow(_partial(bits, min_chars), "segment int, once binary, twice binary")
    size = min(SEGMENT, bits // 8)
    merged = parts.groupBy("segment").applyInPandas(_merge(size), "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row["segment"] * size : (row["segment"] + 1) * size] = unpack(row["twice"], size)
    return out.tobytes()


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``docs`` with shared lines dropped from the text, n_lines (before) and n_dropped."""
    whole = common.packed(docs, text_col, id_col)
    n = whole.agg(F.sum(F.regexp_count("__text", F.lit("\n")) + 1)).first()[0] or 0
    bits = min(max_bits, 1 << max(16, (BITS_A_LINE * n - 1).bit_length()))
    shared = whole.sparkSession.sparkContext.broadcast(twice_seen(whole.select("__text"), bits, min_chars))

    found = common.cut(whole.select("__id", "__text").mapInArrow(_suspects(shared, min_chars), common.with_fields(whole, ["__id"], "key binary")))
    confirmed = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("keep")).where(F.col("n") >= min_docs)
    confirmed = common.cut(confirmed.select("key", "keep"))  # read from a table, so that a skewed join can be split
    drops = found.join(confirmed, "key").where(~F.col("__id").eqNullSafe(F.col("keep")))
    drops = common.cut(drops.groupBy("__id").agg(F.collect_set("key").alias("__drop")))
    common.drop(found)
    lined = whole.join(drops.withColumnRenamed("__id", "__key").hint("merge"), F.col("__id").eqNullSafe(F.col("__key")), "left")
    out = lined.mapInArrow(_rewrite(min_chars), common.with_fields(whole, ["__id", "__rest"], "__text string, n_lines bigint, n_dropped bigint"))
    return out.select(*common.unpacked(docs, text_col, {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")}, id_col, F.col("__text")))
