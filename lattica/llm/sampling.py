"""Bounded samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, most: int, most_bytes: int, id_col: str, text_col: str, extra: list[str] | None = None) -> list:
    """Rows (text, label, extras) of at most ``most`` labelled ids and ``most_bytes`` of text in UTF-8, or of one longer text.

    ``keep`` is a condition on the labels' id. Ids are taken in order of their hash, so the
    sample is the same whatever the partitions; an id with several labels has the largest,
    a null id none. Texts are whole.
    """
    ids = labels.where(keep & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__label_id")).agg(F.max(label_col).alias("__label"))
    ids = ids.orderBy(F.xxhash64("__label_id"), "__label_id").limit(most)
    extra = extra or []
    picked = docs.select(F.col(f"`{id_col}`").alias("__id"), common.text_or_empty(F.col(f"`{text_col}`")).alias("text"), *[F.col(f"`{c}`") for c in extra])
    picked = common.cut(picked.join(F.broadcast(ids), picked["__id"] == ids["__label_id"]))
    order = [F.xxhash64("__id"), F.col("__id"), F.xxhash64("text"), F.col("text")]
    sized = picked.select("__id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size"))
    total, last = 0, None
    for row in sized.orderBy(F.xxhash64("__id"), "__id", "h").toLocalIterator():  # sizes only: the cut is known before a text is sent
        total += row["size"]
        if last is not None and total > most_bytes:
            break
        last = row
    if last is None:
        return []
    before = F.xxhash64("__id") < F.xxhash64(F.lit(last["__id"]).cast(dict(picked.dtypes)["__id"]))
    here = (F.col("__id") == F.lit(last["__id"])) & (F.xxhash64("text") <= F.lit(last["h"]))
    rows = picked.where(before | here).orderBy(*order).select("text", "__label", *extra).collect()
    common.drop(picked)
    return rows
