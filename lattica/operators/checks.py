"""Checks of sizes before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast; an error if it has more than ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows where a small table is expected")
    return F.broadcast(df)
