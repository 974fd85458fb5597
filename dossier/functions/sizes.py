"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast.
SMALL = 100_000


def is_small(df: DataFrame, most: int = SMALL) -> bool:
    """Has ``df`` ``most`` rows at most? Reads no more than that."""
    return len(df.limit(most + 1).select(F.lit(1)).collect()) <= most


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """A broadcast hint if the size was found small; else ``df`` as it is, joined by shuffle."""
    return F.broadcast(df) if small else df


def among(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key ``rows`` has. Where those keys are few, ``df`` isn't shuffled. ``rows`` is read twice, so it had better be written."""
    keys = rows.select(key).distinct()
    return df.join(broadcast_if(is_small(keys), keys), key, "left_semi")
