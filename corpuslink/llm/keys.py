"""Keeping or dropping rows by a table of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_KEYS = 4_000_000


def only(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) those named in ``keys``, a written table of one number a row; a null
    matches a null. The keys are broadcast only while they are at most BROADCAST_KEYS (some 64 MB as a table in memory)."""
    few = keys.count() <= BROADCAST_KEYS
    named = keys.select(F.col(key).alias("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(F.broadcast(named) if few else named, same, how)
