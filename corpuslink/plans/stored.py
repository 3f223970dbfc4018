"""Derived tables that are written once and read by every later query, as the search index is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslink.session import frozen

_TABLES: dict[tuple, DataFrame] = {}


def state_of(source: DataFrame) -> int:
    """A number that changes when a file of ``source`` is added, removed or rewritten. Reads no column."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").groupBy(
        "file_path", "file_size", "file_modification_time").agg(F.lit(1))
    return files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()[0] or 0


def stored(spark: SparkSession, name: str, source: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from ``source``, built by ``build`` when ``source``'s files are not those of the last time,
    and kept in the shared checkpoint folder."""
    key = (spark.sparkContext.applicationId, name, tuple(sorted(source.inputFiles())[:1]), state_of(source))
    if key not in _TABLES:
        _TABLES[key] = frozen(build())
    return _TABLES[key]
