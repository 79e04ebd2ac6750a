"""Sorted key-value tables: Parquet ranges sorted by key, with range scans, lookups and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_FOUND = "NOT_FOUND"


def write(pairs: DataFrame, path: str, files: int | None = None) -> None:
    """(key, value) sorted by key over files and within them; duplicates stay."""
    ranged = pairs.repartitionByRange(files, "key") if files else pairs.repartitionByRange("key")
    ranged.sortWithinPartitions("key").write.mode("errorifexists").parquet(path)


def between(pairs: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Pairs with start <= key < end; "" is open. A start beyond the end raises."""
    if start and end and start > end:
        raise ValueError(f"start {start!r} lies beyond end {end!r}")
    if start:
        pairs = pairs.where(F.col("key") >= start)
    return pairs.where(F.col("key") < end) if end else pairs


def scan(spark: SparkSession, paths: str | list[str], start: str = "", end: str = "") -> DataFrame:
    """A range of one or more tables; the bounds reach the Parquet footers. Duplicates stay, order is by file."""
    paths = [paths] if isinstance(paths, str) else paths
    return between(spark.read.parquet(*paths), start, end)


def merge(spark: SparkSession, paths: list[str], start: str = "", end: str = "") -> DataFrame:
    """``scan`` in global key order."""
    return scan(spark, paths, start, end).orderBy("key")


def seek(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) for each row of ``keys``: every pair of the key, or NOT_FOUND."""
    return keys.select("key").join(pairs, "key", "left").select("key", F.coalesce("value", F.lit(NOT_FOUND)).alias("value"))
