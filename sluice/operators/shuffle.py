"""Routing to reducers, secondary sort, total order, combining and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route(rows: DataFrame, partitions: int, number: str = "reduce_no", negative: str = "raise") -> DataFrame:
    """Rows with number i in partition i. Negative numbers have no reducer: "raise" or "drop"."""
    if negative == "drop":
        rows = rows.where(F.col(number) >= 0)
    elif negative == "raise":
        failed = F.raise_error(F.concat(F.lit("negative partition "), F.col(number).cast("string")))
        rows = rows.withColumn(number, F.when(F.col(number) < 0, failed.cast("long")).otherwise(F.col(number)))
    else:
        raise ValueError(f"negative: {negative!r}")
    return rows.repartitionById(partitions, F.col(number).cast("int"))


def sorted_reducers(rows: DataFrame, partitions: int, number: str = "reduce_no", keys: tuple[str, ...] = ("key",), negative: str = "raise") -> DataFrame:
    """``route``, then each partition sorted by the whole key: the input of reducers."""
    return route(rows, partitions, number, negative).sortWithinPartitions(*keys)


def secondary_sort(rows: DataFrame, group: list[str], then: list[Column | str], partitions: int | None = None) -> DataFrame:
    """Groups co-located by ``group`` and ordered by ``group`` and ``then``, with one shuffle."""
    placed = rows.repartition(partitions, *group) if partitions else rows.repartition(*group)
    return placed.sortWithinPartitions(*group, *then)


def partition_sizes(rows: DataFrame, number: str = "reduce_no") -> DataFrame:
    """Rows of each partition number."""
    return rows.groupBy(number).agg(F.count("*").alias("n"))


def combined(rows: DataFrame, keys: list[str], **sums: str) -> DataFrame:
    """Sums by key, partly on the map side: name=column pairs."""
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))


def merged(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows of all parts in key order; duplicates stay."""
    return reduce(DataFrame.unionByName, parts).orderBy(key)


def without_large(lines: DataFrame, most: int = 2 << 20, drop: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines, count of those above ``most`` bytes). They are dropped only where asked for."""
    large = F.octet_length("value") > most
    return (lines.where(~large) if drop else lines), lines.where(large).agg(F.count("*").alias("large"))


def without_empty(lines: DataFrame) -> DataFrame:
    return lines.where(F.length("value") > 0)
