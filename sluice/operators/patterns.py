"""Dataflows that map-sort-reduce programs express, as Spark operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sides above so many bytes (by Spark's estimate) are not broadcast.
BROADCAST_BYTES = 64 << 20
#: Keys with LEAST rows and one in HOT of all rows or more are hot; so a table never has more than HOT of them.
#: Tables of SMALL rows or less fit a task and have none.
HOT, LEAST, SMALL = 1000, 1000, 20_000


def word_count(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of lower-cased words between spaces and newlines."""
    words = texts.select(F.explode(F.split(F.lower(text), "[ \n]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def inverted_index(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n_docs, first_doc): postings in short; ``postings`` has the pairs themselves."""
    return postings(texts, key, text).groupBy("word").agg(F.count("*").alias("n_docs"), F.min(key).alias("first_doc"))


def postings(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    words = F.array_distinct(F.split(F.lower(text), "[ \n]+"))
    return texts.select(key, F.explode(words).alias("word")).where("word <> ''")


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def map_side_join(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join without a shuffle of ``large``, if ``small`` is small by estimate; else Spark chooses."""
    return large.join(F.broadcast(small) if estimated_bytes(small) <= BROADCAST_BYTES else small, on, how)


def reduce_side_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Both sides shuffled by key and merged; skewed keys are split at run time."""
    return left.join(right.hint("merge"), on, how)


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", size: str | None = None) -> DataFrame:
    """``rows`` joined ("inner" or "left") with ``table``, which has one row a key, without a task that holds a hot key.

    Rows of hot keys stay where they are and meet their row of ``table`` by a broadcast (at most HOT rows); all others
    are joined by a shuffle as usual. ``size`` names a column of ``table`` with each key's count in ``rows``, which
    saves counting them. Rows whose key is null match nothing. Both sides are read more than once: keep them.
    """
    spark, names = rows.sparkSession, [*rows.columns, *(c for c in table.columns if c not in on)]
    if size:
        total = table.agg(F.sum(size)).first()[0] or 0
    else:
        total = rows.count()
    hot = []
    if total > SMALL:
        counts = table.select(*on, F.col(size).alias("_n")) if size else rows.groupBy(*on).agg(F.count("*").alias("_n"))
        limit = max(LEAST, total // HOT)
        counts = counts.where((F.col("_n") >= limit) & reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on)))
        found = counts.drop("_n").join(table, on, how)
        hot = found.collect()  # at most HOT + 1 rows
    if not hot:
        return rows.join(table, on, how).select(*names)
    few = spark.createDataFrame(hot, found.schema).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(few), on, "left")
    cold = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(table, on, how)
    return marked.where("_hot").select(*names).unionByName(cold.select(*names))


def first_of(rows: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def running(rows: DataFrame, group: list[str], order: list[Column | str], value: str) -> DataFrame:
    """Adds the running sum of a value and the previous value in each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("running", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("previous", F.lag(value).over(w))


def top(rows: DataFrame, k: int, order: list[Column | str]) -> DataFrame:
    return rows.orderBy(*order).limit(k)
