"""Counters, state counts, percentiles and time to go."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions import values
from sluice.operators.patterns import looked_up
from sluice.plans import scratch

STATES = ("pending", "running", "failed", "killed", "completed")
#: Equal ranges between the smallest and the largest value of a group.
BUCKETS = 4096
POINTS = (("p90", 0.9), ("p99", 0.99), ("p999", 0.999), ("p9999", 0.9999))


def counters(lines: DataFrame) -> DataFrame:
    """(counter, total) over counter lines in the column value; other lines are skipped."""
    key, amount = values.counter(F.col("value"))
    return lines.select(key.alias("counter"), amount.alias("amount")).where("amount IS NOT NULL").groupBy("counter").agg(F.sum("amount").alias("total"))


def state_counts(tasks: DataFrame, state: str = "state", by: Iterable[str] = ()) -> DataFrame:
    """Tasks of each state, in all or by columns."""
    return tasks.groupBy(*by, state).agg(F.count("*").alias("n"))


def state_table(tasks: DataFrame, by: str, state: str = "state", states: tuple[str, ...] = STATES) -> DataFrame:
    """One row a value of ``by``: total, and a column a state."""
    return tasks.groupBy(by).agg(F.count("*").alias("total"), *(F.count(F.when(F.col(state) == s, 1)).alias(s) for s in states))


def durations(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The values at places floor(n * q) of each group's order, its largest and mean, and how many lie below the mean.

    Values are whole numbers, and so is the mean: the sum divided and cut. The places are exact: values are counted in
    BUCKETS equal ranges between a group's bounds, and only the ranges that hold a place are put in order, so no task
    holds a group. Null values are left out; a group without values has none of these.
    """
    rows = rows.where(F.col(value).isNotNull())
    sized = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("shortest"), F.max(value).alias("longest"), F.sum(value).alias("whole"))
    sized = scratch.keep(sized.withColumn("mean", F.expr("whole DIV n")).drop("whole"), "sized")
    # equal values share a row: a group is as long as it has different values
    each = scratch.keep(rows.groupBy(*by, value).agg(F.count("*").alias("held")), "each")
    span = F.greatest(F.col("longest") - F.col("shortest"), F.lit(1))
    placed = looked_up(each, sized, by).withColumn("bucket", F.least(F.floor((F.col(value) - F.col("shortest")) / span * BUCKETS), F.lit(BUCKETS - 1)))
    sums = placed.groupBy(*by, "bucket", "n").agg(F.sum("held").alias("inside"), F.sum(F.when(F.col(value) < F.col("mean"), F.col("held")).otherwise(0)).alias("below"))
    sums = scratch.keep(sums, "sums")
    order = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    points = F.array(*(F.struct(F.lit(name).alias("point"), F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1).alias("at")) for name, q in POINTS))
    wanted = sums.withColumn("base", F.coalesce(F.sum("inside").over(order), F.lit(0))).withColumn("p", F.explode(points))
    wanted = wanted.where("base <= p.at AND p.at < base + inside").select(*by, "bucket", "base", "p.point", "p.at")
    upto = F.col("base") + F.sum("held").over(Window.partitionBy(*by, "point").orderBy(value))
    found = placed.select(*by, value, "held", "bucket").join(wanted, [*by, "bucket"]).withColumn("upto", upto).where("upto > at")
    found = found.groupBy(*by).agg(*(F.min(F.when(F.col("point") == name, F.col(value))).alias(name) for name, _ in POINTS))
    below = sums.groupBy(*by).agg(F.sum("below").alias("below_mean"))
    return sized.join(found, by).join(below, by).select(*by, "n", *(name for name, _ in POINTS), "longest", "mean", "below_mean")


def time_to_go(durations: list[int], elapsed: list[int], total: int, failed: int = 0, killed: int = 0) -> int | None:
    """Seconds left of a job's tasks, from those of completed tasks and those that running ones have run so far.

    The work left is total times the cut average less what was spent; it is divided by the rate of success and by the
    number of running tasks (one, if none runs). None if no task is completed or no work is left.
    """
    if not durations:
        return None
    left = sum(durations) // len(durations) * total - sum(durations) - sum(elapsed)
    if left <= 0:
        return None
    success = len(durations) / (len(durations) + killed + failed)
    return int(left / success / (len(elapsed) or 1))


def times_to_go(tasks: DataFrame, by: str, seconds: str = "seconds", state: str = "state") -> DataFrame:
    """(by, left_seconds) as ``time_to_go``, for each group of tasks; running tasks hold the seconds that they have run."""
    count = lambda s: F.count(F.when(F.col(state) == s, 1))
    spent = lambda s: F.coalesce(F.sum(F.when(F.col(state) == s, F.col(seconds))), F.lit(0))
    sums = tasks.groupBy(by).agg(F.count("*").alias("total"), *(count(s).alias(s) for s in STATES), spent("completed").alias("done_s"), spent("running").alias("running_s"))
    left = F.expr("CASE WHEN completed > 0 THEN done_s DIV completed * total - done_s - running_s END")
    success = F.col("completed") / (F.col("completed") + F.col("killed") + F.col("failed"))
    return sums.withColumn("left", left).select(by, F.when(F.col("left") > 0, F.floor(F.col("left") / success / F.greatest("running", F.lit(1)))).alias("left_seconds"))
