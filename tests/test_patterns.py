"""The hot-key join, and scratch folders."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import patterns
from sluice.plans import scratch


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("size", [None, "n"])
def test_looked_up(spark, how, size):
    """Hot keys, cold keys, keys without a partner and null keys join as in a plain join."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 101 == 1, None).otherwise(F.col("id") % 5000)
    rows = spark.range(30_000).select(key.alias("k"), F.col("id").alias("v")).persist()
    table = rows.where("k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"))
    got = patterns.looked_up(rows, table, ["k"], how, size)
    want = rows.join(table, ["k"], how)
    assert got.columns == ["k", "v", "n"] and got.count() == want.count() > 0
    assert got.exceptAll(want.select(got.columns)).count() == 0
    rows.unpersist()


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        applicationId = "app"

        class _jsc:
            @staticmethod
            def sc():
                class None_:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False

                        return Option

                return None_

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.root(Session)


def test_scratch_tables_are_removed(spark):
    from pathlib import Path

    made = scratch.keep(spark.range(10).withColumn("part", F.col("id") % 2), "parts", by="part")
    at = Path(made._scratch.removeprefix("file://").removeprefix("file:"))
    scratch.release(made, part="part=1")
    assert at.exists() and spark.read.parquet(made._scratch).count() == 5
    scratch.release(made)
    assert not at.exists()
