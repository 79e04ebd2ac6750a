"""Session defaults for local runs and tests; a cluster brings its own."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

#: Weights of the pools that priorities name; a cluster's session sets the same two settings.
POOLS = f"file://{Path(__file__).parent / 'plans' / 'pools.xml'}"


def local_session(cpus: int | str = 8, memory: str = "16g", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and no UI."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sluice")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.scheduler.allocation.file", POOLS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
