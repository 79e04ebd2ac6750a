"""Intermediate tables in the folder that all executors share.

A plan that uses one intermediate result twice, or loops, writes it as Parquet and reads it back: that cuts
lineage, so a lost executor costs one short stage and not the whole history. The folder is the one that the
cluster names in ``spark.checkpoint.dir``; where none is named, a local one is set on one machine, and a cluster raises.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SUBDIR = "sluice-scratch"


def root(spark: SparkSession) -> str:
    """The shared folder of this application, as a URI."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{_SUBDIR}/{spark.sparkContext.applicationId}"


def path(spark: SparkSession, name: str) -> str:
    """A new, unused place below the shared folder."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to a new scratch table and return a DataFrame that reads it; ``by`` names a column with a folder a value."""
    spark = df.sparkSession
    at = path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(at)
    made = spark.read.schema(df.schema).parquet(at)
    made._scratch = at
    return made


def release(*tables: DataFrame, part: str = "") -> None:
    """Remove scratch tables (or one folder of them) that nothing reads any more, once what they gave is written."""
    for df in tables:
        drop(df.sparkSession, f"{df._scratch}/{part}".rstrip("/"))


def drop(spark: SparkSession, at: str) -> None:
    """Remove one scratch table or file tree."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, at: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def move(spark: SparkSession, at: str, to: str) -> None:
    """Give a file tree its final name, which must be new."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if exists(spark, to) or not path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(at), path(to)):
        raise FileExistsError(f"{to} already exists")


def clear(spark: SparkSession) -> None:
    """Remove all scratch tables of this application. Results that were not yet written are lost."""
    drop(spark, root(spark))
