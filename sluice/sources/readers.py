"""Sources: text, local text, SequenceFile, one line a task, and text with split offsets as keys."""

from __future__ import annotations

import glob
import itertools
from collections.abc import Iterator
from enum import Enum

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InputFormat(Enum):
    TEXT = "Text"
    BINARY = "Binary"
    SEQUENCE = "SequenceFile"
    NLINE = "NLine"

    @classmethod
    def named(cls, name: str) -> InputFormat:
        """By prefix, as in TextInputFormat; an unknown name raises."""
        for kind in cls:
            if name.lower().startswith(kind.value.lower()):
                return kind
        raise ValueError(f"no input format: {name!r}")


#: Pairs of a SequenceFile that cross to rows at once.
PACK = 1000
UNREADABLE = (".lzma", ".lzo", ".qlz", ".xz")


def _paths(paths: str | list[str]) -> list[str]:
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if p.lower().endswith(UNREADABLE):
            raise ValueError(f"{p}: this compression needs a Hadoop codec that Spark does not bring")
    return paths


def text(spark: SparkSession, paths: str | list[str], keep_empty: bool = True) -> DataFrame:
    """(value): lines cut at newlines only. Paths may be folders, globs with * ? {a,b}, .gz or .bz2.

    Large files are read in byte ranges, and a line belongs to the range that holds its first byte; compressed
    files that cannot be cut are one range each. Names that start with _ or . are skipped in folders.
    """
    lines = spark.read.option("lineSep", "\n").text(_paths(paths))
    return lines if keep_empty else lines.where(F.length("value") > 0)


def local_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``text`` of files of the machine (each executor must see them)."""
    return text(spark, [p if "://" in p else f"file://{p}" for p in _paths(paths)])


def expand_local(pattern: str) -> list[str]:
    """Local files of a pattern, sorted."""
    return sorted(glob.glob(pattern))


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as one value, an Arrow stream: many pairs cross between Spark's rows and Python at once."""
    with pa.BufferOutputStream() as sink:
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        return sink.getvalue().to_pybytes()


def _packed(pairs: Iterator) -> Iterator[tuple[bytearray]]:
    as_bytes = lambda x: bytes(x) if isinstance(x, (bytes, bytearray)) else b"" if x is None else str(x).encode()
    for some in itertools.batched(pairs, PACK):
        held = pa.record_batch([pa.array([as_bytes(kv[i]) for kv in some], pa.binary()) for i in (0, 1)], ["key", "value"])
        yield (bytearray(packed(held)),)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in batch.column(0):
            yield from pa.ipc.open_stream(one.as_buffer())


def sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) as binary from a SequenceFile of BytesWritable or Text."""
    rows = spark.sparkContext.sequenceFile(path).mapPartitions(_packed)
    return spark.createDataFrame(rows, "packed binary", verifySchema=False).mapInArrow(_unpacked, "key binary, value binary")


def nline(spark: SparkSession, paths: str | list[str], lines_per_task: int = 1) -> DataFrame:
    """(value): "0", a tab and the line, one task a line: for lines that stand for much work."""
    rows = []
    for path in _paths(paths):
        rdd = spark.sparkContext.newAPIHadoopFile(
            path,
            "org.apache.hadoop.mapreduce.lib.input.NLineInputFormat",
            "org.apache.hadoop.io.LongWritable",
            "org.apache.hadoop.io.Text",
            conf={"mapreduce.input.lineinputformat.linespermap": str(lines_per_task)},
        )
        rows.append(rdd.map(lambda kv: (f"0\t{kv[1]}",)))
    return spark.createDataFrame(spark.sparkContext.union(rows), "value string")


def text_pairs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, value): each line with the offset of the byte range it was read in."""
    lines = text(spark, paths)
    return lines.select(F.col("_metadata.file_block_start").cast("string").alias("key"), "value")


def files_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file, start, length): lines with the range they come from, for maps that tag their inputs."""
    return text(spark, paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"))


def read(spark: SparkSession, kind: InputFormat, paths: str | list[str]) -> DataFrame:
    """The source of a format, as lines (value) or pairs (key, value)."""
    if kind is InputFormat.NLINE:
        return nline(spark, paths)
    if kind in (InputFormat.SEQUENCE, InputFormat.BINARY):
        frames = [sequence_file(spark, p) for p in _paths(paths)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
    return text(spark, paths)


def with_split_size(spark: SparkSession, size: int, least: int | None = None) -> SparkSession:
    """A session whose text ranges have ``size`` bytes at most; the caller's own stays as it is. Small files share a task.

    Files of ``least`` bytes or less are not cut, however many cores there are.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    if least:
        own.conf.set("spark.sql.files.openCostInBytes", str(least))
    return own
