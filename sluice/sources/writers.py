"""Sinks: text, pairs as text, SequenceFile, files by suffix, and side outputs. Output paths must be new."""

from __future__ import annotations

from collections.abc import Iterator
from enum import Enum

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources import readers


class OutputFormat(Enum):
    TEXT = "Text"
    BINARY = "Binary"
    SEQUENCE = "SequenceFile"
    SUFFIX = "SuffixMultipleText"

    @classmethod
    def named(cls, name: str) -> OutputFormat:
        for kind in (cls.SUFFIX, cls.TEXT, cls.BINARY, cls.SEQUENCE):
            if name.lower().startswith(kind.value.lower()):
                return kind
        raise ValueError(f"no output format: {name!r}")


def lines_of(rows: DataFrame) -> DataFrame:
    """One column value: a pair becomes key, tab, value; a single column of any name is the line."""
    if len(rows.columns) == 1:
        return rows.select(F.col(rows.columns[0]).alias("value"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(F.concat(text("key"), F.lit("\t"), text("value")).alias("value"))


def text(rows: DataFrame, path: str, gzip: bool = False, most: int | None = None) -> None:
    """Lines as text files, of ``most`` bytes or one line each at most, if given."""
    lines = lines_of(rows)
    writer = lines.write.mode("errorifexists").option("lineSep", "\n")
    if most:
        widest = lines.agg(F.max(F.octet_length("value"))).first()[0] or 0
        writer = writer.option("maxRecordsPerFile", max(1, most // (widest + 1)))
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), readers.PACK):
            packed = readers.packed(batch.slice(at, readers.PACK))
            yield pa.record_batch([pa.array([packed], pa.binary())], ["packed"])


def _pairs(packed: bytes) -> Iterator[tuple[bytearray, bytearray]]:
    for batch in pa.ipc.open_stream(packed):
        for k, v in zip(*(batch.column(i).fill_null(b"").to_pylist() for i in (0, 1)), strict=True):
            yield bytearray(k), bytearray(v)


def sequence_file(rows: DataFrame, path: str, codec: str | None = None) -> None:
    """Pairs, or lines under an empty key with their newline, as a SequenceFile of BytesWritable."""
    if rows.columns == ["value"]:
        rows = rows.select(F.lit(b"").alias("key"), F.concat(F.col("value").cast("string"), F.lit("\n")).cast("binary").alias("value"))
    # whole Arrow batches cross to Python, not rows
    packed = rows.select(F.col("key").cast("binary"), F.col("value").cast("binary")).mapInArrow(_packed, "packed binary")
    packed.rdd.flatMap(lambda r: _pairs(r[0])).saveAsSequenceFile(path, codec)


def by_suffix(lines: DataFrame) -> DataFrame:
    """(suffix, value): lines that end with A-Z and have two characters or more, without their last two."""
    value = F.col("value")
    kept = lines.where(value.rlike(r"[A-Z]\z") & (F.length(value) >= 2))
    return kept.select(F.right(value, F.lit(1)).alias("suffix"), F.substring(value, F.lit(1), F.length(value) - 2).alias("value"))


def suffix_files(lines: DataFrame, path: str, gzip: bool = False) -> None:
    """One folder suffix=A ... suffix=Z each, written in one pass without a shuffle."""
    writer = by_suffix(lines).write.mode("errorifexists").partitionBy("suffix")
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def side_outputs(rows: DataFrame, path: str, tag: str = "tag") -> None:
    """Rows (tag, value) in one folder a tag below ``path``, in one pass."""
    rows.select(tag, "value").write.mode("errorifexists").partitionBy(tag).text(path)


def write(rows: DataFrame, kind: OutputFormat, path: str, gzip: bool = False) -> None:
    if kind is OutputFormat.SUFFIX:
        suffix_files(lines_of(rows), path, gzip)
    elif kind is OutputFormat.TEXT:
        text(rows, path, gzip)
    else:
        sequence_file(rows, path, "org.apache.hadoop.io.compress.GzipCodec" if gzip else None)
