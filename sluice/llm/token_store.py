"""Token ids as ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

``write`` sorts documents by id over ranges (one file each), encodes them and writes ids as an integer list column,
which ORC run-length encodes within stripes of STRIPE bytes; row indexes (every STRIDE rows) and Bloom filters on
doc_id let a reader skip stripes and row groups. Readers split files by stripe. ``index`` reads back the layout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm import batches as batch_rows
from sluice.llm.tokens import encoder

STRIPE, STRIDE = 16 << 20, 1000
#: Documents of a file, at most about so many.
SHARD = 200_000
END = 1


def _with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with ``end`` after them."""
    return np.insert(ids, at[1:], end).astype(np.int32, copy=False), at + np.arange(len(at))


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int) -> Iterator[pa.RecordBatch]:
    place = 0
    for batch in batches:
        for start, stop, ids, at in encoder(vocabulary).encode(batch.column(1)):
            ids, at = _with_end(ids, at, end)
            rows = slice(start, stop)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2).slice(start, stop - start),
                    batch.column(0)[rows],
                    pa.array(place + at[:-1], pa.int64()),
                    pa.array(np.diff(at), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                ],
                ["shard", "doc_id", "shard_start", "n_tokens", "ids"],
            )
            place += int(at[-1])


def write(docs: DataFrame, at: str, vocabulary: str, end: int = END, shards: int | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``at``, ascending by doc_id over files and within them.

    Null texts hold the end id only; equal ids are ordered by text, null ids come last. Shards are ranges of
    doc_id, so a task holds one batch of texts and of ids, however many rows its range has. A column of ``docs``
    besides the two is not read. No rows give a folder without rows.
    """
    spark = docs.sparkSession
    batch_rows.bound(spark)
    shards = shards or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD))
    rows = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_last())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text").withColumn("shard", F.spark_partition_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(partial(_encode, vocabulary=vocabulary, end=end), f"shard int, doc_id {kind}, shard_start long, n_tokens long, ids array<int>")
    options = {"orc.stripe.size": STRIPE, "orc.row.index.stride": STRIDE, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "compression": "zstd"}
    made.write.options(**{k: str(v) for k, v in options.items()}).orc(at)


def read(spark: SparkSession, at: str) -> DataFrame:
    """(shard, doc_id, shard_start, n_tokens, ids) of the files; filters on doc_id prune stripes and row groups."""
    return spark.read.orc(at)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"])


def index(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files; start counts the ids of all before it.

    Only one row a shard (its number of ids) passes through one task; the documents stay where they are read.
    """
    rows = read(spark, at)
    kind = rows.schema["doc_id"].dataType.simpleString()
    ends = rows.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select(F.col("shard").alias("of"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    digest = rows.mapInArrow(_check, f"shard int, doc_id {kind}, shard_start long, n_tokens long, ids_crc32 long")
    # one row a shard: as many as there are files, which do not grow with the documents in them
    return digest.join(F.broadcast(base), F.col("shard") == F.col("of")).select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
