"""Packing documents into sequences of a fixed length by patterns and non-negative least squares.

Lengths of pieces make a histogram of at most ``length`` bins. Patterns of few pieces that fill a sequence (one,
two, and three or four on a grid of common lengths) get repeat counts by non-negative least squares against the
histogram; the counts are rounded and cut to what is there, and what is left is packed best fit on the histogram
itself: the fullest sequence that takes the next length, many equal sequences at once. All this works on the
histogram, which does not grow with the corpus. Pieces then take the places of their length in order of a hash,
each from its rank, computed by partial sums over (length, bucket).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm import batches as batch_rows
from sluice.llm.tokens import encoder
from sluice.plans import scratch

LENGTH, END = 2048, 0
#: Pieces of one length are ranked in buckets of about 1/RANKS of all pieces.
RANKS = 2000


@batch_rows.returning
def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, length: int, end: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, stop, ids, at in encoder(vocabulary).encode(batch.column(1)):
            ids = np.insert(ids, at[1:], end).astype("<u4")
            at = at + np.arange(len(at))
            sizes = np.diff(at)
            parts = -(-sizes // length)
            row = np.repeat(np.arange(stop - first), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * length
            held = np.minimum(length, sizes[row] - start)
            begin = at[row] + start
            sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(begin.tolist(), held.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row + first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(held), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
    encoder(vocabulary).forget()


def _patterns(counts: np.ndarray, length: int) -> list[tuple[int, ...]]:
    """Patterns of up to four lengths that fill a sequence: all pairs, and triples and quadruples of common lengths."""
    present = np.flatnonzero(counts)
    found = {(n, length - n) for n in present if n <= length - n and counts[length - n]}
    common = np.sort(present[np.argsort(-counts[present], kind="stable")][:96])
    for i, a in enumerate(common):
        for b in common[i:]:
            c = length - a - b
            if c >= b and counts[c]:
                found.add((a, b, c))
    for i, a in enumerate(common[::3]):
        for j, b in enumerate(common[::3][i:], i):
            for c in common[::3][j:]:
                d = length - a - b - c
                if d >= c and counts[d]:
                    found.add((a, b, c, d))
    return sorted(tuple(int(x) for x in p) for p in found)


def _least_squares(counts: np.ndarray, patterns: list[tuple[int, ...]], sweeps: int = 30) -> np.ndarray:
    """Repeat counts >= 0 that come near the histogram: coordinate descent on the squared error."""
    repeat, left = np.zeros(len(patterns)), counts.astype(float)
    columns = [(np.array(k), np.array(v, float), float(np.dot(v, v))) for k, v in (np.unique(p, return_counts=True) for p in patterns)]
    for _ in range(sweeps):
        moved = 0.0
        for j, (k, v, norm) in enumerate(columns):
            step = max(-repeat[j], float(left[k] @ v) / norm)
            if step:
                repeat[j] += step
                left[k] -= step * v
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return repeat


def _best_fit(left: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeats for all of a histogram: longest first, each into the fullest sequence that takes it."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    for n in range(length, 0, -1):
        todo = int(left[n])
        while todo:
            space = min((r for r in room if r >= n), default=None)
            if space is None:
                fill = length // n
                whole, rest = divmod(todo, fill)
                for k, times in ((fill, whole), (rest, 1)):
                    if k and times:
                        put = room.setdefault(length - k * n, {})
                        put[(n,) * k] = put.get((n,) * k, 0) + times
                todo = 0
                continue
            held, times = room[space].popitem()
            used = min(todo, times)
            if times > used:
                room[space][held] = times - used
            if not room[space]:
                del room[space]
            put = room.setdefault(space - n, {})
            put[(*held, n)] = put.get((*held, n), 0) + used
            todo -= used
    return [(p, k) for at in room.values() for p, k in at.items()]


def plan(counts: np.ndarray, length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold exactly the pieces of a histogram (index: length)."""
    left = counts.copy()
    out = [((length,), int(left[length]))] if left[length] else []
    left[length] = 0
    patterns = _patterns(left, length)
    for p, x in sorted(zip(patterns, _least_squares(left, patterns), strict=True), key=lambda e: -e[1]):
        k, v = np.unique(p, return_counts=True)
        times = min(int(round(x)), int((left[k] // v).min()))
        if times > 0:
            out.append((p, times))
            left[k] -= times * v
    return out + _best_fit(left, length)


def _places(packed: list[tuple[tuple[int, ...], int]], length: int) -> dict[str, np.ndarray]:
    """Runs of places by length: ranks from ``rank`` on have sequences from ``first`` on, at ``offset``."""
    rows, sequence, taken = [], 0, np.zeros(length + 1, np.int64)
    for pattern, times in packed:
        at = 0
        for n in pattern:
            rows.append((n, int(taken[n]), sequence, at))
            taken[n] += times
            at += n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << np.int64(44) | table[:, 1], "rank": table[:, 1], "first": table[:, 2], "offset": table[:, 3]}


def _assign(batches: Iterator[pa.RecordBatch], places) -> Iterator[pa.RecordBatch]:
    at = places.value
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        run = np.searchsorted(at["key"], length << np.int64(44) | rank, "right") - 1
        keep = [batch.column(i) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(at["first"][run] + rank - at["rank"][run]), pa.array(at["offset"][run])], [*batch.schema.names[:5], "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A document's ids end with ``end``; only documents above ``length`` ids are cut. A null or empty text is one
    piece of one id. Null and repeated doc_ids keep a piece each. No rows give none; other columns are not read.
    Sequences hold their pieces without gaps from offset 0. The driver holds the histogram and the patterns only,
    at most ``length`` bins and a few thousand runs, whatever the corpus.
    """
    spark = docs.sparkSession
    batch_rows.bound(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(partial(_pieces, vocabulary=vocabulary, length=length, end=end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = scratch.keep(made, "pieces")
    counts = np.zeros(length + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():
        counts[n] = c
    places = spark.sparkContext.broadcast(_places(plan(counts, length), length))
    split = np.maximum(1, -(-counts * RANKS // max(1, counts.sum())))
    spread = F.array(*(F.lit(int(x)) for x in split))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(spread, (F.col("length") + 1).cast("int"))))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most ``length`` + RANKS rows
    base = bucketed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = bucketed.withColumn("own", F.row_number().over(own)).join(F.broadcast(base), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(partial(_assign, places=places), f"{made.schema.simpleString()[7:-1].replace(':', ' ')}, sequence_id long, offset long".replace(",", ", "))
