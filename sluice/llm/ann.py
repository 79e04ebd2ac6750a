"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors has its own codebook, fitted on a bounded sample; a vector's cell is the pair of its
nearest centroids. A query walks pairs of centroids in order of their summed distance (here: falling summed inner
product) with a heap, until the cells passed hold enough vectors, and the vectors of those cells are reranked by
the exact measure. How many are enough is measured: some queries are searched by brute force over all rows, and
the walk is made as long as AIM of their true neighbours need. All rows are indexed and reranked in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.plans import scratch

#: Bounds of the sample the codebooks are fitted on, of the queries that measure the walk, and of a block.
SAMPLE, MEASURED, BLOCK = 20_000, 128, 4096
AIM, ROUNDS, CHUNK, PART = 0.96, 12, 256, 16
#: Centroids of a half, at most: cells hold about 64 vectors up to a quarter of a billion, and more beyond.
MOST = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a finite vector other than zero, of the most common length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND size(embedding) > 0")
    rows = rows.where(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return rows.where(F.size("embedding") == (common["width"] if common else 0))


def _matrix(column) -> np.ndarray:
    """Rows of a list column of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1) - 2 * rows @ book.T).argmin(1)


def fit(sample: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the two halves by Lloyd's rounds, from evenly spread distinct rows."""
    half = (sample.shape[1] + 1) // 2
    books = []
    for rows in (sample[:, :half], sample[:, half:]):
        distinct = np.unique(rows, axis=0)
        draw = np.random.default_rng(7).permutation(len(distinct))[: min(size, len(distinct))]
        book = distinct[draw].copy()
        for _ in range(ROUNDS):
            near = _nearest(rows, book)
            total = np.zeros_like(book)
            np.add.at(total, near, rows)
            held = np.bincount(near, minlength=len(book))
            book[held > 0] = total[held > 0] / held[held > 0, None]
        books.append(book)
    return books[0], books[1]


class Index:
    """Codebooks, members of each cell, and the blocks of cells."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.half = books, books[0].shape[1]
        self.shape = (len(books[0]), len(books[1]))
        self.enough = 0

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return _nearest(rows[:, : self.half], self.books[0]) * self.shape[1] + _nearest(rows[:, self.half :], self.books[1])

    def hold(self, counts: np.ndarray, block: int) -> None:
        """Cells in order share blocks of about ``block`` members; larger cells have several."""
        self.counts = counts
        self.split = np.maximum(1, -(-counts // block))
        alone = self.split > 1
        filled, at, self.base = 0, 0, np.zeros(len(counts), np.int64)
        for c in range(len(counts)):
            if filled and (alone[c] or filled + counts[c] > block):
                at, filled = at + 1, 0
            self.base[c] = at
            filled += int(counts[c])
            if alone[c]:
                at, filled = at + int(self.split[c]), 0
        self.blocks = at + 1

    def affinities(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return queries[:, : self.half] @ self.books[0].T, queries[:, self.half :] @ self.books[1].T

    def walk(self, a: np.ndarray, b: np.ndarray):
        """Cells in falling order of a[i] + b[j]: a heap holds one open pair a row of the sorted lists."""
        i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap = [(-(a[i_of[0]] + b[j_of[0]]), 0, 0)]
        while heap:
            far, i, j = heapq.heappop(heap)
            yield int(i_of[i]) * self.shape[1] + int(j_of[j])
            if j + 1 < len(j_of):
                heapq.heappush(heap, (-(a[i_of[i]] + b[j_of[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(i_of):
                heapq.heappush(heap, (-(a[i_of[i + 1]] + b[j_of[0]]), i + 1, 0))

    def visited(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells walked until they hold more than ``enough`` vectors."""
        seen, held = [], 0
        for cell in self.walk(a, b):
            if self.counts[cell]:
                seen.append(cell)
                held += int(self.counts[cell])
                if held > self.enough:
                    break
        return np.array(seen, np.int64)

    def passed(self, a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> list[int]:
        """Vectors in the cells before each wanted cell."""
        held, before = 0, {}
        for cell in self.walk(a, b):
            before[cell] = held
            held += int(self.counts[cell])
        return [before[c] for c in wanted.tolist()]


def best(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None):
    """(query, positions, scores) of each query's k best rows: largest inner product, then smallest id.

    Products of whole blocks choose; what may be among the best is scored again one pair at a time, in an order of
    summation that does not depend on the block, so that equal vectors tie exactly.
    """
    rough = queries @ rows.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    if allowed is not None:
        rough[~allowed] = -np.inf
    for q in range(len(queries)):
        open_ = np.flatnonzero(rough[q] > -np.inf)
        if not len(open_):
            continue
        scores = rough[q, open_]
        if len(open_) > k:
            least = np.partition(scores, -k)[-k]
            open_ = open_[scores >= least - 1e-9 * max(1.0, abs(least))]
        exact = (rows[open_] * queries[q]).sum(1)
        order = np.lexsort((ids[open_], -exact))[:k]
        yield q, open_[order], exact[order]


def _cells(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index.value.cells(_matrix(batch.column(1))).astype(np.int32) if len(batch) else [], pa.int32())], ["vec_id", "embedding", "cell"])


def _brute(batches: Iterator[pa.RecordBatch], asked, k: int) -> Iterator[pa.RecordBatch]:
    """Each batch's k best for the measured queries."""
    own, queries = asked.value
    for batch in batches:
        if len(batch):
            ids, cells, out = batch.column(0).to_numpy(), batch.column(2).to_numpy(), []
            for q, at, scores in best(queries, own, _matrix(batch.column(1)), ids, k):
                out += zip([int(own[q])] * len(at), scores.tolist(), ids[at].tolist(), cells[at].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.float64(), pa.int64(), pa.int32()), strict=True)], ["query_id", "score", "vec_id", "cell"])


def _chunks(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    """Queries in chunks, once for each block that a query of the chunk walks into."""
    index = index.value
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.slice(at, CHUNK)
            queries = _matrix(part.column(1))
            a, b = index.affinities(queries)
            walked: dict[int, list[int]] = {}
            for q in range(len(queries)):
                for cell in index.visited(a[q], b[q]).tolist():
                    walked.setdefault(cell, []).append(q)
            blocks: dict[int, dict[int, list[int]]] = {}
            for cell, who in walked.items():
                for k in range(int(index.split[cell])):
                    blocks.setdefault(int(index.base[cell]) + k, {})[cell] = who
            for block, held in blocks.items():
                allowed = np.zeros((len(queries), len(held)), bool)
                for j, who in enumerate(held.values()):
                    allowed[who, j] = True
                keep = np.flatnonzero(allowed.any(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([int(part.column(0)[0].as_py()) // 20], pa.int64()),
                        pa.array([part.column(0).to_numpy()[keep].astype("<i8").tobytes()]),
                        pa.array([queries[keep].astype("<f8").tobytes()]),
                        pa.array([np.array(list(held), "<i4").tobytes()]),
                        pa.array([np.packbits(allowed[keep]).tobytes()]),
                    ],
                    ["block", "chunk", "ids", "queries", "cells", "allowed"],
                )


def _rerank(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Vectors of one block against chunks of queries."""
    out = ([], [], [])
    if left.num_rows and right.num_rows:
        ids, rows, cells = left.column("vec_id").to_numpy(), _matrix(left.column("embedding")), left.column("cell").to_numpy()
        for chunk in right.select(["ids", "queries", "cells", "allowed"]).to_pylist():
            own = np.frombuffer(chunk["ids"], "<i8")
            queries = np.frombuffer(chunk["queries"], "<f8").reshape(len(own), -1)
            held = np.frombuffer(chunk["cells"], "<i4")
            mask = np.unpackbits(np.frombuffer(chunk["allowed"], np.uint8), count=len(own) * len(held)).reshape(len(own), -1).astype(bool)
            order = np.argsort(held)
            spot = np.minimum(np.searchsorted(held[order], cells), len(held) - 1)
            known = held[order][spot] == cells
            for q, at, scores in best(queries, own, rows, ids, k, mask[:, order[spot]] & known):
                out[0].append(int(own[q]))
                out[1].append(ids[at].tolist())
                out[2].append(scores.tolist())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` its k nearest other rows.

    Nearness is the largest inner product in double precision, ties to the smaller vec_id; queries with fewer
    candidates return all found. Vectors that are null, zero, of an uncommon length, or hold null or non-finite
    components take no part, nor do rows without an id; rows that share the query's id are its own. Repeated
    vectors tie. No usable vectors give no rows; other columns are not read. At AIM, about 0.96 of the true
    neighbours are found; on vectors without structure the walk is long, on clustered ones short.
    """
    spark = vectors.sparkSession
    rows = scratch.keep(usable(vectors), "vectors")
    total = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    share = lambda n, of: F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < max(1, int(min(1.0, n / max(1, of)) * (1 << 20)))
    sample = _matrix(rows.where(share(SAMPLE, total)).select("embedding").toArrow().column(0))
    if not len(sample):
        sample = _matrix(rows.limit(1).select("embedding").toArrow().column(0))
    index = Index(fit(sample, min(MOST, max(8, int(total**0.5 / 8)))))
    placed = scratch.keep(rows.mapInArrow(partial(_cells, index=spark.sparkContext.broadcast(index)), "vec_id long, embedding array<double>, cell int"), "cells")
    counts = np.zeros(index.shape[0] * index.shape[1], np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most MOST * MOST rows of two numbers
        counts[r["cell"]] = r["count"]
    index.hold(counts, min(BLOCK, max(64, total // 64)))

    queries = placed.where(F.col("vec_id") % every == 0)
    asked = queries.where(share(MEASURED, queries.count())).select("vec_id", "embedding").limit(4 * MEASURED).toArrow()
    if asked.num_rows:
        own, matrix = asked.column(0).to_numpy(), _matrix(asked.column(1))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        near = placed.mapInArrow(partial(_brute, asked=spark.sparkContext.broadcast((own, matrix)), k=k), "query_id long, score double, vec_id long, cell int")
        true: dict[int, list[int]] = {}
        for r in near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect():
            true.setdefault(r["query_id"], []).append(r["cell"])
        a, b = index.affinities(matrix)
        passed = [n for q, one in enumerate(own.tolist()) for n in index.passed(a[q], b[q], np.array(true.get(one, []), np.int64))]
        index.enough = int(np.quantile(passed, AIM, method="higher")) if passed else total
    else:
        index.enough = total

    shared = spark.sparkContext.broadcast(index)
    asking = queries.repartitionByRange(max(1, -(-total // every // CHUNK)), "cell", "vec_id").select("vec_id", "embedding")
    chunks = asking.mapInArrow(partial(_chunks, index=shared), "block long, chunk long, ids binary, queries binary, cells binary, allowed binary")
    chunks = scratch.keep(chunks, "chunks")
    parts = max(1, -(-(total // every) // (CHUNK * PART)))
    base = F.array(*(F.lit(int(x)) for x in index.base)) if len(index.base) <= 1024 else None
    split = F.array(*(F.lit(int(x)) for x in index.split)) if base is not None else None
    if base is None:
        table = spark.createDataFrame(pa.table({"cell": np.arange(len(index.base), dtype=np.int32), "base": index.base, "split": index.split}))
        blocked = placed.join(F.broadcast(table), "cell")  # at most MOST * MOST rows of three numbers
        block = F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("split"))
    else:
        blocked = placed
        block = F.element_at(base, F.col("cell") + 1).cast("long") + F.pmod(F.xxhash64("vec_id"), F.element_at(split, F.col("cell") + 1))
    chunks = chunks.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int"))
    # a block goes only to the parts whose queries walk into it
    wanted = chunks.groupBy("block").agg(F.collect_set("part").alias("parts"))
    blocked = blocked.select("vec_id", "embedding", "cell", block.alias("block")).join(wanted, "block")
    blocked = blocked.select("vec_id", "embedding", "cell", "block", F.explode("parts").alias("part"))
    found = blocked.groupBy("block", "part").cogroup(chunks.groupBy("block", "part")).applyInArrow(partial(_rerank, k=k), "query_id long, ids array<long>, scores array<double>")
    flat = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select("query_id", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
