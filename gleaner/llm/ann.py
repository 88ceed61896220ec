"""Nearest neighbours by inner product: a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks; each pair of blocks meets in one task (an
equi-join on block numbers).  A candidate is sent once for each block of queries, and a block
holds tens of thousands of them, so the copies stay few.  Equal vectors of a block are one
candidate with as many of its smallest ids as any query can take, so a vector that a third of
all rows share costs no more than another.  A matrix product of int8 codes gives every inner
product up to a bound that follows from the quantisation errors.  Pairs whose upper bound reaches the
k-th best lower bound are computed again from the original vectors in double precision, and
heaps merge them, first within a task and then over the tasks of a query.  The bounds are
exact, so the result is that of brute force.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part; vectors of different lengths never meet; a query never finds rows of its own id;
repeated candidate rows count as rows, repeated queries as one; queries of one id with different
vectors are one query, whose k rows are the best for any of them; ties go to the smaller id;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches

#: Numbers in a block of queries and in one of candidates, at most; fewer candidates than fill the session's
#: partitions are dealt in smaller blocks, down to LEAST_VALUES.
QUERY_VALUES, BLOCK_VALUES, LEAST_VALUES = 1 << 21, 1 << 23, 1 << 19
#: Queries and candidates whose codes are multiplied at once, and pairs computed again at once.
ROWS, TILE, PAIRS = 1024, 4096, 1 << 15


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and each row's step."""
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    return np.rint(x / step).astype(np.int8), step


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def grouped(ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Distinct vectors, and of each its ids in order: those that the k best rows without any one id can need."""
    _, first, which = np.unique(np.ascontiguousarray(c).view(f"V{8 * c.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, which))
    listed = []
    for own in np.split(ids[order], np.flatnonzero(np.diff(which[order])) + 1):
        own = own.tolist()
        if len(own) > k + 1:
            kept: dict[int, int] = {}
            for i in own:
                if i in kept or len(kept) <= k:
                    kept[i] = min(k, kept.get(i, 0) + 1)
            own = [i for i, n in kept.items() for _ in range(n)]
        listed.append(own)
    return c[first], listed


def search_block(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query a heap of its k best (score, -id) among the candidates."""
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of codes stay exact
    c, listed = grouped(ids, c, k)
    alone = np.array([x[0] == x[-1] for x in listed])
    only = np.array([x[0] for x in listed])
    q8, q_step = quantised(q)
    q_back = q8 * q_step
    q_error, q_norm = np.linalg.norm(q - q_back, axis=1)[:, None], np.linalg.norm(q_back, axis=1)[:, None]
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)
    for low in range(0, len(c), TILE):
        x = c[low : low + TILE]
        x8, x_step = quantised(x)
        x_norm, x_error = np.linalg.norm(x, axis=1), np.linalg.norm(x - x8 * x_step, axis=1)
        x_codes = x8.T.astype(kind)
        for top in range(0, len(q), ROWS):
            some = slice(top, top + ROWS)
            near = (q8[some].astype(kind) @ x_codes).astype(np.float64) * q_step[some] * x_step.T
            bound = (q_error[some] * x_norm + q_norm[some] * x_error) * (1 + 1e-9) + 1e-9 * q_norm[some] * x_norm
            own = (query_ids[some, None] == only[None, low : low + TILE]) & alone[low : low + TILE]
            if near.shape[1] >= k:
                lower = np.where(own, -np.inf, near - bound)
                floor[some] = np.fmax(floor[some], np.partition(lower, -k, axis=1)[:, -k])
            at_q, at_x = np.nonzero(~(near + bound < floor[some, None]) & ~own)
            at_q += top
            for n in range(0, len(at_q), PAIRS):
                i_, j_ = at_q[n : n + PAIRS], at_x[n : n + PAIRS]
                for i, own_id, s, j in zip(i_.tolist(), query_ids[i_].tolist(), in_order(q[i_], x[j_]).tolist(), (j_ + low).tolist()):
                    heap = heaps[i]
                    for v in listed[j]:
                        if v == own_id:
                            continue
                        if len(heap) < k:
                            heapq.heappush(heap, (s, -v))
                        elif (s, -v) > heap[0]:
                            heapq.heapreplace(heap, (s, -v))
                        else:
                            break
            floor[some] = np.fmax(floor[some], [h[0][0] if len(h) == k else -np.inf for h in heaps[some]])
    return heaps


def rows_of(heaps: dict[int, list[tuple[float, int]]], id_type: pa.DataType, ranked: bool) -> pa.RecordBatch:
    found = [(q, rank, -v, s) for q, heap in heaps.items() for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
    columns = list(zip(*found)) or [[], [], [], []]
    arrays = [pa.array(columns[0], id_type), pa.array(columns[1], pa.int32()), pa.array(columns[2], id_type), pa.array(columns[3], pa.float64())]
    names = ["query_id", "rank", "vec_id", "score"]
    keep = [0, 1, 2, 3] if ranked else [0, 2, 3]
    return pa.RecordBatch.from_arrays([arrays[i] for i in keep], [names[i] for i in keep])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    small_batches(spark)
    pick = lambda df: df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    vectors, queries = pick(vectors), pick(queries).dropDuplicates(["id", "v"])
    size = vectors.agg(F.count(F.lit(1)), F.max("dim")).first()
    values = size[0] * (size[1] or 1)
    n_queries = max(1, -(-queries.count() * (size[1] or 1) // QUERY_VALUES))
    n_blocks = max(1, -(-values // BLOCK_VALUES), min(-(-partitions(spark) // n_queries), -(-values // LEAST_VALUES)))
    deal = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = deal(queries, "query_block", n_queries, "block", n_blocks)
    right = deal(vectors, "block", n_blocks, "query_block", n_queries)
    on = ["dim", "query_block", "block"]

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        heaps: dict[int, list[tuple[float, int]]] = {}
        if q.num_rows and c.num_rows:
            ids = q["id"].to_numpy()
            for i, heap in zip(ids.tolist(), search_block(ids, matrix(q["v"]), c["id"].to_numpy(), matrix(c["v"]), k)):
                heaps[i] = heapq.nlargest(k, heaps.get(i, []) + heap)
        return pa.Table.from_batches([rows_of(heaps, pa.int64(), False)])

    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(tile, "query_id long, vec_id long, score double")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come query by query: only one heap is held, and what a batch completes goes on."""
        query, heap = None, []
        for b in batches:
            done: dict[int, list[tuple[float, int]]] = {}
            for i, v, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if i != query:
                    if heap:
                        done[query] = heap
                    query, heap = i, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
            yield rows_of(done, pa.int64(), True)
        if heap:
            yield rows_of({query: heap}, pa.int64(), True)

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merged, "query_id long, rank int, vec_id long, score double")
