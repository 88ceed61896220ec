"""Vectors in cells around centres, and exact search that reads few of them.

A vector lies in the cell of its nearest centre, by the angle; a cell's radius is the greatest distance of its unit vectors
from its centre.  By the triangle inequality no vector of a cell can be nearer to a query than the centre's
distance less the radius, which bounds its cosine.  A search reads the most promising cells first and
then those whose bound reaches the k-th score found, so it finds what a scan finds.

Vectors without a direction (null, empty, zero, not finite) and those of another length than the centres' have
cells of their own, which every search reads.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, IntegerType, StructField, StructType

from ..sources.shared import small_batches
from .search import vector_top_k

#: Vectors that a cell is made for, and cells of a table at most.
CELL_ROWS, MOST_CELLS = 4096, 256
#: Cell of what has no direction or another length.
APART = -1
#: Room for rounding in bounds.
SLACK = 1e-5
CELLS = "cell int, n long, radius float, centre array<float>"
log = logging.getLogger("gleaner")


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def centres_of(sample: list[list[float] | None], n: int) -> np.ndarray:
    """At most n different directions of a sample's commonest length."""
    usable = [x for x in sample if x and None not in x and np.isfinite(x).all() and any(x)]
    if not usable:
        return np.zeros((0, 0))
    lengths = [len(x) for x in usable]
    common = max(set(lengths), key=lambda k: (lengths.count(k), k))
    return np.unique(unit(np.array([x for x in usable if len(x) == common])), axis=0)[:n]


def with_cells(vectors: DataFrame, centres: np.ndarray, vector: str = "vector") -> DataFrame:
    """``vectors`` with cell and far (the distance from its centre)."""
    place = vectors.columns.index(vector)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = np.full(b.num_rows, APART, np.int32), np.zeros(b.num_rows, np.float32)
            values = b.column(place)
            if len(centres) and b.num_rows:
                own = np.flatnonzero(np.asarray(values.value_lengths().fill_null(-1)) == centres.shape[1])
                x = values.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                x, own = x[good] / norm[good, None], own[good]
                cell[own] = (x @ centres.T).argmax(axis=1)
                far[own] = np.linalg.norm(x - centres[cell[own]], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    small_batches(vectors.sparkSession)
    return vectors.mapInArrow(near, StructType([*vectors.schema.fields, StructField("cell", IntegerType()), StructField("far", FloatType())]))


def cells_of(written: DataFrame, centres: np.ndarray) -> DataFrame:
    """CELLS of a table with cells: at most MOST_CELLS + 1 rows."""
    spark = written.sparkSession
    at = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<float>")
    stats = written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    return stats.join(F.broadcast(at), "cell", "left").select("cell", "n", F.col("radius").cast("float").alias("radius"), "centre")


def bounds(cells: list[Row], query: list[float]) -> list[float]:
    """The greatest cosine that each cell can hold."""
    q = np.asarray(query, np.float64)
    norm = np.linalg.norm(q) if len(q) else 0.0
    out = []
    for c in cells:
        if c["centre"] is None or len(c["centre"]) != len(q) or not (np.isfinite(norm) and norm > 0):
            out.append(np.inf)
            continue
        gap = max(0.0, np.linalg.norm(q / norm - unit(np.array(c["centre"]))) - c["radius"] - SLACK)
        out.append(1 - gap * gap / 2 + SLACK)
    return out


def top_k_by_cells(read: Callable[[list], DataFrame], cells: list[Row], query: list[float], k: int, key: str = "chunk_id", vector: str = "vector") -> tuple[DataFrame, float]:
    """What ``vector_top_k`` finds, and the share of the vectors that were read; ``read`` gives the vectors of some of the cells."""
    most = bounds(cells, query)
    order = sorted(range(len(cells)), key=lambda i: -most[i])
    whole = sum(c["n"] for c in cells)
    if k <= 0 or whole <= k:
        return vector_top_k(read(cells), query, k, key, vector), 1.0
    first, held = [], 0
    for i in order:
        if held >= 2 * k and most[i] != np.inf:
            break
        first.append(i)
        held += cells[i]["n"]
    found = vector_top_k(read([cells[i] for i in first]), query, k, key, vector)
    scores = found.agg(F.count(F.lit(1)), F.min("score")).first()
    least = scores[1] if scores[0] == k else -np.inf
    chosen = [i for i in order if i in set(first) or most[i] >= least]
    share = sum(cells[i]["n"] for i in chosen) / max(1, whole)
    log.debug("%d of %d cells read, %.3f of the vectors", len(chosen), len(cells), share)
    if len(chosen) == len(first):
        return found, share
    return vector_top_k(read([cells[i] for i in chosen]), query, k, key, vector), share
