"""Exact cosine search: all vectors against a bounded block of queries at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries whose vectors travel to every task together.
BLOCK = 4_096


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm == 0, 1, norm)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right width as doubles, and their places."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(sizes == width)
    return np.array(column.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width), ok


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the k nearest vectors by cosine of every query (query_id, vector_col).

    A zero vector stays zero and scores 0. Vectors of another width than the queries, and null ones, are no candidates.
    Each task keeps its own k best of every query, so the shuffle carries k rows per query and task. Ties: smaller id.
    """
    if k < 1:
        raise ValueError("k must be positive")
    n = queries.count()
    parts = []
    for block in range(max(1, -(-n // BLOCK))):
        held = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // BLOCK)))) == block).orderBy("query_id").collect()
        width = max((len(r[vector_col]) for r in held if r[vector_col] is not None), default=0)
        held = [r for r in held if r[vector_col] is not None and len(r[vector_col]) == width]
        names = np.array([r["query_id"] for r in held], np.int64)
        wanted = _unit(np.array([r[vector_col] for r in held], float).reshape(len(held), width))

        def best(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, wanted: np.ndarray = wanted, width: int = width) -> Iterator[pa.RecordBatch]:
            # the task's k best of each query so far (query, place); -1 stands for none
            held, top = np.full((len(names), 0), -1, np.int64), np.full((len(names), 0), -np.inf)
            for batch in batches:
                if not len(names) or not batch.num_rows:
                    continue
                rows, ok = _matrix(batch.column(vector_col), width)
                ids = batch.column(id_col).cast(pa.int64()).to_numpy(zero_copy_only=False)[ok]
                scores = wanted @ _unit(rows).T
                if scores.shape[1] > k:  # what scores below the k-th of the batch is no candidate; ties with it are
                    least = np.partition(scores, -k, axis=1)[:, -k]
                    some = np.flatnonzero((scores >= least[:, None]).any(axis=0))
                    scores, ids = scores[:, some], ids[some]
                top = np.concatenate([top, scores], axis=1)
                held = np.concatenate([held, np.broadcast_to(ids, scores.shape)], axis=1)
                order = np.lexsort((held, -top), axis=1)[:, :k]
                top, held = np.take_along_axis(top, order, 1), np.take_along_axis(held, order, 1)
            n = held.shape[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(held.ravel()), pa.array(top.ravel())], names=["query_id", id_col, "score"])

        parts.append(vectors.select(id_col, vector_col).mapInArrow(best, f"query_id long, {id_col} long, score double"))
    found = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col)))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
