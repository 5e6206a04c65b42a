"""Exact nearest neighbours by cosine, in blocks.

Rows and questions are packed into blocks of vectors.  Each pair of blocks is one matrix product in a
Python worker, which passes on the k best rows of each question, so what is shuffled is
k * questions * row blocks and no pair of vectors is a row of its own.  Question blocks are broadcast behind a
check of their number, and beyond it pairs of partitions are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.operators.keyword import TIE_DIGITS, TOP, top_k
from groundsearch.shipping import ship_package

BLOCK = 2048
#: Questions up to which their blocks are sent to every task: 60 MB of vectors of 384 dimensions.
BROADCAST_QUESTIONS = 40_000


def _packed(df: DataFrame, id_col: str, vector_col: str, block: int) -> DataFrame:
    """ids (packed int64), vectors (packed float32): blocks of rows; rows without a vector go."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                vectors = np.stack(part.column(1).to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], ["ids", "vectors"])

    return df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col).mapInArrow(pack, "ids binary, vectors binary")


def dense_topk(rows: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """query_id, id, dense_sim (cosine, in doubles), dense_rank; zero vectors are near nothing."""
    ship_package(rows.sparkSession)
    left = _packed(rows, id_col, vector_col, block)
    right = _packed(queries, query_id, query_vector, block).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def unit(raw: bytes, n: int) -> np.ndarray:
        v = np.frombuffer(raw, np.float32).reshape(n, -1).astype(np.float64)
        return v / np.where((norm := np.sqrt((v * v).sum(1, keepdims=True))) > 0, norm, np.nan)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, q_ids, q_vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                sims = unit(q_vectors, len(q_ids)) @ unit(vectors, len(ids)).T
                key = np.where(np.isnan(sims), -np.inf, np.round(sims, TIE_DIGITS))
                by = np.lexsort((np.broadcast_to(ids, key.shape), -key), axis=1)[:, :k]
                picked = np.take_along_axis(sims, by, 1)
                q = np.repeat(q_ids, by.shape[1])
                good = ~np.isnan(picked.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(q[good]), pa.array(ids[by].ravel()[good]), pa.array(picked.ravel()[good])], ["query_id", "id", "dense_sim"])

    if queries.select(query_id).limit(BROADCAST_QUESTIONS + 1).count() <= BROADCAST_QUESTIONS:
        right = F.broadcast(right)  # packed once, instead of once for each partition of rows
    found = left.crossJoin(right).mapInArrow(best, "query_id long, id long, dense_sim double")
    return top_k(found, "dense_sim", k, "dense_rank")


def dims_check(df: DataFrame, dims: int, vector_col: str = "vector") -> DataFrame:
    """df, where a vector of any other length than dims is an error when it is read."""
    message = F.concat(F.lit(f"expected {dims} dimensions, got "), F.coalesce(F.size(vector_col).cast("string"), F.lit("null")))
    ok = F.coalesce(F.size(vector_col) == dims, F.lit(False))
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
