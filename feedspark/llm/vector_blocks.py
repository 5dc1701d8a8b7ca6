"""Vectors in blocks: a stated query set against all rows without pairs of rows ever being shuffled.

Candidates and queries are dealt over tasks by round robin and packed into blocks of a bounded number
of rows; each block is one row that holds its ids and its vectors. A candidate block travels once, to the task of its
number, and is prepared there once (codes, postings, bounds); all query blocks are sent to every candidate
block, and a search function returns the block's best rows of each query, which are merged by query.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_ROWS, QUERY_ROWS = 8192, 512
BLOCK = "block int, ids binary, dim int, vectors binary"
#: (query ids, query vectors) -> query positions, candidate ids, scores
Search = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: (candidate ids, candidate vectors) -> the search function of this block
Prepare = Callable[[np.ndarray, np.ndarray], Search]


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the column that are whole (not null, no null or non-finite component), as positions and a matrix of doubles padded by zeros."""
    rows = [(i, v) for i, v in enumerate(column.to_pylist()) if v is not None and None not in v]
    dim = max((len(v) for _, v in rows), default=0)
    m = np.zeros((len(rows), dim))
    for k, (_, v) in enumerate(rows):
        m[k, :len(v)] = v
    good = np.isfinite(m).all(axis=1)
    return np.array([i for i, _ in rows], np.int64)[good], m[good]


def blocks(rows: DataFrame, id_col: str, vector_col: str, size: int, count: int, drop_zero: bool) -> DataFrame:
    """Blocks of at most ``size`` vectors, about ``count`` rows in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                at, m = _matrix(part.column(1))
                if drop_zero:
                    some = m.any(axis=1)
                    at, m = at[some], m[some]
                if len(at):
                    ids = part.column(0).to_numpy(zero_copy_only=False)[at].astype("<i8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int32()), pa.array([ids.tobytes()]), pa.array([m.shape[1]], pa.int32()),
                         pa.array([m.astype("<f8").tobytes()])], names=["block", "ids", "dim", "vectors"])

    n = max(1, math.ceil(count / size))
    return rows.select(id_col, vector_col).where(F.col(id_col).isNotNull()).repartition(n).mapInArrow(run, BLOCK)


def _fit(m: np.ndarray, dim: int) -> np.ndarray:
    """Columns of a query for candidates of ``dim`` components: missing ones are 0, and those beyond meet nothing but 0."""
    return m[:, :dim] if m.shape[1] >= dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best different ids: highest score first, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    at = at[np.lexsort((ids[at], -scores[at]))]
    different = np.unique(ids[at], return_index=True)[1]
    if len(different) < len(at):  # repeated rows: an id counts once, at its best
        if len(different) < k < len(scores):
            at = np.lexsort((ids, -scores))
            different = np.unique(ids[at], return_index=True)[1]
        at = at[np.sort(different)]
    return at[:k]


def search(rows: DataFrame, is_query: Column, k: int, prepare: Prepare, score_type: str, id_col: str = "vec_id",
           vector_col: str = "embedding", drop_zero: bool = False) -> DataFrame:
    """(query_id, rank, id_col, score): the k best rows of each query by the search functions that ``prepare`` makes of the blocks."""
    rows = rows.select(id_col, vector_col)
    is_query = F.coalesce(is_query, F.lit(False))
    n, n_query = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    n_blocks = max(1, math.ceil(n / CANDIDATE_ROWS))
    candidates = blocks(rows, id_col, vector_col, CANDIDATE_ROWS, n, drop_zero).withColumn("asks", F.lit(0))
    queries = blocks(rows.where(is_query), id_col, vector_col, QUERY_ROWS, n_query, drop_zero).withColumn("asks", F.lit(1))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    # a task may hold several pieces of a block (few rows each): every piece is prepared, and asked, by itself
    stream = candidates.unionByName(queries).repartition(n_blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(j)[r].as_py() for j, name in enumerate(batch.schema.names)}
                ids, x = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                if row["block"] != number:
                    number, held = row["block"], []
                if not row["asks"]:
                    held.append((row["dim"], prepare(ids, x)))
                    continue
                for dim, asked in held:
                    at, found, scores = asked(ids, _fit(x, dim))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(scores)], names=["query_id", id_col, "score"])

    found = stream.mapInArrow(run, f"query_id long, `{id_col}` long, score {score_type}")
    # one exchange by query serves both steps
    merged = found.repartition("query_id").groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return (merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col(id_col).cast("long").alias(id_col), "score"))
