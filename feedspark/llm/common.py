"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a Python task: bounds its memory whatever the Arrow batch size.
ROWS_AT_ONCE = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most ``rows`` rows; empty ones are left out."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def crc32_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string")) % n


def lists(offsets, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(offsets if isinstance(offsets, pa.Array) else pa.array(offsets, pa.int32()), values)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], enough: int) -> Iterator[pa.Table]:
    """Tables of at least ``enough`` rows (but the last) that hold whole groups of the sorted columns ``keys`` (longs)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        other = np.zeros(rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            other |= column != column[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held)
