"""Per-group vector aggregation with one codegen'd hash aggregate (one partial row per map task)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_dim(df: DataFrame, vec: str) -> int:
    """Dimension of a vector column (reads one row)."""
    row = df.where(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).first()
    return int(row["d"]) if row else 0


def vector_mean(df: DataFrame, keys: list[str], vec: str, dim: int, weight: str | None = None,
                out: str = "mean_vec", count_col: str = "n") -> DataFrame:
    """Element-wise (weighted) mean of ``vec`` per key, plus the total weight ``count_col``.

    One hash aggregate with ``dim`` sums (one partial row per key per map task), written as a single
    SQL expression.
    """
    w = f"CAST(`{weight}` AS DOUBLE)" if weight else "1.0D"
    sums = "array(" + ", ".join(f"sum(`{vec}`[{i}] * {w})" for i in range(dim)) + ")"
    agg = df.groupBy(*keys).agg(F.expr(f"sum({w})").alias(count_col), F.expr(sums).alias("__sums"))
    return agg.select(*keys, F.col(count_col),
                      F.transform("__sums", lambda x: x / F.col(count_col)).alias(out))
