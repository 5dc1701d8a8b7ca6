"""Ordering helpers that avoid single-partition windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id(): partition index << 33 | row index in partition


def global_row_number(df: DataFrame, order_cols: list, name: str = "rn",
                      num_partitions: int | None = None, total_col: str | None = None) -> DataFrame:
    """``row_number() over (order by order_cols)`` computed without moving all rows to one task.

    Range-partition on the order, sort inside each partition, number rows locally, then add the
    row count of all earlier partitions (a table with one row per partition). ``order_cols`` must be
    a total order (end with a unique key) so the numbering is deterministic. ``total_col`` adds the
    total row count, taken from the same per-partition count table (no extra pass).

    The numbered rows are written once and both the counts and the result read that table: a plan
    that held the range exchange twice could sample different bounds for each and number rows wrongly.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = cut_lineage(df.repartitionByRange(n, *order_cols)
                          .sortWithinPartitions(*order_cols)
                          .withColumn("__mid", F.monotonically_increasing_id())
                          .withColumn("__pid", F.shiftright(F.col("__mid"), _LOCAL_BITS))
                          .withColumn("__lrn", F.col("__mid").bitwiseAND((1 << _LOCAL_BITS) - 1) + 1)
                          .drop("__mid"))
    counts = local.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    # One row per partition: a global window here is over at most n rows.
    offsets = counts.select("__pid", F.coalesce(
        F.sum("__cnt").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__off"), F.sum("__cnt").over(Window.partitionBy()).alias("__total"))
    out = (local.join(F.broadcast(offsets), "__pid")
                .withColumn(name, (F.col("__off") + F.col("__lrn")).cast("bigint"))
                .drop("__pid", "__lrn", "__off"))
    return out.withColumnRenamed("__total", total_col) if total_col else out.drop("__total")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep one row per key: the one with the smallest ``order`` (a total order within the key).

    The smallest order of each key is a hash aggregate over the narrow key and order columns (a hot
    key costs one row per map task); the wide rows meet it in a semi-join on key and order, whose
    hot keys can be split.
    """
    best = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    best = best.select(*keys, *[F.col("__first")[c].alias(c) for c in order])
    return df.join(best, [*keys, *order], "left_semi")


def top_n_per_group(df: DataFrame, partition: list[str], order: list[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """row_number within each group, keep rank <= n (planned as a WindowGroupLimit)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
