"""Deterministic sampling and splitting by hash of key (the same rows on every run and layout)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import TWO_POW_32, hash32

# The reference's sampling parameters.
# Rows of the reference's evaluation sample (used by the sampled exact silhouette alone).
CLUSTER_EVAL_CAP = 3000
SEED = 42
TEST_FRACTION = 0.2
LIKE_PROBABILITY = 0.7


# Bits of the 32-bit sampling hash used to bucket rows when locating the n-th smallest hash.
HISTOGRAM_BITS = 16


def _among_smallest(keyed: DataFrame, n: int, order: list[str]) -> Column | None:
    """Whether a row is among the ``n`` rows of smallest (hash, key), which ``order`` names; None if all are.

    The n-th smallest value is found without sending ``n`` rows per input partition to one task
    (which is what ``orderBy(...).limit(n)`` does): rows are counted per bucket of the hash's top
    ``HISTOGRAM_BITS`` bits (a table of at most 2^16 rows reaches the driver), the bucket holding the
    n-th row is located, and only that bucket's rows go through a top-k. All rows of lower buckets
    are kept whole. The full rows are then filtered against the found (hash, key) value.
    """
    bucket = F.shiftright(F.col(order[0]), 32 - HISTOGRAM_BITS)
    hist = sorted((r[0], r[1]) for r in keyed.groupBy(bucket.alias("__b")).count().collect())
    if sum(c for _, c in hist) <= n:
        return None
    below = 0
    for b, c in hist:
        if below + c >= n:
            break
        below += c
    threshold = (keyed.where(bucket == b).select(*order).orderBy(*order).limit(n - below)
                      .agg(F.max(F.struct(*order)).alias("t")).scalar())
    return (bucket < b) | ((bucket == b) & F.coalesce(F.struct(*order) <= threshold, F.lit(False)))


def sample_rows(df: DataFrame, n: int, seed: int, key_cols: list[str]) -> DataFrame:
    """Keep the ``n`` rows with the smallest (hash(seed, key), key); all rows when there are at most ``n``."""
    keyed = df.withColumn("__h", hash32(seed, *key_cols))
    chosen = _among_smallest(keyed, n, ["__h", *key_cols])
    return (keyed if chosen is None else keyed.where(chosen)).drop("__h")


def split_test(df: DataFrame, seed: int, key_cols: list[str], test_fraction: float = TEST_FRACTION, exact: bool = False) -> DataFrame:
    """Add ``is_test``: hash(seed, key) / 2^32 < test_fraction (one pass, no shuffle); with ``exact`` the rows of smallest
    (hash, key), ceil(test_fraction * rows) of them (keys must differ)."""
    if not exact:
        return df.withColumn("is_test", hash32(seed, *key_cols) < F.lit(int(test_fraction * TWO_POW_32)))
    keyed = df.withColumn("__h", hash32(seed, *key_cols))
    chosen = _among_smallest(keyed, math.ceil(test_fraction * df.count() - 1e-9), ["__h", *key_cols])
    return keyed.withColumn("is_test", F.lit(True) if chosen is None else chosen).drop("__h")


def bernoulli_thin(df: DataFrame, p: float, seed: int, key_cols: list[str]) -> DataFrame:
    """Keep a row with probability p, decided by hash(seed, key) (a narrow filter)."""
    return df.where(hash32(seed, *key_cols) < F.lit(int(p * TWO_POW_32)))
