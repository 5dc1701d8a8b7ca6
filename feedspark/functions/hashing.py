"""Deterministic hash-of-key randomness (stable under repartitioning, reproducible in SQL)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(*parts) -> Column:
    """First 32 bits of md5(parts joined by '|'), as a bigint in [0, 2^32)."""
    joined = F.concat_ws("|", *[(_c(p) if not isinstance(p, (int, float)) else F.lit(p)).cast("string")
                               for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def hash32_text(c) -> Column:
    """``hash32`` of one string column (no join step: the same value, cheaper per row)."""
    return F.conv(F.substring(F.md5(_c(c)), 1, 8), 16, 10).cast("bigint")

