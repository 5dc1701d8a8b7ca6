"""Bounded labelled samples for fitting classifiers on the driver."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 1 << 30


def class_sample(rows: DataFrame, id_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """(sample, rows per class): about ``per_class`` rows of each class, by hash of the id, and never more
    than twice that in all; the same rows whatever the partitioning."""
    counts = {r[0]: r[1] for r in rows.where(F.col(label_col).isNotNull()).groupBy(label_col).count().collect()}
    if not counts:
        return rows.limit(0), counts
    h = F.pmod(F.xxhash64(id_col), F.lit(RANGE))
    chosen = functools.reduce(operator.or_, [(F.col(label_col) == F.lit(c)) & (h < F.lit(min(RANGE, int(RANGE * per_class / n) + 1))) for c, n in sorted(counts.items())])
    sample = rows.where(chosen).orderBy(h, F.col(id_col)).limit(2 * per_class * len(counts))
    return sample, counts
