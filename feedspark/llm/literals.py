"""Small constant tables as SQL expressions (no RDD, no Python on executors)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constant_table(spark: SparkSession, names: list[str], rows: list[tuple], types: list[str]) -> DataFrame:
    """A table of the given rows; for parameters, whose number is bounded by the program text."""
    schema = f"array<struct<{', '.join(f'{n}:{t}' for n, t in zip(names, types))}>>"

    def literal(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    made = F.array(*[F.struct(*[literal(v).cast(t).alias(n) for v, n, t in zip(r, names, types)]) for r in rows]) if rows else F.array()
    return spark.range(1).select(F.inline(made.cast(schema)))
