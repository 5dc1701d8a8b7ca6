"""Dense-vector expressions over ``array<double>`` columns (higher-order functions, JVM-side)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, also where a lambda within ``body`` reads it for every element."""
    return F.transform(F.array(value), body)[0]


def to_double_array(c) -> Column:
    return F.transform(_c(c), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector on either side scores 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def scale(a, s) -> Column:
    s = _c(s)
    return F.transform(_c(a), lambda x: x * s)


def with_l2_normalized(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Divide by the L2 norm; a zero vector is left as is. The norm is computed once per row."""
    out = out or col
    n = "__norm_" + col
    return (df.withColumn(n, norm(col))
              .withColumn(out, F.when(F.col(n) > 0, F.transform(F.col(col), lambda x: x / F.col(n)))
                          .otherwise(F.col(col)))
              .drop(n))


def is_zero(a) -> Column:
    return F.forall(_c(a), lambda x: x == 0)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def explode_vector(df: DataFrame, keys: list[str], vec: str, digits: int | None = 5,
                   pos: str = "pos", value: str = "value") -> DataFrame:
    """Long form (keys..., pos 0-based int, value double) for comparison and reporting."""
    out = df.select(*keys, F.posexplode(vec).alias(pos, value))
    v = F.col(value).cast("double")
    return out.withColumn(value, F.round(v, digits) if digits is not None else v) \
              .withColumn(pos, F.col(pos).cast("int"))
