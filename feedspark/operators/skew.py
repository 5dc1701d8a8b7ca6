"""Joins whose hot keys are known before the shuffle.

A frequency sketch of bounded size (``approx_top_k``, merged map-side) names the keys that hold more than ``share`` of the left
rows, at most 1 / ``share`` of them. Their right rows, if few (counted), are broadcast and meet the hot left rows where these lie; all
other rows are shuffled as usual. So a key with a third of all rows puts no more into one task than any other key.
The result is that of the plain join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the left rows that makes a key hot; keys that the sketch holds for each one asked for; most right rows of hot keys that are broadcast.
SHARE, ITEMS_PER_KEY, MOST_ROWS = 0.01, 50, 10_000
KINDS = ("inner", "left", "left_semi", "left_anti")


def hot_keys(left: DataFrame, key: str, share: float = SHARE) -> list:
    """Keys that may hold more than ``share`` of the rows (all that do, and few others): 1 / ``share`` at most."""
    k = max(1, min(1024, int(1 / share)))
    # the sketch's counts are upper bounds by its error, so no hot key falls below
    found = left.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k({key}, {k}, {k * ITEMS_PER_KEY})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [r["item"] for r in found["top"] or [] if r["count"] > share * found["n"]]


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = SHARE, most_rows: int = MOST_ROWS) -> DataFrame:
    """``left.join(right, key, how)`` with the hot keys of ``left`` joined by a broadcast of their right rows."""
    if how not in KINDS:
        raise ValueError(f"{how}: rows of the right side alone cannot be told apart in two parts")
    hot = hot_keys(left, key, share)
    if not hot:
        return left.join(right, key, how)
    few = right.where(F.col(key).isin(hot))
    if few.limit(most_rows + 1).count() > most_rows:  # many right rows for a hot key: the shuffle has to split them
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest = left.where(~is_hot).join(right.where(~is_hot), key, how)
    return left.where(is_hot).join(F.broadcast(few), key, how).unionByName(rest)
