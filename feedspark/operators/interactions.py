"""Operators on the given interactions table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERACTION_COLS = ("user_id", "item_id", "rating", "timestamp")


def preference_match(interactions: DataFrame, processed: DataFrame, preferences: DataFrame) -> DataFrame:
    """Interactions with an article whose category is one of the user's preferences (case-insensitive).

    The item's category is joined by item id, and the pair (user, category) semi-joined with the exploded
    preferences: the output never exceeds the given interactions.
    """
    prefs = (preferences.select("user_id", F.explode("preferences").alias("pref"))
             .select("user_id", F.lower("pref").alias("category")).distinct())
    arts = processed.where(F.col("category").isNotNull()).select(
        F.col("article_id").alias("item_id"), F.lower("category").alias("category"))
    return (interactions.join(arts, "item_id").join(prefs, ["user_id", "category"], "left_semi")
            .select(*INTERACTION_COLS))
