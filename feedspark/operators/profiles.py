"""User profiles: liked items with vectors, mean profile vector, category counts, top topics."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_zero, with_l2_normalized, zeros
from .ranking import top_n_per_group
from .skew import split_join
from .vector_agg import vector_mean

# Categories too generic to drive a search, unless nothing else is left.
GENERIC_CATEGORIES = ("news", "general", "")
NUM_TOPICS = 3


def item_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("article_id").alias("item_id"), F.col("embedding"))


def liked_with_embedding(interactions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Likes whose item has a vector, with the vector (duplicates kept)."""
    return interactions.select("user_id", "item_id", "timestamp").join(item_vectors(embeddings), "item_id")


def user_item_counts(interactions: DataFrame) -> DataFrame:
    """Liked items per user in long form: (user_id, item_id, n_likes, first_liked).

    The per-user list is kept as rows, never as one array, so a heavy user is not one huge row.
    """
    return interactions.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_likes"), F.min("timestamp").alias("first_liked"))


def _liked_counts_with_vectors(interactions: DataFrame, embeddings: DataFrame, split_hot: bool = False) -> DataFrame:
    counts = interactions.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("w"))
    # a viral item's rows stay where they are, and its vector comes to them
    return split_join(counts, item_vectors(embeddings), "item_id") if split_hot else counts.join(item_vectors(embeddings), "item_id")


def profile_mean(interactions: DataFrame, embeddings: DataFrame, dim: int, split_hot: bool = False) -> DataFrame:
    """(user_id, n_liked, profile_mean): unnormalised mean vector of the liked items that have a
    vector; an item liked twice weighs twice. Users with no such item get no row."""
    joined = _liked_counts_with_vectors(interactions, embeddings, split_hot)
    return vector_mean(joined, ["user_id"], "embedding", dim, weight="w", out="profile_mean", count_col="n_liked") \
        .withColumn("n_liked", F.col("n_liked").cast("bigint"))


def user_profiles(interactions: DataFrame, embeddings: DataFrame, dim: int,
                  preferences: DataFrame | None = None, split_hot: bool = False) -> DataFrame:
    """(user_id, n_liked, profile_embedding L2-normalised, preferences array) for users with at
    least one liked item that has a vector. ``split_hot`` looks for items with a large share of the likes first (one more
    pass over them) and joins these apart."""
    prof = profile_mean(interactions, embeddings, dim, split_hot)
    prof = with_l2_normalized(prof, "profile_mean", "profile_embedding").drop("profile_mean")
    if preferences is not None:
        prof = prof.join(preferences.select("user_id", "preferences"), "user_id", "left")
        prof = prof.withColumn("preferences", F.coalesce("preferences", F.array().cast("array<string>")))
    else:
        prof = prof.withColumn("preferences", F.array().cast("array<string>"))
    return prof


def profile_embedding(interactions: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """Per user with likes: normalised mean of the found vectors, or zeros(dim) when none is found;
    ``is_zero`` flags the latter (every candidate then scores 0)."""
    users = interactions.select("user_id").distinct()
    prof = profile_mean(interactions, embeddings, dim)
    prof = with_l2_normalized(prof, "profile_mean", "profile_embedding").select("user_id", "profile_embedding")
    out = users.join(prof, "user_id", "left").withColumn(
        "profile_embedding", F.coalesce("profile_embedding", zeros(dim)))
    return out.withColumn("is_zero", is_zero("profile_embedding"))


def user_category_counts(interactions: DataFrame, embeddings: DataFrame, lookup: DataFrame) -> DataFrame:
    """(user_id, category, n): categories of the liked items that have a vector, duplicates counted;
    items without a known, non-empty category are ignored."""
    counts = interactions.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("w"))
    valid = counts.join(item_vectors(embeddings).select("item_id"), "item_id", "left_semi")
    cats = lookup.select(F.col("article_id").alias("item_id"), "category").where(
        F.col("category").isNotNull() & (F.col("category") != ""))
    return valid.join(cats, "item_id").groupBy("user_id", "category").agg(F.sum("w").cast("bigint").alias("n"))


def user_top_categories(cat_counts: DataFrame, n: int = NUM_TOPICS) -> DataFrame:
    """(user_id, topic_rank, category, n): top n by count desc then name; generic categories are
    dropped unless the user has nothing else."""
    generic = F.col("category").isin(*GENERIC_CATEGORIES)
    has_specific = F.max(F.when(~generic, 1).otherwise(0)).over(Window.partitionBy("user_id"))
    kept = cat_counts.withColumn("__hs", has_specific).where(~generic | (F.col("__hs") == 0)).drop("__hs")
    ranked = top_n_per_group(kept, ["user_id"], [F.col("n").desc(), F.col("category").asc()], n, "topic_rank")
    return ranked.select("user_id", F.col("topic_rank").cast("int"), "category", "n")
