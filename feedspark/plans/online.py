"""Online run (the reference's second script): recommendations from the offline artifacts.

usage: python -m feedspark.plans.online --artifacts DIR --sf-dir DIR [--user ID ...] [--out DIR]
"""
from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import profiles as P
from ..operators.encoder import Encoder, HashedBagOfWords
from ..operators.recommend import NUM_RECOMMENDATIONS, recommend
from ..sources import artifacts as AR


def run_online(spark: SparkSession, artifacts_dir: str, search_results: DataFrame, pages: DataFrame,
               encoder: Encoder | None = None, users: list[str] | None = None,
               n: int = NUM_RECOMMENDATIONS, main_text: bool = False) -> DataFrame:
    """Recommendations for all profiled users (or only ``users``).

    Profiles are rebuilt from the stored likes and the *base* embeddings (the reference recomputes
    them that way); categories come from the processed-article artifact.
    """
    enc = encoder or HashedBagOfWords()
    arts, ok = AR.load_artifacts(spark, artifacts_dir)
    if not ok:
        missing = [name for name, table in arts.items() if table is None and AR.ARTIFACTS[name]]
        raise RuntimeError(f"{artifacts_dir} lacks {', '.join(missing)}; run the offline plan first")
    likes, base = arts["interactions"], arts["base_embeddings"]
    profiled = arts["user_profiles"].select("user_id")
    if users:
        profiled = profiled.where(F.col("user_id").isin(*users))
    likes = likes.join(profiled, "user_id", "left_semi")
    # a user none of whose items has a base vector gets the zero vector: every candidate scores 0
    profiles = P.profile_embedding(likes, base, enc.dim)
    counts = P.user_category_counts(likes, base, A.category_lookup(arts["processed_articles"]))
    return recommend(profiles, P.user_top_categories(counts), search_results, pages, enc, n, main_text=main_text)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--artifacts", required=True)
    ap.add_argument("--sf-dir", required=True, help="folder with the pages table (search stand-in)")
    ap.add_argument("--user", action="append")
    ap.add_argument("--main-text", action="store_true", help="page texts by text and link density")
    ap.add_argument("--out")
    args = ap.parse_args(argv)
    from ..session import get_spark
    from ..sources import fixtures
    spark = get_spark("feedspark-online")
    recs = run_online(spark, args.artifacts, fixtures.search_results(spark, args.sf_dir),
                      fixtures.pages(spark, args.sf_dir), users=args.user, main_text=args.main_text)
    if args.out:
        recs.write.mode("overwrite").parquet(args.out)
    else:
        recs.orderBy("user_id", "rank").show(50, truncate=80)


if __name__ == "__main__":
    main()
