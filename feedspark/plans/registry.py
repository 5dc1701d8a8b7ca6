"""Named queries: each takes (spark, sf_dir) and returns a DataFrame over the driver tables.

Vectors are reported in long form (key, pos, value) and doubles are rounded to 5 decimals so
results compare exactly with the SQL oracle.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import articles as A
from ..operators.sampling import sample_rows
from ..sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prepare_articles(FX.articles(spark, sf_dir))


# ------------------------------------------------------------------ wave 1: article preparation
@query("processed_articles")
def q_processed_articles(spark, sf_dir):
    return processed(spark, sf_dir)


@query("sample_articles")
def q_sample_articles(spark, sf_dir):
    # Sampling operator with a cap below the stand-in's row count so the cap is exercised.
    return sample_rows(FX.articles(spark, sf_dir), 500, 42, ["row_ord"]).select("article_id", "row_ord")


@query("clean_text")
def q_clean_text(spark, sf_dir):
    a = FX.articles(spark, sf_dir)
    return a.select("article_id", "row_ord", T.clean_text("title").alias("title_clean"),
                    T.clean_text("category").alias("category_clean"))


@query("combined_text")
def q_combined_text(spark, sf_dir):
    a = FX.articles(spark, sf_dir)
    return a.select("article_id", "row_ord", T.combine_text(*A.TEXT_COLS).alias("combined_text"))


@query("filter_category")
def q_filter_category(spark, sf_dir):
    a = FX.articles(spark, sf_dir)
    return a.where(F.col("category").isNotNull()).select("article_id", "row_ord", "category")


@query("filter_nonblank")
def q_filter_nonblank(spark, sf_dir):
    a = FX.articles(spark, sf_dir).withColumn("t", T.combine_text(*A.TEXT_COLS))
    return a.where(~T.is_blank("t")).select("article_id", "row_ord")


@query("parse_published_at")
def q_parse_published_at(spark, sf_dir):
    a = FX.articles(spark, sf_dir)
    return a.select("article_id", "row_ord", T.parse_published_at("published_at").alias("published_at"))


@query("normalize_category")
def q_normalize_category(spark, sf_dir):
    a = FX.articles(spark, sf_dir)
    return a.select("article_id", "row_ord", T.normalize_category("category").alias("category"))


@query("dedupe_articles")
def q_dedupe_articles(spark, sf_dir):
    a = FX.articles(spark, sf_dir)
    return A.dedupe_articles(a).select("article_id", "row_ord", "category", "description")


@query("encode_category")
def q_encode_category(spark, sf_dir):
    return A.category_labels(processed(spark, sf_dir))


@query("category_count")
def q_category_count(spark, sf_dir):
    return A.category_count(processed(spark, sf_dir))


@query("category_lookup")
def q_category_lookup(spark, sf_dir):
    return A.category_lookup(processed(spark, sf_dir))


# ------------------------------------------------------------------ wave 2-4: vectors, profiles, candidates
from ..functions import html as H  # noqa: E402
from ..functions.main_text import with_main_text  # noqa: E402
from ..functions.urls import is_likely_article_url  # noqa: E402
from ..functions.vectors import cosine, explode_vector, with_l2_normalized  # noqa: E402
from ..operators import candidates as C  # noqa: E402
from ..operators import interactions as I  # noqa: E402
from ..operators import profiles as P  # noqa: E402
from ..operators import recommend as R  # noqa: E402
from ..operators.encoder import HashedBagOfWords  # noqa: E402
from ..operators.sampling import LIKE_PROBABILITY, SEED, bernoulli_thin  # noqa: E402,F401
from ..session import cut_all, cut_lineage, drop_tables  # noqa: E402

DIM = 64


def encoder():
    return HashedBagOfWords(DIM)


def article_vectors(spark, sf_dir):
    """Flagship article vectors: the hashed encoder over whole document texts."""
    return encoder().encode(FX.vector_documents(spark, sf_dir), ["article_id"], "text")


def sparse_long(df, keys, vec):
    """Non-zero entries of a vector column as (keys..., pos, value rounded to 5 decimals)."""
    out = df.select(*keys, F.posexplode(vec).alias("pos", "value")).where(F.col("value") != 0)
    return out.select(*keys, F.col("pos").cast("int"), F.round(F.col("value").cast("double"), 5).alias("value"))


def flagship_parts(spark, sf_dir, proc=None, topics=True):
    """(processed, interactions, article vectors, profiles, top categories); ``topics=False`` skips
    the category lookup and returns None for the top categories."""
    # the lookup is written below, so the prepared rows need no table of their own
    proc = proc if proc is not None else A.prepare_articles(FX.articles(spark, sf_dir), materialize=not topics)
    inter = FX.interactions(spark, sf_dir)
    # The embedding table is an artifact read by several branches (profiles, topics, scoring):
    # materialise it once (Parquet in the shared checkpoint folder) instead of re-encoding every
    # document in each branch.
    # Likewise the id -> category lookup (the reference re-reads it from the processed-article
    # file): article preparation then runs once, not once per branch that needs a category.
    if not topics:
        vecs = cut_lineage(article_vectors(spark, sf_dir))
        return proc, inter, vecs, P.user_profiles(inter, vecs, DIM), None
    vecs, lookup = cut_all(article_vectors(spark, sf_dir), A.category_lookup(proc))
    profiles = P.user_profiles(inter, vecs, DIM)
    cat_counts = P.user_category_counts(inter, vecs, lookup)
    top = P.user_top_categories(cat_counts)
    return proc, inter, vecs, profiles, top


def flagship_topics(spark, sf_dir):
    """(users with a profile, category counts): whether an item has a vector shows in its id, so nothing is encoded."""
    inter = FX.interactions(spark, sf_dir)
    known = FX.vector_documents(spark, sf_dir).select("article_id", F.lit(None).alias("embedding"))
    proc = A.prepare_articles(FX.articles(spark, sf_dir), materialize=False)
    lookup = cut_lineage(A.category_lookup(proc))
    users = inter.join(P.item_vectors(known).select("item_id"), "item_id", "left_semi").select("user_id").distinct()
    return users, P.user_category_counts(inter, known, lookup)


def flagship_queries(spark, sf_dir):
    users, counts = flagship_topics(spark, sf_dir)
    return C.with_quota(C.user_queries(users, P.user_top_categories(counts)))


@query("embedding_table")
def q_embedding_table(spark, sf_dir):
    e = FX.article_embeddings(spark, sf_dir)
    return explode_vector(e, ["article_id", "label"], "embedding")


@query("embed_articles")
def q_embed_articles(spark, sf_dir):
    return sparse_long(article_vectors(spark, sf_dir), ["article_id"], "embedding")


@query("interactions_table")
def q_interactions_table(spark, sf_dir):
    return FX.interactions(spark, sf_dir)


@query("user_items")
def q_user_items(spark, sf_dir):
    return P.user_item_counts(FX.interactions(spark, sf_dir))


@query("liked_with_embedding")
def q_liked_with_embedding(spark, sf_dir):
    inter = FX.interactions(spark, sf_dir)
    liked = P.liked_with_embedding(inter, FX.article_embeddings(spark, sf_dir))
    return liked.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("profile_mean")
def q_profile_mean(spark, sf_dir):
    pm = P.profile_mean(FX.interactions(spark, sf_dir), FX.article_embeddings(spark, sf_dir), DIM)
    return explode_vector(pm, ["user_id", "n_liked"], "profile_mean")


@query("l2_normalize")
def q_l2_normalize(spark, sf_dir):
    pm = P.profile_mean(FX.interactions(spark, sf_dir), FX.article_embeddings(spark, sf_dir), DIM)
    return explode_vector(with_l2_normalized(pm, "profile_mean", "unit"), ["user_id"], "unit")


@query("profile_embedding")
def q_profile_embedding(spark, sf_dir):
    pe = P.profile_embedding(FX.interactions(spark, sf_dir), FX.article_embeddings(spark, sf_dir), DIM)
    return explode_vector(pe, ["user_id", "is_zero"], "profile_embedding")


@query("cosine_scores")
def q_cosine_scores(spark, sf_dir):
    inter = FX.interactions(spark, sf_dir)
    emb = FX.article_embeddings(spark, sf_dir)
    prof = P.user_profiles(inter, emb, DIM)
    pairs = inter.select("user_id", "item_id").distinct().join(P.item_vectors(emb), "item_id")
    j = pairs.join(prof.select("user_id", "profile_embedding"), "user_id")
    return j.select("user_id", "item_id", F.round(cosine("embedding", "profile_embedding"), 5).alias("score"))


@query("user_profiles")
def q_user_profiles(spark, sf_dir):
    inter = FX.interactions(spark, sf_dir)
    prof = P.user_profiles(inter, FX.article_embeddings(spark, sf_dir), DIM, FX.user_preferences(spark, sf_dir))
    prof = prof.withColumn("preferences", F.array_join("preferences", ","))
    return sparse_long(prof, ["user_id", "n_liked", "preferences"], "profile_embedding")


@query("preference_match")
def q_preference_match(spark, sf_dir):
    return I.preference_match(FX.interactions(spark, sf_dir), processed(spark, sf_dir), FX.user_preferences(spark, sf_dir))


@query("bernoulli_thin")
def q_bernoulli_thin(spark, sf_dir):
    return bernoulli_thin(FX.interactions(spark, sf_dir), LIKE_PROBABILITY, SEED, ["user_id", "item_id"])


@query("user_category_counts")
def q_user_category_counts(spark, sf_dir):
    return flagship_topics(spark, sf_dir)[1]


@query("user_top_categories")
def q_user_top_categories(spark, sf_dir):
    return P.user_top_categories(flagship_topics(spark, sf_dir)[1])


@query("user_queries")
def q_user_queries(spark, sf_dir):
    return flagship_queries(spark, sf_dir).select("user_id", "query_idx", "query", "n_queries")


@query("query_quota")
def q_query_quota(spark, sf_dir):
    return flagship_queries(spark, sf_dir).select("user_id", "query_idx", "quota")


@query("search_fetch")
def q_search_fetch(spark, sf_dir):
    return C.search_hits(flagship_queries(spark, sf_dir), FX.search_results(spark, sf_dir))


@query("dedupe_candidates")
def q_dedupe_candidates(spark, sf_dir):
    hits = C.search_hits(flagship_queries(spark, sf_dir), FX.search_results(spark, sf_dir))
    return C.dedupe_hits(hits)


@query("candidate_articles")
def q_candidate_articles(spark, sf_dir):
    return C.candidate_articles(flagship_queries(spark, sf_dir), FX.search_results(spark, sf_dir))


@query("article_urls")
def q_article_urls(spark, sf_dir):
    hits = FX.page_hits(spark, sf_dir).select("link").distinct()
    return hits.select("link", is_likely_article_url(F.col("link")).alias("is_article"))


@query("page_description")
def q_page_description(spark, sf_dir):
    p = FX.pages(spark, sf_dir).select("url", H.remove_noise(F.col("html")).alias("clean"))
    return p.select("url", H.page_description(F.col("clean")).alias("description"))


@query("page_full_text")
def q_page_full_text(spark, sf_dir):
    p = FX.pages(spark, sf_dir).select("url", H.remove_noise(F.col("html")).alias("clean"))
    return p.select("url", H.page_full_text(F.col("clean")).alias("full_text"))


def _hits_and_candidates(spark, sf_dir):
    """(users' candidates, texts of the hits they come from); both keyed by (query, pos)."""
    found = FX.search_results(spark, sf_dir)
    return R.user_candidates(flagship_queries(spark, sf_dir), found), R.hit_texts(found, FX.pages(spark, sf_dir))


@query("embedding_text")
def q_embedding_text(spark, sf_dir):
    cands, texts = _hits_and_candidates(spark, sf_dir)
    return cands.join(texts, ["query", "pos"]).select("user_id", "link", "text_for_embedding")


@query("display_description")
def q_display_description(spark, sf_dir):
    cands, texts = _hits_and_candidates(spark, sf_dir)
    return cands.join(texts, ["query", "pos"]).select("user_id", "link", "display_description")


@query("usable_candidates")
def q_usable_candidates(spark, sf_dir):
    cands, texts = _hits_and_candidates(spark, sf_dir)
    return cands.join(C.with_enough_text(texts), ["query", "pos"]).select(
        "user_id", "link", "query_idx", "pos", "text_for_embedding", "display_description")


@query("embed_candidates")
def q_embed_candidates(spark, sf_dir):
    found = FX.search_results(spark, sf_dir)
    cands = R.user_candidates(flagship_queries(spark, sf_dir), found).select("query", "pos", "link").distinct()
    vecs = R.hit_candidates(found, FX.pages(spark, sf_dir), encoder())
    return sparse_long(cands.join(vecs, ["query", "pos"]), ["link"], "cand_vec").distinct()


@query("content_scores")
def q_content_scores(spark, sf_dir):
    return recommendations(spark, sf_dir, None).select("user_id", F.col("url").alias("link"),
                                                       F.round("content_score", 5).alias("content_score"))


@query("ranked_candidates")
def q_ranked_candidates(spark, sf_dir):
    return recommendations(spark, sf_dir, None).select("user_id", "rank", F.col("url").alias("link"),
                                                       F.round("content_score", 5).alias("content_score"))


def recommendations(spark, sf_dir, n=R.NUM_RECOMMENDATIONS):
    _, _, _, profiles, top = flagship_parts(spark, sf_dir)
    return R.recommend(profiles, top, FX.search_results(spark, sf_dir), FX.pages(spark, sf_dir), encoder(), n)


@query("recommendations")
def q_recommendations(spark, sf_dir):
    return recommendations(spark, sf_dir).withColumn("content_score", F.round("content_score", 5))


@query("recommendations_unknown_user")
def q_recommendations_unknown_user(spark, sf_dir):
    """Users that have likes but no profile (no liked item has a vector) get no rows."""
    inter = FX.interactions(spark, sf_dir)
    no_profile = inter.select("user_id").distinct().join(
        P.user_profiles(inter, article_vectors(spark, sf_dir), DIM).select("user_id"), "user_id", "left_anti")
    return recommendations(spark, sf_dir).join(no_profile, "user_id", "left_semi")


@query("recommendation_counts")
def q_recommendation_counts(spark, sf_dir):
    """Recommendations of every user with likes; users whose items are all unknown have no profile and get none."""
    users = FX.interactions(spark, sf_dir).select("user_id").distinct()
    counts = recommendations(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users.join(counts, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n_recommendations"))


@query("page_main_text")
def q_page_main_text(spark, sf_dir):
    """Main text by text and link density (the column expressions of page_full_text know <article> and <p> alone)."""
    return with_main_text(FX.pages(spark, sf_dir))


# ------------------------------------------------------------------ wave 5-7: evaluation, CF, report, I/O
import uuid  # noqa: E402

from ..operators import cf as CF  # noqa: E402
from ..operators import cluster_eval as CE  # noqa: E402
from ..operators import contrastive as CT  # noqa: E402
from ..operators import report as RP  # noqa: E402
from ..operators.cf_top_n import model_top_n, top_n  # noqa: E402
from ..operators.silhouette import silhouette_points  # noqa: E402
from ..operators.tuning import tune  # noqa: E402
from ..session import shared_dir  # noqa: E402
from ..sources import articles_csv as CSV  # noqa: E402
from ..sources import artifacts as AR  # noqa: E402


def scratch_dir(spark, name):
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return f"{shared_dir(spark)}/feedspark-scratch/{name}-{uuid.uuid4().hex[:12]}"


def labelled(spark, sf_dir):
    return FX.article_embeddings(spark, sf_dir)


def eval_assignments(spark, sf_dir):
    """Nearest-class-centroid clusters of all labelled vectors."""
    return CE.nearest_centroid(labelled(spark, sf_dir), dim=DIM)


@query("cluster_eval_sample")
def q_cluster_eval_sample(spark, sf_dir):
    # Sampling operator with a cap below the table size so the cap is exercised.
    return CE.eval_sample(labelled(spark, sf_dir), "article_id", 300)


@query("nearest_centroid")
def q_nearest_centroid(spark, sf_dir):
    return CE.nearest_centroid(labelled(spark, sf_dir), dim=DIM).select("article_id", "label", "cluster")


@query("adjusted_rand")
def q_adjusted_rand(spark, sf_dir):
    return CE.adjusted_rand(eval_assignments(spark, sf_dir)).select(F.round("ari", 5).alias("ari"))


@query("nmi")
def q_nmi(spark, sf_dir):
    return CE.nmi(eval_assignments(spark, sf_dir)).select(F.round("nmi", 5).alias("nmi"))


@query("silhouette_exact")
def q_silhouette_exact(spark, sf_dir):
    s = CE.silhouette_exact(cut_lineage(eval_assignments(spark, sf_dir)), "article_id")
    return s.select(F.round("silhouette", 5).alias("silhouette"))


@query("silhouette_points")
def q_silhouette_points(spark, sf_dir):
    s = silhouette_points(cut_lineage(eval_assignments(spark, sf_dir)), "article_id")
    return s.select("article_id", F.round("silhouette", 5).alias("silhouette"))


@query("silhouette_scalable")
def q_silhouette_scalable(spark, sf_dir):
    v = CE.silhouette_scalable(eval_assignments(spark, sf_dir))
    return spark.range(1).select(F.round(F.lit(v).cast("double"), 5).alias("silhouette_sq_euclidean"))


@query("kmeans_clusters")
def q_kmeans_clusters(spark, sf_dir):
    emb = labelled(spark, sf_dir)
    k = emb.select("label").distinct().count()
    return CE.kmeans_clusters(emb, k, "article_id").select("article_id", "label", F.col("cluster").cast("int"))


@query("cluster_metrics")
def q_cluster_metrics(spark, sf_dir):
    """Base vectors of the processed articles and the same tuned by the contrastive loss, all rows, labels = category."""
    proc = processed(spark, sf_dir)
    labels = cut_lineage(proc.select("article_id", F.col("category_encoded").alias("label")))  # read by every metric step below
    k = A.category_count(proc).first()[0]
    text = proc.select("article_id", "combined_text")
    base = cut_lineage(encoder().encode(text, ["article_id"], "combined_text"))
    drop_tables(proc)  # the texts are read no more
    return CE.compare_variants({"final": tune(base).project(base), "base": base}, labels, int(k))


@query("lloyd_steps")
def q_lloyd_steps(spark, sf_dir):
    """Two rounds of k-means from the class means."""
    emb = labelled(spark, sf_dir)
    return CE.lloyd_steps(emb, CE.class_centroids(emb, dim=DIM), 2, dim=DIM).select("article_id", "cluster")


@query("assignment_metrics")
def q_assignment_metrics(spark, sf_dir):
    """The metric rows of a variant, on the nearest-centroid clusters."""
    m = CE.assignment_metrics(eval_assignments(spark, sf_dir))
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(F.lit(float(v)), 5).alias("value")) for k, v in m.items()])
    return spark.range(1).select(F.inline(rows))


@query("contrastive_pairs")
def q_contrastive_pairs(spark, sf_dir):
    return CT.contrastive_pairs(cut_lineage(processed(spark, sf_dir))).select("article_id", "batch_id", "slot")


@query("contrastive_loss")
def q_contrastive_loss(spark, sf_dir):
    proc = processed(spark, sf_dir)
    # the article embedding table is an artifact: materialise it once, then batch and score it
    vecs = cut_lineage(encoder().encode(proc.select("article_id", "combined_text"), ["article_id"], "combined_text"))
    return CT.contrastive_loss(vecs).select(F.round("loss", 5).alias("loss"))


@query("contrastive_tuning")
def q_contrastive_tuning(spark, sf_dir):
    """Mean held-out loss before tuning and after each pass."""
    vecs = cut_lineage(encoder().encode(processed(spark, sf_dir).select("article_id", "combined_text"), ["article_id"], "combined_text"))
    losses = tune(vecs).held_out
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "pass int, held_out_loss double").withColumn("held_out_loss", F.round("held_out_loss", 4))


def graded(spark, sf_dir):
    return FX.interactions(spark, sf_dir, graded=True)


@query("train_test_split")
def q_train_test_split(spark, sf_dir):
    return CF.train_test(CF.rating_pairs(graded(spark, sf_dir))).select("user_id", "item_id", "is_test")


@query("train_test_split_exact")
def q_train_test_split_exact(spark, sf_dir):
    return CF.train_test(CF.rating_pairs(graded(spark, sf_dir)), exact=True).select("user_id", "item_id", "is_test")


@query("cf_baseline_predict")
def q_cf_baseline_predict(spark, sf_dir):
    p = CF.baseline_predict(graded(spark, sf_dir))
    return p.select("user_id", "item_id", F.round("rating", 5).alias("rating"), F.round("est", 5).alias("est"))


@query("cf_fit_predict")
def q_cf_fit_predict(spark, sf_dir):
    p = CF.fit_predict(graded(spark, sf_dir))
    return p.select("user_id", "item_id", F.round("rating", 5).alias("rating"), F.round("est", 5).alias("est"))


@query("cf_prediction_rows")
def q_cf_prediction_rows(spark, sf_dir):
    """Keys and ratings of the fitted model's predictions, and whether each estimate is a number in the rating range."""
    p = CF.fit_predict(graded(spark, sf_dir))
    return p.select("user_id", "item_id", F.round("rating", 5).alias("rating"),
                    F.coalesce(F.col("est").between(CF.RATING_MIN, CF.RATING_MAX), F.lit(False)).alias("in_range"))


@query("cf_top_n")
def q_cf_top_n(spark, sf_dir):
    """Ten unseen items for every user by the fitted model."""
    pairs = cut_lineage(CF.rating_pairs(graded(spark, sf_dir)))
    return model_top_n(CF.fit_full(pairs), pairs).withColumn("est", F.round("est", 5))


@query("cf_baseline_top_n")
def q_cf_baseline_top_n(spark, sf_dir):
    """Ten unseen items for every user by the baseline model (biases to 6 decimals, so that both engines add the same numbers)."""
    pairs = cut_lineage(CF.rating_pairs(graded(spark, sf_dir)))
    _, bi, bu = CF.fit_baseline(pairs)
    mean = pairs.agg(F.round(F.avg("rating"), 6).alias("m")).first()["m"] or 0.0
    none = F.array().cast("array<double>").alias("factors")
    top = top_n(mean, bu.select("user_id", F.round("b_user", 6).alias("bias"), none), bi.select("item_id", F.round("b_item", 6).alias("bias"), none), pairs)
    return top.withColumn("est", F.round("est", 6))


@query("precision_recall_per_user")
def q_precision_recall_per_user(spark, sf_dir):
    per = CF.precision_recall_per_user(CF.baseline_predict(FX.interactions(spark, sf_dir)))
    return per.select("user_id", F.round("precision", 5).alias("precision"), F.round("recall", 5).alias("recall"))


@query("precision_recall_at_k")
def q_precision_recall_at_k(spark, sf_dir):
    pr = CF.precision_recall_at_k(CF.baseline_predict(FX.interactions(spark, sf_dir)))
    return pr.select(F.round("precision_at_k", 5).alias("precision_at_k"), F.round("recall_at_k", 5).alias("recall_at_k"))


@query("precision_recall_graded")
def q_precision_recall_graded(spark, sf_dir):
    pr = CF.precision_recall_at_k(CF.baseline_predict(graded(spark, sf_dir)), threshold=0.5)
    return pr.select(F.round("precision_at_k", 5).alias("precision_at_k"), F.round("recall_at_k", 5).alias("recall_at_k"))


def pipeline_counts(spark, sf_dir, proc=None):
    """Row counts of the artifacts; a user has a profile if some liked item has a vector (an id is enough to tell)."""
    proc = proc if proc is not None else processed(spark, sf_dir)
    inter = FX.interactions(spark, sf_dir)
    known = FX.vector_documents(spark, sf_dir).select(F.col("article_id").alias("item_id"))
    profiled = inter.join(known, "item_id", "left_semi").select("user_id").distinct()
    return (proc.agg(F.count(F.lit(1)).alias("processed_articles"))
            .select("processed_articles",
                    inter.agg(F.count(F.lit(1))).scalar().alias("interactions"),
                    profiled.agg(F.count(F.lit(1))).scalar().alias("users_with_profiles")))


@query("pipeline_counts")
def q_pipeline_counts(spark, sf_dir):
    return pipeline_counts(spark, sf_dir)


def evaluation_report(spark, sf_dir, proc=None):
    # the cluster assignment feeds three metrics (and a driver-side sample read): materialise it once
    proc = proc if proc is not None else processed(spark, sf_dir)
    counts = pipeline_counts(spark, sf_dir, proc)
    assign = cut_lineage(eval_assignments(spark, sf_dir))
    parts = [
        RP.metric_rows("data", counts.select("processed_articles")),
        RP.metric_rows("data", A.category_count(proc)),
        RP.metric_rows("interactions", counts.select("interactions")),
        RP.metric_rows("profiles", counts.select("users_with_profiles")),
        RP.metric_rows("cf", CF.precision_recall_at_k(CF.baseline_predict(FX.interactions(spark, sf_dir)))),
        RP.metric_rows("clustering", CE.agreement(cut_lineage(CE.contingency(assign)))),
        RP.metric_rows("clustering", CE.silhouette_exact(assign, "article_id")),
    ]
    return RP.union_all(parts)


@query("evaluation_report")
def q_evaluation_report(spark, sf_dir):
    return evaluation_report(spark, sf_dir).withColumn("value", F.round("value", 5))


@query("read_articles_csv")
def q_read_articles_csv(spark, sf_dir):
    path = scratch_dir(spark, "articles-csv")
    CSV.write_articles_csv(FX.articles(spark, sf_dir), path)
    cols = (*CSV.ARTICLE_CSV_COLUMNS, "row_ord")
    return CSV.read_articles_csv(spark, path, cols).withColumn("row_ord", F.col("row_ord").cast("bigint"))


def write_offline_artifacts(spark, sf_dir, root):
    """Phase-1 artifacts for the stand-in data: processed articles, embeddings, interactions,
    profiles, the CF model (only with enough interactions) and the report. Each is made once; what later steps need of one is read
    from its files."""
    def written(df, name):
        return spark.read.schema(df.schema).parquet(AR.write_table(df, root, name))

    proc = written(processed(spark, sf_dir), "processed_articles")
    vecs = written(article_vectors(spark, sf_dir), "base_embeddings")
    AR.write_table(vecs, root, "article_embeddings")
    inter = written(FX.interactions(spark, sf_dir), "interactions")
    AR.write_table(P.user_item_counts(inter), root, "user_items")
    AR.write_table(P.user_profiles(inter, vecs, DIM, FX.user_preferences(spark, sf_dir)), root, "user_profiles")
    if CF.enough_interactions(inter):
        AR.save_cf(CF.fit_full(inter), spark, root)
    AR.write_table(evaluation_report(spark, sf_dir, proc), root, "evaluation_report")
    return root


@query("artifact_manifest")
def q_artifact_manifest(spark, sf_dir):
    root = write_offline_artifacts(spark, sf_dir, scratch_dir(spark, "artifacts"))
    return AR.artifact_manifest(spark, root).select("artifact", "present", "rows")
