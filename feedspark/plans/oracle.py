"""SQL oracles (DuckDB) for the named queries; tables are the driver's pre-registered views."""
from __future__ import annotations

from . import sqlfrag as S
from .sqlfrag import combine, strip, with_ctes

ORACLE: dict[str, str] = {}


def oracle(name: str, ctes: list[str], final: str) -> None:
    ORACLE[name] = with_ctes(ctes, final)


# ------------------------------------------------------------------ wave 1: article preparation
oracle("processed_articles", ["processed"],
       "SELECT article_id, category, category_encoded, published_at, combined_text FROM processed")

S.sampled_articles_cte("art_sample500", 500)
oracle("sample_articles", ["art_sample500"], "SELECT article_id, row_ord FROM art_sample500")

oracle("clean_text", ["articles"], f"""
SELECT article_id, row_ord, coalesce({strip('lower(title)')}, '') AS title_clean,
       coalesce({strip('lower(category)')}, '') AS category_clean FROM articles""")

oracle("combined_text", ["articles"], f"""
SELECT article_id, row_ord, {combine('title', 'description', 'content')} AS combined_text FROM articles""")

oracle("filter_category", ["articles"],
       "SELECT article_id, row_ord, category FROM articles WHERE category IS NOT NULL")

oracle("filter_nonblank", ["articles"], f"""
SELECT article_id, row_ord FROM articles WHERE {strip(combine('title', 'description', 'content'))} <> ''""")

oracle("parse_published_at", ["articles"], f"""
SELECT article_id, row_ord, try_cast({strip('published_at')} AS TIMESTAMP) AS published_at FROM articles""")

oracle("normalize_category", ["articles"], f"""
SELECT article_id, row_ord, {strip('lower(CAST(category AS VARCHAR))')} AS category FROM articles""")

oracle("dedupe_articles", ["articles"], """
SELECT article_id, row_ord, category, description FROM articles
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY row_ord) = 1""")

oracle("encode_category", ["category_labels"], "SELECT category, category_encoded FROM category_labels")

oracle("category_count", ["processed"],
       "SELECT CAST(count(DISTINCT category_encoded) AS BIGINT) AS n_categories FROM processed")

oracle("category_lookup", ["processed"], "SELECT article_id, category FROM processed")


# ------------------------------------------------------------------ wave 2-4: vectors, profiles, candidates
R5 = S.round5

oracle("embedding_table", ["emb_long"], f"SELECT article_id, label, pos, {R5('value')} AS value FROM emb_long")

oracle("embed_articles", ["avec"], f"SELECT k AS article_id, CAST(b AS INTEGER) AS pos, {R5('v')} AS value FROM avec")

oracle("interactions_table", ["interactions"], "SELECT user_id, item_id, rating, timestamp FROM interactions")

oracle("user_items", ["interactions"], """
SELECT user_id, item_id, count(*) AS n_likes, min(timestamp) AS first_liked FROM interactions GROUP BY 1, 2""")

oracle("liked_with_embedding", ["interactions"], """
SELECT i.user_id, i.item_id, count(*) AS n FROM interactions i
JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = i.item_id GROUP BY 1, 2""")

oracle("profile_mean", ["pmean_e"], f"""
SELECT user_id, CAST(n_liked AS BIGINT) AS n_liked, pos, {R5('value')} AS value FROM pmean_e""")

oracle("l2_normalize", ["punit_e"], f"SELECT user_id, pos, {R5('value')} AS value FROM punit_e")

oracle("profile_embedding", ["interactions", "punit_e"], f"""
SELECT u.user_id, (p.user_id IS NULL) AS is_zero, CAST(r.pos AS INTEGER) AS pos,
       {R5('coalesce(p.value, 0.0)')} AS value
FROM (SELECT DISTINCT user_id FROM interactions) u
CROSS JOIN range(64) r(pos)
LEFT JOIN punit_e p ON p.user_id = u.user_id AND p.pos = r.pos""")

oracle("cosine_scores", ["interactions", "emb_long", "punit_e"], f"""
SELECT l.user_id, l.item_id, {R5('sum(e.value * p.value) / sqrt(sum(e.value * e.value)) / sqrt(sum(p.value * p.value))')} AS score
FROM (SELECT DISTINCT user_id, item_id FROM interactions) l
JOIN emb_long e ON e.article_id = l.item_id
JOIN punit_e p ON p.user_id = l.user_id AND p.pos = e.pos
GROUP BY 1, 2""")

oracle("user_profiles", ["pmean_e", "punit_e", "user_prefs"], f"""
SELECT m.user_id, m.n_liked, coalesce(pr.preferences, '') AS preferences, CAST(u.pos AS INTEGER) AS pos, {R5('u.value')} AS value
FROM (SELECT DISTINCT user_id, CAST(n_liked AS BIGINT) AS n_liked FROM pmean_e) m
JOIN punit_e u USING (user_id) LEFT JOIN user_prefs pr USING (user_id) WHERE u.value <> 0""")

oracle("preference_match", ["interactions", "processed", "user_prefs_long"], """
SELECT i.user_id, i.item_id, i.rating, i.timestamp FROM interactions i JOIN processed p ON p.article_id = i.item_id
WHERE EXISTS (SELECT 1 FROM user_prefs_long u WHERE u.user_id = i.user_id AND lower(u.lang) = lower(p.category))""")

oracle("bernoulli_thin", ["interactions"], f"""
SELECT * FROM interactions WHERE {S.hash32("'42'", 'user_id', 'item_id')} < {int(0.7 * 4294967296.0)}""")

oracle("user_category_counts", ["cat_counts"], "SELECT user_id, category, n FROM cat_counts")
oracle("user_top_categories", ["top_cats"], "SELECT user_id, topic_rank, category, n FROM top_cats")
oracle("user_queries", ["uq"], "SELECT user_id, query_idx, query, n_queries FROM uq")
oracle("query_quota", ["uq_quota"], "SELECT user_id, query_idx, quota FROM uq_quota")
oracle("search_fetch", ["hits"], "SELECT user_id, query_idx, pos, link, title, snippet FROM hits")
oracle("dedupe_candidates", ["hits_dedup"], "SELECT user_id, link, query_idx, pos, title, snippet FROM hits_dedup")
oracle("candidate_articles", ["cands"], "SELECT user_id, link, query_idx, pos, title, snippet FROM cands")

S.cte("distinct_links", ("page_hits",), "SELECT DISTINCT link FROM page_hits")
S.url_flags_cte("links_flagged", "distinct_links", "link", ("distinct_links",))
oracle("article_urls", ["links_flagged"], "SELECT link, is_article FROM links_flagged")

oracle("page_description", ["page_feat"], "SELECT url, description FROM page_feat")
oracle("page_full_text", ["page_feat"], "SELECT url, full_text FROM page_feat")
oracle("embedding_text", ["cands_text"], "SELECT user_id, link, te AS text_for_embedding FROM cands_text")
oracle("display_description", ["cands_text"], "SELECT user_id, link, display_description FROM cands_text")
oracle("usable_candidates", ["ucands"], """
SELECT user_id, link, query_idx, pos, text_for_embedding, display_description FROM ucands""")

oracle("embed_candidates", ["ucands", "cvec"], f"""
SELECT DISTINCT u.link, CAST(v.b AS INTEGER) AS pos, {R5('v.v')} AS value
FROM (SELECT DISTINCT link, text_for_embedding FROM ucands) u JOIN cvec v ON v.k = u.text_for_embedding""")

oracle("content_scores", ["scored"], f"SELECT user_id, link, {R5('content_score')} AS content_score FROM scored")
oracle("ranked_candidates", ["ranked"], f"SELECT user_id, rank, link, {R5('content_score')} AS content_score FROM ranked")
oracle("recommendations", ["ranked"], f"""
SELECT user_id, rank, title, link AS url, snippet, display_description AS description,
       {R5('content_score')} AS content_score
FROM ranked WHERE rank <= 10""")


# ------------------------------------------------------------------ wave 5-7: evaluation, CF, report, I/O
oracle("cluster_eval_sample", ["emb_long"], f"""
SELECT article_id FROM (SELECT DISTINCT article_id FROM emb_long) k
QUALIFY row_number() OVER (ORDER BY {S.hash32("'42'", 'article_id')}, article_id) <= 300""")
oracle("nearest_centroid", ["nc_all"], "SELECT article_id, label, cluster FROM nc_all")
oracle("adjusted_rand", ["ari_val"], f"SELECT {R5('ari')} AS ari FROM ari_val")
oracle("nmi", ["nmi_val"], f"SELECT {R5('nmi')} AS nmi FROM nmi_val")
oracle("silhouette_exact", ["sil_val"], f"SELECT {R5('silhouette')} AS silhouette FROM sil_val")
oracle("silhouette_points", ["sil_points"], f"SELECT i AS article_id, {R5('s')} AS silhouette FROM sil_points")
oracle("cf_baseline_top_n", ["cfa_top"], "SELECT user_id, rank, item_id, round(est, 6) AS est FROM cfa_top")
oracle("lloyd_steps", ["lloyd2"], "SELECT article_id, cluster FROM lloyd2")
oracle("assignment_metrics", ["ari_val", "nmi_val", "sil_val"], f"""
SELECT 'silhouette' AS metric, {R5('silhouette')} AS value FROM sil_val
UNION ALL SELECT 'ari', {R5('ari')} FROM ari_val UNION ALL SELECT 'nmi', {R5('nmi')} FROM nmi_val""")
oracle("cf_prediction_rows", ["cfg_pairs"], f"""
SELECT user_id, item_id, {R5('rating')} AS rating, true AS in_range FROM cfg_pairs WHERE is_test""")
oracle("contrastive_pairs", ["cpairs"], "SELECT article_id, batch_id, slot FROM cpairs")
oracle("contrastive_loss", ["closs"], f"SELECT {R5('loss')} AS loss FROM closs")
oracle("train_test_split", ["cfg_pairs"], "SELECT user_id, item_id, is_test FROM cfg_pairs")
oracle("train_test_split_exact", ["cfg_pairs"], f"""
SELECT user_id, item_id, row_number() OVER (ORDER BY {S.hash32("'42'", 'user_id', 'item_id')}, user_id, item_id) <= ceil(0.2 * count(*) OVER () - 1e-9) AS is_test FROM cfg_pairs""")
oracle("recommendation_counts", ["interactions", "ranked"], """
SELECT u.user_id, count(r.user_id) AS n_recommendations FROM (SELECT DISTINCT user_id FROM interactions) u
LEFT JOIN (SELECT user_id FROM ranked WHERE rank <= 10) r USING (user_id) GROUP BY 1""")
oracle("cf_baseline_predict", ["cfg_pred"], f"""
SELECT user_id, item_id, {R5('rating')} AS rating, {R5('est')} AS est FROM cfg_pred""")
oracle("precision_recall_per_user", ["pr1_per_user"], f"""
SELECT user_id, {R5('precision')} AS precision, {R5('recall')} AS recall FROM pr1_per_user""")
oracle("precision_recall_at_k", ["pr1_avg"], f"""
SELECT {R5('precision_at_k')} AS precision_at_k, {R5('recall_at_k')} AS recall_at_k FROM pr1_avg""")
oracle("precision_recall_graded", ["prg_avg"], f"""
SELECT {R5('precision_at_k')} AS precision_at_k, {R5('recall_at_k')} AS recall_at_k FROM prg_avg""")
oracle("pipeline_counts", ["counts"], "SELECT * FROM counts")
oracle("evaluation_report", ["counts", "processed", "pr1_avg", "ari_val", "nmi_val", "sil_val"], f"""
SELECT section, metric, {R5('value')} AS value, '' AS note FROM (
  SELECT 'data' AS section, 'processed_articles' AS metric, CAST(processed_articles AS DOUBLE) AS value FROM counts
  UNION ALL SELECT 'data', 'n_categories', CAST((SELECT count(DISTINCT category_encoded) FROM processed) AS DOUBLE)
  UNION ALL SELECT 'interactions', 'interactions', CAST(interactions AS DOUBLE) FROM counts
  UNION ALL SELECT 'profiles', 'users_with_profiles', CAST(users_with_profiles AS DOUBLE) FROM counts
  UNION ALL SELECT 'cf', 'precision_at_k', precision_at_k FROM pr1_avg
  UNION ALL SELECT 'cf', 'recall_at_k', recall_at_k FROM pr1_avg
  UNION ALL SELECT 'clustering', 'ari', ari FROM ari_val
  UNION ALL SELECT 'clustering', 'nmi', nmi FROM nmi_val
  UNION ALL SELECT 'clustering', 'silhouette', silhouette FROM sil_val) r""")

_NA = ", ".join(S.q(t) for t in ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                                  "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"))
oracle("read_articles_csv", ["articles"], "SELECT " + ", ".join(
    f"CASE WHEN {c} IN ({_NA}) THEN NULL ELSE {c} END AS {c}"
    for c in ("article_id", "title", "description", "content", "category", "published_at")) + ", row_ord FROM articles")

oracle("recommendations_unknown_user", ["ranked", "interactions", "prof_users"], f"""
SELECT user_id, rank, title, link AS url, snippet, display_description AS description,
       {R5('content_score')} AS content_score
FROM ranked WHERE rank <= 10
  AND user_id IN (SELECT user_id FROM interactions WHERE user_id NOT IN (SELECT user_id FROM prof_users))""")

S.cte("sq_sums", ("emb_long", "nc_all"), """
SELECT n.cluster, e.pos, sum(e.value) AS s FROM emb_long e JOIN nc_all n USING (article_id) GROUP BY 1, 2""")
S.cte("sq_sizes", ("emb_long", "nc_all"), """
SELECT n.cluster, CAST(count(DISTINCT article_id) AS DOUBLE) AS n, sum(e.value * e.value) AS sq
FROM emb_long e JOIN nc_all n USING (article_id) GROUP BY 1""")
S.cte("sq_means", ("emb_long", "nc_all", "sq_sums", "sq_sizes"), """
SELECT d.article_id, d.cluster = o.cluster AS own, g.n,
       (g.n * d.xs + g.sq - 2 * d.dot) / CASE WHEN d.cluster = o.cluster AND g.n > 1 THEN g.n - 1 ELSE g.n END AS m
FROM (SELECT e.article_id, c.cluster, sum(e.value * c.s) AS dot, sum(e.value * e.value) AS xs
      FROM emb_long e JOIN sq_sums c USING (pos) GROUP BY 1, 2) d
JOIN sq_sizes g ON g.cluster = d.cluster JOIN nc_all o ON o.article_id = d.article_id""")
oracle("silhouette_scalable", ["sq_means"], f"""
SELECT {R5('avg(CASE WHEN n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette_sq_euclidean FROM (
  SELECT article_id, max(CASE WHEN own THEN m END) AS a, min(CASE WHEN NOT own THEN m END) AS b, max(CASE WHEN own THEN n END) AS n
  FROM sq_means GROUP BY 1) s""")

oracle("artifact_manifest", ["processed", "vector_docs", "interactions", "prof_users"], """
SELECT artifact, true AS present, CAST(rows AS BIGINT) AS rows FROM (
  SELECT 'processed_articles' AS artifact, (SELECT count(*) FROM processed) AS rows
  UNION ALL SELECT 'base_embeddings', (SELECT count(*) FROM vector_docs)
  UNION ALL SELECT 'article_embeddings', (SELECT count(*) FROM vector_docs)
  UNION ALL SELECT 'interactions', (SELECT count(*) FROM interactions)
  UNION ALL SELECT 'user_items', (SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM interactions) x)
  UNION ALL SELECT 'user_profiles', (SELECT count(*) FROM prof_users)
  UNION ALL SELECT 'cf_mean', 1
  UNION ALL SELECT 'cf_users', (SELECT count(DISTINCT user_id) FROM interactions)
  UNION ALL SELECT 'cf_items', (SELECT count(DISTINCT item_id) FROM interactions)
  UNION ALL SELECT 'evaluation_report', 9) r""")
