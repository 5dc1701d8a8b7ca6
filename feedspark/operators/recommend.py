"""Recommendations for every user with a profile: score candidates by cosine similarity to the
profile vector and keep the top N."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_likely_article_url
from ..functions.vectors import cosine
from ..session import cut_all, cut_observed
from . import candidates as C
from .encoder import Encoder
from .ranking import top_n_per_group

NUM_RECOMMENDATIONS = 10


def content_scores(cands_with_vec: DataFrame, profiles: DataFrame) -> DataFrame:
    """Cosine of each candidate to its user's profile (a zero profile scores 0)."""
    j = cands_with_vec.join(profiles.select("user_id", "profile_embedding"), "user_id")
    return j.withColumn("content_score", cosine(F.col("cand_vec"), F.col("profile_embedding")))


def rank_candidates(scored: DataFrame, n: int | None = NUM_RECOMMENDATIONS) -> DataFrame:
    """rank 1.. by score desc; equal scores keep candidate order (query, position)."""
    order = [F.col("content_score").desc(), F.col("query_idx").asc(), F.col("pos").asc()]
    big = 1 << 30
    return top_n_per_group(scored, ["user_id"], order, n if n is not None else big, "rank") \
        .withColumn("rank", F.col("rank").cast("int"))


def hit_texts(search_results: DataFrame, pages: DataFrame, total: int = C.NUM_SEARCH_RESULTS_TOTAL, main_text: bool = False) -> DataFrame:
    """(query, pos, text_for_embedding, display_description) of every search hit that can become a candidate.

    A candidate's text depends only on its hit (the hit's snippet and its page), never on the user, so
    pages are read once per hit. Only each query's first ``total`` hits can be fetched, which bounds
    this table by ``total`` rows per distinct query. ``main_text``: full texts by text and link density.
    """
    hits = search_results.where(F.col("pos") <= total).select("query", "pos", "link", "title", "snippet")
    usable = hits.where(F.col("link").isNotNull() & (F.col("link") != "") & F.col("title").isNotNull()
                        & (F.col("title") != "") & is_likely_article_url(F.col("link")))
    return C.with_candidate_text(usable, C.page_features(pages, usable.select("link"), main_text)).select(
        "query", "pos", "text_for_embedding", "display_description")


def hit_candidates(search_results: DataFrame, pages: DataFrame, encoder: Encoder,
                   total: int = C.NUM_SEARCH_RESULTS_TOTAL, main_text: bool = False) -> DataFrame:
    """``hit_texts`` with enough text, and the vector of each, encoded by (query, pos); a hit that the
    encoder gave no vector has a null one (``require_vectors``)."""
    texts = C.with_enough_text(hit_texts(search_results, pages, total, main_text))
    vecs = encoder.encode(texts.select("query", "pos", "text_for_embedding"), ["query", "pos"], "text_for_embedding", "cand_vec")
    return texts.join(vecs, ["query", "pos"], "left")


def require_vectors(per_hit: DataFrame) -> DataFrame:
    """Output check: every usable hit has a vector; else the encoder lost rows and the run stops. The rows are written, and those
    without a vector counted on the way."""
    table, seen = cut_observed(per_hit, lost=F.count_if(F.col("cand_vec").isNull()))
    if seen["lost"]:
        raise ValueError(f"the encoder returned no vector for {seen['lost']} search hits")
    return table


def user_candidates(queries: DataFrame, search_results: DataFrame, total: int = C.NUM_SEARCH_RESULTS_TOTAL) -> DataFrame:
    """(user_id, query_idx, query, pos, link, title, snippet): each user's deduped hits with a title
    and an article-like link, in the reference's order (dedupe first, then the title check)."""
    s = search_results.where(F.col("pos") <= total).select("query", "pos", "link", "title", "snippet")
    j = queries.select("user_id", "query_idx", "query", "quota").join(s, "query")
    j = j.where(F.col("pos") <= F.col("quota")).drop("quota")
    d = C.dedupe_hits(j)
    d = d.where(F.col("title").isNotNull() & (F.col("title") != ""))
    return d.where(is_likely_article_url(F.col("link")))


def recommend(profiles: DataFrame, top_categories: DataFrame, search_results: DataFrame,
              pages: DataFrame, encoder: Encoder, n: int | None = NUM_RECOMMENDATIONS,
              total_results: int = C.NUM_SEARCH_RESULTS_TOTAL,
              materialize: bool = True, main_text: bool = False) -> DataFrame:
    """(user_id, rank, title, url, snippet, description, content_score) for all profiled users; all
    ranks with ``n=None``.

    Text work happens per search hit (``hit_candidates``: at most ``total_results`` rows per
    distinct query) and reaches the users through a join on (query, pos), whose small side adaptive
    execution broadcasts when its real size allows. Per-user rows never carry page text through a
    shuffle. With ``materialize`` the tables read by more than one branch (profile vectors, the
    first hits per query, the per-hit candidates) are written once to the shared checkpoint folder,
    and the number of vectors is checked.
    """
    profiles = profiles.select("user_id", "profile_embedding")
    first_hits = search_results.where(F.col("pos") <= total_results).select("query", "pos", "link", "title", "snippet")
    if materialize:
        profiles, first_hits = cut_all(profiles, first_hits)
    per_hit = hit_candidates(first_hits, pages, encoder, total_results, main_text)
    if materialize:
        per_hit = require_vectors(per_hit)
    queries = C.with_quota(C.user_queries(profiles.select("user_id"), top_categories), total_results)
    with_vec = user_candidates(queries, first_hits, total_results).join(per_hit, ["query", "pos"])
    ranked = rank_candidates(content_scores(with_vec, profiles), n)
    return ranked.select("user_id", "rank", "title", F.col("link").alias("url"), "snippet",
                         F.col("display_description").alias("description"), "content_score")
