"""Candidate generation: per-user search queries and quotas, search hits, URL dedupe and filters,
page text, and the text to embed."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.main_text import with_main_text
from ..functions.urls import is_likely_article_url
from .ranking import first_per_key

# The online phase's search parameters.
NUM_SEARCH_RESULTS_TOTAL = 20
DEFAULT_QUERY = "top breaking news"
QUERY_PREFIX = "latest news "
MIN_TEXT_CHARS = 30
FULLTEXT_OVER_SNIPPET = 1.5


def user_queries(users: DataFrame, top_categories: DataFrame) -> DataFrame:
    """(user_id, query_idx 1-based, query, n_queries): one query per top category in rank order, or
    the default query for a user without categories."""
    q = users.select("user_id").join(top_categories.select("user_id", "topic_rank", "category"), "user_id", "left")
    q = q.select("user_id",
                 F.coalesce(F.col("topic_rank"), F.lit(1)).cast("int").alias("query_idx"),
                 F.when(F.col("category").isNull(), F.lit(DEFAULT_QUERY))
                  .otherwise(F.concat(F.lit(QUERY_PREFIX), F.col("category"))).alias("query"))
    return q.withColumn("n_queries", F.count(F.lit(1)).over(Window.partitionBy("user_id")).cast("int"))


def with_quota(queries: DataFrame, total: int = NUM_SEARCH_RESULTS_TOTAL) -> DataFrame:
    """Share ``total`` results over a user's queries in order, each at least 1: the closed form of
    ``max(1, remaining // (n - i))`` applied left to right."""
    n, i = F.col("n_queries"), F.col("query_idx") - 1
    quota = (F.when(F.lit(total) < n, F.lit(1))
             .otherwise(F.floor(F.lit(total) / n) + F.when(i >= n - F.pmod(F.lit(total), n), 1).otherwise(0)))
    return queries.withColumn("quota", quota.cast("int"))


def search_hits(queries: DataFrame, search_results: DataFrame, total: int = NUM_SEARCH_RESULTS_TOTAL) -> DataFrame:
    """Each query's first ``quota`` results (the pages a paged search would fetch):
    (user_id, query_idx, pos, link, title, snippet).

    No quota exceeds ``total``, so only the first ``total`` results of each query can match: that
    bounds the search side to ``total`` rows per distinct query. Many users share a query (a third
    of them may be on the default one): adaptive execution broadcasts the search side when its real
    size allows and splits the hot query's users over tasks otherwise.
    """
    s = search_results.where(F.col("pos") <= total).select("query", "pos", "link", "title", "snippet")
    j = queries.select("user_id", "query_idx", "query", "quota").join(s, "query")
    return j.where(F.col("pos") <= F.col("quota")).select("user_id", "query_idx", "pos", "link", "title", "snippet")


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Union over a user's queries: first occurrence of each non-empty link in (query, position)
    order wins; the title is checked only afterwards."""
    nonempty = hits.where(F.col("link").isNotNull() & (F.col("link") != ""))
    return first_per_key(nonempty, ["user_id", "link"], ["query_idx", "pos"])


def candidate_articles(queries: DataFrame, search_results: DataFrame,
                       total: int = NUM_SEARCH_RESULTS_TOTAL) -> DataFrame:
    """Deduped hits with a title whose link looks like an article."""
    d = dedupe_hits(search_hits(queries, search_results, total))
    d = d.where(F.col("title").isNotNull() & (F.col("title") != ""))
    return d.where(is_likely_article_url(F.col("link")))


def page_features(pages: DataFrame, urls: DataFrame | None = None, main_text: bool = False) -> DataFrame:
    """(url, description, full_text) extracted once per page; restricted to ``urls`` first when given
    so only candidate pages are parsed. The full text is the <article> or all paragraphs, or with ``main_text`` what
    text and link density give, which suits pages without such tags."""
    p = pages.select("url", "html")
    if urls is not None:
        p = p.join(urls.select(F.col("link").alias("url")).distinct(), "url", "left_semi")
    clean = p.select("url", H.remove_noise(F.col("html")).alias("clean"))
    if main_text:
        texts = with_main_text(p.dropDuplicates(["url"])).select("url", F.col("main_text").alias("full_text"))
        return clean.select("url", H.page_description(F.col("clean")).alias("description")).join(texts, "url")
    return clean.select("url", H.page_description(F.col("clean")).alias("description"),
                        H.page_full_text(F.col("clean")).alias("full_text"))


def embedding_text(full_text, snippet):
    full_ok = full_text.isNotNull() & (full_text != "") & \
        (F.length(full_text) > F.length(F.coalesce(snippet, F.lit(""))) * FULLTEXT_OVER_SNIPPET)
    return F.when(full_ok, full_text).otherwise(snippet)


def display_description(description, full_text, snippet):
    return F.coalesce(F.nullif(description, F.lit("")),
                      F.when(full_text != "", F.concat(F.substring(full_text, 1, H.FULLTEXT_DESCRIPTION_CHARS), F.lit(H.ELLIPSIS))),
                      snippet)


def with_candidate_text(hits: DataFrame, features: DataFrame) -> DataFrame:
    """Attach page text, choose the text to embed and the display description."""
    j = hits.join(features.withColumnRenamed("url", "link"), "link", "left")
    return (j.withColumn("text_for_embedding", embedding_text(F.col("full_text"), F.col("snippet")))
             .withColumn("display_description", display_description(F.col("description"), F.col("full_text"), F.col("snippet"))))


def with_enough_text(cands: DataFrame) -> DataFrame:
    """Drop candidates with under 30 characters of text (whole texts are embedded; an encoder with a
    length limit applies it itself)."""
    return cands.where(F.col("text_for_embedding").isNotNull() & (F.length("text_for_embedding") >= MIN_TEXT_CHARS))
