"""Stand-in views that turn the driver tables into the recommender's inputs.

Every view is a plain projection / filter / explode / aggregate of a driver table, so its size grows
with the data. The same definitions exist as SQL in ``feedspark.plans.oracle``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import py_strip
from ..functions.urls import url_root
from ..functions.vectors import to_double_array
from .tables import read_table

# Event types that count as a like.
LIKE_EVENT_TYPES = ("view", "click", "purchase")
# Languages that get a 'latest news <lang>' search query in the stand-in search table.
SEARCH_LANGS = ("en", "de", "fr", "es")
DEFAULT_QUERY = "top breaking news"
QUERY_PREFIX = "latest news "
SNIPPET_CHARS = 160
# One character less than a usable text, for hits whose page came back empty.
SHORT_SNIPPET_CHARS = 29


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw article rows (all strings) with an explicit input order ``row_ord``.

    Rows with doc_id % 41 = 7 have no text in any field. Rows with doc_id % 10 = 0 appear twice (the copy has an upper-cased category and no
    description); for doc_id % 20 = 10 the copy comes first, so dedupe order is visible.
    """
    d = read_table(spark, sf_dir, "documents", deal=True).select("doc_id", "text", "lang")
    i = F.col("doc_id")
    ts = F.timestamp_add("HOUR", i, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    published = (F.when(i % 17 == 0, F.lit("not-a-date"))
                 .when(i % 13 == 0, F.date_format(ts, "yyyy-MM-dd"))
                 .when(i % 31 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
                 .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
    category = (F.when(i % 19 == 0, F.lit(None).cast("string"))
                .when(i % 23 == 0, F.lit("general"))
                .when(i % 29 == 0, F.lit("News "))
                .when(i % 3 == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
                .otherwise(F.col("lang")))
    blank = i % 41 == 7
    base = d.select(
        i.cast("string").alias("article_id"),
        F.when(blank, F.lit("  ")).otherwise(F.substring_index("text", "\n", 1)).alias("title"),
        F.when((i % 7 == 0) | blank, F.lit("NaN")).otherwise(F.substring("text", 1, 200)).alias("description"),
        F.when(blank, F.lit("none")).otherwise(F.col("text")).alias("content"),
        category.alias("category"),
        published.alias("published_at"),
        (i * 2).alias("row_ord"))
    copies = (base.where(i_of(base) % 10 == 0)
              .withColumn("category", F.upper(F.col("category")))
              .withColumn("description", F.lit(None).cast("string"))
              .withColumn("row_ord", F.when(i_of(base) % 20 == 10, F.col("row_ord") - 1)
                          .otherwise(F.col("row_ord") + 1)))
    return base.unionByName(copies)


def i_of(df: DataFrame) -> Column:
    return df["article_id"].cast("bigint")


def article_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, embedding array<double>, label int) from the driver's labelled vectors."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("article_id"),
                    to_double_array("embedding").alias("embedding"), F.col("label"))


def vector_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that get an article vector in the flagship: all, also articles that fail preparation."""
    d = read_table(spark, sf_dir, "documents", deal=True).select("doc_id", "text")
    return d.select(F.col("doc_id").cast("string").alias("article_id"), F.col("text"))


def interactions(spark: SparkSession, sf_dir: str, graded: bool = False) -> DataFrame:
    """(user_id, item_id, rating, timestamp) likes from view/click/purchase events; items are spread over
    the documents' ids (0 to the largest)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    n_items = read_table(spark, sf_dir, "documents").agg(F.max("doc_id") + 1).scalar()
    # users with user_id % 50 = 7 like only items that no article has
    item = F.when(F.col("user_id") % 50 == 7, F.concat(F.lit("unknown-"), F.col("event_id") % 7)).otherwise((F.col("event_id") % n_items).cast("string"))
    keep = F.col("event_type").isin(*LIKE_EVENT_TYPES)
    rating = F.least(F.col("value") / 100.0, F.lit(1.0)) if graded else F.lit(1.0)
    return e.where(keep).select(
        F.col("user_id").cast("string").alias("user_id"),
        item.alias("item_id"),
        rating.cast("double").alias("rating"),
        F.col("ts").alias("timestamp"))


def user_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, preferences array<string>): for each event user, the document languages at sorted
    positions user_id % 4 and, when user_id % 3 = 0, also (user_id + 1) % 4."""
    langs = read_table(spark, sf_dir, "documents").select("lang").distinct()
    # Number the (few) distinct languages; the window runs over the distinct table only.
    from pyspark.sql import Window
    numbered = langs.withColumn("idx", (F.row_number().over(Window.orderBy("lang")) - 1).cast("bigint"))
    users = read_table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    wanted = users.select(u, F.explode(F.when(u % 3 == 0, F.array(u % 4, (u + 1) % 4))
                                       .otherwise(F.array(u % 4))).alias("idx"))
    return (wanted.join(numbered, "idx")
            .groupBy("user_id")
            .agg(F.array_sort(F.collect_set("lang")).alias("preferences"))
            .select(F.col("user_id").cast("string").alias("user_id"), "preferences"))


def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the queries it answers, before ranking (query, page_id, link, title, snippet)."""
    p = read_table(spark, sf_dir, "pages", deal=True).select("page_id", "url", "html")
    clean = H.remove_noise(F.col("html"))
    feats = p.select(
        "page_id", "url",
        F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1).alias("lang"),
        H.page_title(clean).alias("page_title"),
        F.substr(py_strip(H.first_paragraph_text(clean)), F.lit(1), F.when(empty_page(), SHORT_SNIPPET_CHARS).otherwise(SNIPPET_CHARS)).alias("snippet"))
    lang_q = feats.select("*", F.explode(F.array(*[F.lit(v) for v in SEARCH_LANGS])).alias("qlang")) \
        .where((F.col("lang") == F.col("qlang")) | (F.col("page_id") % 5 == 0)) \
        .select(F.concat(F.lit(QUERY_PREFIX), F.col("qlang")).alias("query"), "page_id", "url",
                "page_title", "snippet")
    default_q = feats.select(F.lit(DEFAULT_QUERY).alias("query"), "page_id", "url", "page_title", "snippet")
    hits = lang_q.unionByName(default_q)
    link = F.when(F.col("page_id") % 11 == 0, url_root(F.col("url"))).otherwise(F.col("url"))
    title = F.when((F.col("page_id") % 13 == 0) & (F.col("query") != F.lit(QUERY_PREFIX + "en")),
                   F.lit(None).cast("string")).otherwise(F.col("page_title"))
    return hits.select("query", "page_id", link.alias("link"), title.alias("title"), "snippet")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, pos 1-based, link, title, snippet): each query's hits ranked by page_id.

    The whole ranked list. Its readers ask for the first ``total`` hits of a query (``pos <= total``):
    Spark plans the filtered row_number as a WindowGroupLimit, so a query matching every page still
    sends at most ``total`` rows per map partition through the shuffle.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("query").orderBy("page_id")
    return (page_hits(spark, sf_dir)
            .withColumn("pos", F.row_number().over(w))
            .select("query", "pos", "link", "title", "snippet"))


def empty_page() -> Column:
    """Pages that came back without a text: their hits have a short snippet alone."""
    return F.col("page_id") % 17 == 3


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages", deal=True).select("page_id", "url", "html")
    return p.select("url", F.when(empty_page(), F.lit("")).otherwise(F.col("html")).alias("html"))
