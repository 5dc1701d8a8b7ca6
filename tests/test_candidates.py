from pyspark.sql import functions as F

from feedspark.operators import candidates as C
from feedspark.operators import profiles as P


def test_quota_closed_form(spark):
    def loop(total, n):
        rem, out = total, []
        for i in range(n):
            c = max(1, rem // (n - i))
            out.append(c)
            rem -= c
        return out

    rows = [(f"{t}-{n}", i + 1, n) for t in (2, 3, 20, 21, 37) for n in (1, 2, 3, 4, 5) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id string, query_idx int, n_queries int")
    for total in (2, 3, 20, 21, 37):
        got = {}
        for r in C.with_quota(df.where(F.col("user_id").startswith(f"{total}-")), total).collect():
            got.setdefault(r.n_queries, {})[r.query_idx] = r.quota
        for n, d in got.items():
            assert [d[i] for i in sorted(d)] == loop(total, n), (total, n)


def test_quota_fixture(spark):
    df = spark.createDataFrame([("u", 1, 3), ("u", 2, 3), ("u", 3, 3)], "user_id string, query_idx int, n_queries int")
    assert [r.quota for r in C.with_quota(df).orderBy("query_idx").collect()] == [6, 7, 7]


def test_top_categories_fixtures(spark):
    rows = [("u1", "sports", 2), ("u1", "business", 2), ("u1", "general", 5),
            ("u2", "general", 5), ("u2", "news", 1),
            ("u3", "d", 1), ("u3", "c", 1), ("u3", "b", 1), ("u3", "a", 1)]
    df = spark.createDataFrame(rows, "user_id string, category string, n long")
    got = {}
    for r in P.user_top_categories(df).orderBy("user_id", "topic_rank").collect():
        got.setdefault(r.user_id, []).append(r.category)
    assert got == {"u1": ["business", "sports"], "u2": ["general", "news"], "u3": ["a", "b", "c"]}


def test_user_without_categories_gets_default_query(spark):
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    top = spark.createDataFrame([("u1", 1, "en", 3)], "user_id string, topic_rank int, category string, n long")
    got = {r.user_id: r.query for r in C.user_queries(users, top).collect()}
    assert got == {"u1": "latest news en", "u2": "top breaking news"}


def test_text_choice_and_display(spark):
    rows = [("a" * 45, "s" * 30), ("a" * 46, "s" * 30), (None, "s" * 29), ("a" * 5, None), ("a" * 2000, "s" * 100)]
    df = spark.createDataFrame(rows, "full_text string, snippet string")
    got = [r[0] for r in df.select(C.embedding_text(F.col("full_text"), F.col("snippet"))).collect()]
    assert got == ["s" * 30, "a" * 46, "s" * 29, "a" * 5, "a" * 2000]
    rows = [("meta", "f" * 300, "snip"), (None, "f" * 300, "snip"), (None, None, "snip"), ("", None, "snip")]
    df = spark.createDataFrame(rows, "d string, full_text string, snippet string")
    got = [r[0] for r in df.select(C.display_description(F.col("d"), F.col("full_text"), F.col("snippet"))).collect()]
    assert got == ["meta", "f" * 250 + "...", "snip", "snip"]


def test_usable_filter_keeps_whole_texts(spark):
    cands = spark.createDataFrame([("u", "https://x.com/a/b", 1, 1, "T", "s" * 29),
                                   ("u", "https://x.com/c/d", 1, 2, "T", "s" * 10)],
                                  "user_id string, link string, query_idx int, pos int, title string, snippet string")
    feats = spark.createDataFrame([("https://x.com/c/d", None, "w" * 2000)], "url string, description string, full_text string")
    out = C.with_enough_text(C.with_candidate_text(cands, feats)).collect()
    assert len(out) == 1 and out[0].link == "https://x.com/c/d" and len(out[0].text_for_embedding) == 2000


def test_url_dedupe_before_title_check(spark):
    hits = spark.createDataFrame([("u", 1, 1, "https://x.com/a/b-1", None, "s"),
                                  ("u", 2, 1, "https://x.com/a/b-1", "Titled", "s")],
                                 "user_id string, query_idx int, pos int, link string, title string, snippet string")
    queries = spark.createDataFrame([("u", 1, "q1", 2, 10), ("u", 2, "q2", 2, 10)],
                                    "user_id string, query_idx int, query string, n_queries int, quota int")
    results = hits.select(F.when(F.col("query_idx") == 1, "q1").otherwise("q2").alias("query"), "pos", "link",
                          "title", "snippet")
    assert C.candidate_articles(queries, results).count() == 0
