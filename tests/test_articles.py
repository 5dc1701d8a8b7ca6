"""Article preparation: no cap, ids from content, CSV by column name."""
from pyspark.sql import functions as F

from feedspark.operators import articles as A
from feedspark.sources.articles_csv import read_articles_csv

SCHEMA = "title string, description string, content string, category string, published_at string"


def test_every_valid_article_stays(spark):
    n = 21_000
    raw = spark.range(n).select(
        F.col("id").cast("string").alias("article_id"), F.concat(F.lit("Title "), F.col("id")).alias("title"),
        F.lit(None).cast("string").alias("description"), F.lit("text").alias("content"),
        F.when(F.col("id") % 1000 == 0, F.lit(None).cast("string")).otherwise(F.lit("en")).alias("category"),
        F.lit("2024-01-01").alias("published_at"), F.col("id").alias("row_ord"))
    assert A.prepare_articles(raw).count() == n - n // 1000
    assert A.prepare_articles(raw, cap=50).count() <= 50


def test_made_ids_do_not_depend_on_the_layout(spark):
    rows = [(f"T{i}", "d", None, "en", "2024-01-01") for i in range(6)]
    one = A.prepare_articles(spark.createDataFrame(rows, SCHEMA).coalesce(1)).select("article_id", "combined_text").collect()
    many = A.prepare_articles(spark.createDataFrame(rows[::-1], SCHEMA).repartition(6)).select("article_id", "combined_text").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len({r[0] for r in one}) == 6


def test_blank_fields_and_null_categories_drop_rows(spark):
    rows = [("a", " ", "", "  ", "en", "2024-01-01"), ("b", "nan", "None", None, "en", "2024-01-01"), ("c", None, None, "x", "en", "2024-01-01"),
            ("d", "t", "d", "x", None, "2024-01-01"), ("e", "t", "d", "x", "en", "no date")]
    raw = spark.createDataFrame(rows, "article_id string, " + SCHEMA).withColumn("row_ord", F.monotonically_increasing_id())
    assert [r.article_id for r in A.prepare_articles(raw).collect()] == ["c"]


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('source,author,category,title,published_at,content,description,article_id\n'
                    'bbc,Ann,en,"Line one\nline ""two""",2024-01-01,Body,NaN,7\n', encoding="utf-8")
    row = read_articles_csv(spark, str(path)).first()
    assert row.asDict() == {"article_id": "7", "title": 'Line one\nline "two"', "description": None, "content": "Body", "category": "en", "published_at": "2024-01-01"}
    assert A.prepare_articles(read_articles_csv(spark, str(path)).withColumn("row_ord", F.lit(0).cast("long"))).count() == 1


def test_csv_without_ids_and_with_missing_columns(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("title,category,published_at\nOne,en,2024-01-01\nTwo,de,2024-01-02\n", encoding="utf-8")
    df = read_articles_csv(spark, str(path))
    assert "article_id" not in df.columns and df.where("content IS NULL").count() == 2
    out = A.prepare_articles(df).collect()
    assert sorted(r.combined_text for r in out) == ["One", "Two"] and len({r.article_id for r in out}) == 2


def test_csv_malformed_rows_can_be_counted(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("title,category,published_at\nOne,en,2024-01-01\nTwo,de,2024-01-02,extra,cells\n", encoding="utf-8")
    df = read_articles_csv(spark, str(path), corrupt_col="bad")
    assert [r.title for r in df.where("bad IS NOT NULL").collect()] == ["Two"]
