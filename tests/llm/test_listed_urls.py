"""URL filter with a given list: listed and unlisted pages on the same host; false positives of the Bloom filter go."""
from pyspark.sql import functions as F

from feedspark.llm import url_filter


def test_list_decides_between_pages_of_one_host(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.site.org/a/"), F.col("id"), F.lit(".html?x=1")).alias("url"))
    listed = spark.range(0, 400, 3).select(F.concat(F.lit("https://m.site.org/a/"), F.col("id"), F.lit("/#top")).alias("u"))
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.judge(pages, listed).collect()}
    assert got == {i: ("block" if i % 3 == 0 else "allow", None) for i in range(400)}


def test_false_positives_of_the_filter_are_removed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 2)
    listed = spark.range(60).select(F.concat(F.lit("http://site.org/listed/"), F.col("id")).alias("u"))
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://site.org/"), F.when(F.col("id") < 60, "listed/").otherwise("other/"), F.col("id")).alias("url"))
    keys = url_filter.page_keys(pages.select("url"), [])
    filter_, n_blocks = url_filter.bloom(listed.select(F.concat(F.lit("Usite.org/listed/"), F.substring_index("u", "/", -1)).alias("key")), 60)
    possible = url_filter.possible_hits(keys, filter_, n_blocks).select("url").distinct().count()
    assert 60 < possible < 3000  # the filter alone passes some that are not listed
    got = url_filter.judge(pages, listed).where("verdict = 'block'").collect()
    assert sorted(r["page_id"] for r in got) == list(range(60))
