"""Search fed by a stored table of queries, filters taken over, and failures that can be seen."""
import pytest
from pyspark.sql import functions as F

from feedspark.sources import search as S


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "queries")
    rows = spark.range(10_000).select(F.concat(F.lit("q"), F.col("id")).alias("query"), F.lit(1).alias("query_idx"), (F.col("id") % 4).cast("int").alias("wanted"))
    rows.repartition(3).write.parquet(path)
    return path


def read(spark, path, fn, **options):
    S.register(spark)
    return spark.read.format("paged_search").option("queries_table", path).option("page_function", fn).options(**options).load()


def test_ten_thousand_queries_without_a_list_on_the_driver(spark, stored):
    df = read(spark, stored, "search_pages:any_query", rows_per_partition="1000")
    assert df.rdd.getNumPartitions() >= 10
    assert df.count() == sum(i % 4 for i in range(10_000))
    assert df.where("query = 'q7'").select("pos", "link").orderBy("pos").collect() == [(p, f"https://x.com/q7/{p}") for p in (1, 2, 3)]


def test_pushed_filters_spare_requests(spark, stored):
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        # every other query, and every position above 1, raises
        df = read(spark, stored, "search_pages:only_q7", status="true", pushdown="true").where("query = 'q7' AND pos <= 1")
        assert [(r.query, r.pos, r.status) for r in df.collect()] == [("q7", 1, "ok")]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_a_failing_page_function_can_be_seen(spark, stored):
    df = read(spark, stored, "search_pages:only_q7", status="true").where("query IN ('q6', 'q7')")
    got = sorted((r.query, r.pos, r.status) for r in df.collect() if r.pos is None or r.query == "q6")
    assert [g[0] for g in got] == ["q6", "q7"] and all("RuntimeError" in g[2] for g in got)
    assert read(spark, stored, "search_pages:only_q7").where("query = 'q6'").count() == 0


def test_search_all_of_a_data_frame(spark):
    queries = spark.createDataFrame([("q", 1, 13), ("q", 2, 4), ("bad", 1, 3), (None, 1, 3), ("none", 1, 5)], "query string, query_idx int, wanted int")
    got = S.search_all(queries, "search_pages:serve_or_fail").collect()
    assert sorted((r.query_idx, r.pos) for r in got if r.query == "q") == [(1, p) for p in range(1, 14)] + [(2, p) for p in range(1, 5)]
    assert [(r.pos, r.status) for r in got if r.query == "bad"] == [(None, "RuntimeError: quota exceeded")]
    assert not [r for r in got if r.query == "none"]
