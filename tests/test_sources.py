import json

from feedspark.sources import search as S
from feedspark.sources.artifacts import artifact_manifest, load_artifacts, write_table


def read(spark, queries, fn):
    S.register(spark)
    return (spark.read.format("paged_search").option("queries", json.dumps(queries))
            .option("page_function", fn).load())


def test_paged_search_quota_and_pages(spark):
    df = read(spark, [{"query": "q", "wanted": 13}, {"query": "q", "wanted": 40, "query_idx": 2},
                      {"query": "none", "wanted": 5}], "search_pages:serve")
    rows = df.collect()
    first = [r for r in rows if r.query_idx == 1]
    assert [r.pos for r in first] == list(range(1, 14)) and first[12].link == "https://x.com/a/13"
    assert len([r for r in rows if r.query_idx == 2]) == 25
    assert not [r for r in rows if r.query == "none"]


def test_paged_search_stops_on_empty_and_keeps_partial(spark):
    assert read(spark, [{"query": "q", "wanted": 20}], "search_pages:empty_forever").count() == 0
    assert read(spark, [{"query": "q", "wanted": 20}], "search_pages:failing").count() == 10


def test_paged_search_without_page_function(spark):
    S.register(spark)
    df = spark.read.format("paged_search").option("queries", json.dumps([{"query": "q", "wanted": 5}])).load()
    assert df.count() == 0


def test_artifacts_required_and_optional(spark, tmp_path):
    root = str(tmp_path / "art")
    arts, ok = load_artifacts(spark, root)
    assert not ok
    df = spark.range(3).selectExpr("cast(id as string) as user_id")
    for name in ("processed_articles", "base_embeddings", "user_profiles", "interactions", "user_items"):
        write_table(df, root, name)
    arts, ok = load_artifacts(spark, root)
    assert ok and arts["cf_users"] is None and arts["user_profiles"].count() == 3
    man = {r.artifact: (r.present, r.rows) for r in artifact_manifest(spark, root).collect()}
    assert man["user_profiles"] == (True, 3) and man["cf_users"] == (False, None)


def test_publish_replaces_and_keeps_the_old_on_failure(spark, tmp_path):
    import pytest

    from feedspark.sources.artifacts import publish
    root = str(tmp_path / "art")
    write_table(spark.range(3), root, "user_items")
    write_table(spark.range(5), root, "user_items")
    assert spark.read.parquet(f"{root}/user_items").count() == 5
    with pytest.raises(Exception):
        publish(spark, f"{root}/not-there", f"{root}/user_items")
    assert spark.read.parquet(f"{root}/user_items").count() == 5
