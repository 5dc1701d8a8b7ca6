"""End-to-end offline and online runs on sf0.001, plus empty-input guards."""
import os

import pytest

from pyspark.sql import functions as F

from feedspark.operators import articles as A
from feedspark.operators import profiles as P
from feedspark.operators import recommend as R
from feedspark.operators import candidates as C
from feedspark.operators import cf as CF
from feedspark.operators import cluster_eval as CE
from feedspark.operators.encoder import HashedBagOfWords
from feedspark.plans.offline import run_offline
from feedspark.plans.online import run_online
from feedspark.sources import artifacts as AR
from feedspark.sources import fixtures as FX


def test_offline_then_online(spark, sf, tmp_path):
    out = str(tmp_path / "phase1")
    inter = FX.interactions(spark, sf)
    report = run_offline(spark, FX.articles(spark, sf), FX.user_preferences(spark, sf), inter, out)
    metrics = {(r.section, r.metric): r.value for r in report.collect()}
    assert metrics[("data", "processed_articles")] > 0 and metrics[("run", "total_seconds")] > 0
    assert ("clustering_final", "ari") in metrics and ("cf", "precision_at_k") in metrics
    root, out = out, AR.current(spark, out)
    assert os.path.isdir(os.path.join(out, "cf_users")) and AR.load_cf(spark, root) is not None
    losses = [metrics["tuning", f"held_out_loss_{i}"] for i in range(3)]
    assert min(losses) < losses[0]
    lines = spark.read.text(os.path.join(out, "evaluation_report_txt")).collect()
    assert lines[0].value.startswith("--- Offline Evaluation Report")
    # the same artifacts in memory give the same recommendations
    found, pages = FX.search_results(spark, sf), FX.pages(spark, sf)
    online = run_online(spark, root, found, pages)
    proc = spark.read.parquet(f"{out}/processed_articles")
    base = HashedBagOfWords().encode(proc.select("article_id", "combined_text"), ["article_id"], "combined_text")
    likes = inter.join(P.user_profiles(inter, base, 64).select("user_id"), "user_id", "left_semi")
    top = P.user_top_categories(P.user_category_counts(likes, base, A.category_lookup(proc)))
    want = R.recommend(P.user_profiles(likes, base, 64), top, found, pages, HashedBagOfWords())
    key = lambda df: sorted((r.user_id, r.rank, r.url, round(r.content_score, 9)) for r in df.collect())
    assert key(online) == key(want) and online.count() > 0


def test_online_needs_every_artifact_and_keeps_users_without_vectors(spark, sf, tmp_path):
    root = str(tmp_path / "art")
    inter = FX.interactions(spark, sf).limit(200)
    proc = A.prepare_articles(FX.articles(spark, sf))
    vecs = HashedBagOfWords().encode(proc.select("article_id", "combined_text"), ["article_id"], "combined_text")
    AR.write_table(proc, root, "processed_articles")
    AR.write_table(vecs.limit(0), root, "base_embeddings")  # no liked item has a base vector
    AR.write_table(P.user_profiles(inter, vecs, 64), root, "user_profiles")
    with pytest.raises(RuntimeError, match="interactions"):
        run_online(spark, root, FX.search_results(spark, sf), FX.pages(spark, sf))
    AR.write_table(inter, root, "interactions")
    AR.write_table(P.user_item_counts(inter), root, "user_items")
    got = run_online(spark, root, FX.search_results(spark, sf), FX.pages(spark, sf)).collect()
    assert got and {r.content_score for r in got} == {0.0}


def test_saved_filter_predicts_the_same(spark, sf, tmp_path):
    inter = FX.interactions(spark, sf, graded=True)
    model = CF.fit_full(inter, rank=4, epochs=2)
    AR.save_cf(model, spark, str(tmp_path / "m"))
    pairs = CF.rating_pairs(inter).limit(50).unionByName(spark.createDataFrame([("nobody", "nothing", 0.5)], "user_id string, item_id string, rating double"))
    key = lambda m: sorted((r.user_id, r.item_id, round(r.est, 9)) for r in m.predict(pairs).collect())
    got = key(AR.load_cf(spark, str(tmp_path / "m")))
    assert got == key(model) and len(got) == 51 and AR.load_cf(spark, str(tmp_path / "none")) is None


def test_synthesised_ids_from_position(spark):
    raw = spark.createDataFrame([("T1", "d", "c", "en", "2024-01-01"), ("T2", None, None, "de", "2024-01-02")],
                                "title string, description string, content string, category string, published_at string")
    out = A.prepare_articles(raw).collect()
    assert len(out) == 2 and len({r.article_id for r in out}) == 2


def test_empty_inputs_flow_through(spark):
    inter = spark.createDataFrame([], "user_id string, item_id string, rating double, timestamp timestamp_ntz")
    emb = spark.createDataFrame([], "article_id string, embedding array<double>")
    assert P.user_profiles(inter, emb, 4).count() == 0
    raw = spark.createDataFrame([], "title string, description string, content string, category string, published_at string")
    assert A.prepare_articles(raw).count() == 0


def test_every_candidate_needs_a_vector(spark, sf):
    hits = R.hit_candidates(FX.search_results(spark, sf), FX.pages(spark, sf), HashedBagOfWords())
    assert R.require_vectors(hits).count() > 0
    with pytest.raises(ValueError, match="no vector"):
        R.require_vectors(hits.withColumn("cand_vec", F.lit(None).cast("array<double>")))


def test_short_texts_are_dropped(spark):
    df = spark.createDataFrame([("x" * 29,), ("x" * 30,), (None,), ("y" * 5000,)], "text_for_embedding string")
    assert sorted(len(r[0]) for r in C.with_enough_text(df).collect()) == [30, 5000]


def test_nearest_centroid_on_no_rows(spark):
    emb = spark.createDataFrame([], "article_id string, embedding array<double>, label int")
    assert CE.nearest_centroid(emb).count() == 0 and CE.nearest_centroid(emb, dim=3).count() == 0


def test_counts_are_observed_while_tables_are_written(spark, tmp_path):
    from feedspark.session import cut_observed
    df = spark.range(10).withColumn("v", F.when(F.col("id") > 6, F.col("id")))
    table, seen = cut_observed(df, rows=F.count(F.lit(1)), lost=F.count_if(F.col("v").isNull()))
    assert seen == {"rows": 10, "lost": 7} and table.count() == 10
    assert cut_observed(df.limit(0), rows=F.count(F.lit(1)))[1] == {"rows": 0}
    assert AR.write_observed(df, str(tmp_path), "user_profiles", rows=F.count(F.lit(1)), last=F.max("id")) == {"rows": 10, "last": 9}


def test_recommendations_with_main_texts(spark, sf):
    found, pages = FX.search_results(spark, sf), FX.pages(spark, sf)
    by_tags, by_density = (R.hit_texts(found, pages, main_text=m).collect() for m in (False, True))
    assert len(by_tags) == len(by_density) and any(len(r.text_for_embedding or "") > 200 for r in by_density)


def test_profiles_are_the_same_with_hot_items_joined_apart(spark, sf):
    inter = FX.interactions(spark, sf)
    viral = inter.withColumn("item_id", F.when(F.hash("user_id", "timestamp") % 3 == 0, "5").otherwise(F.col("item_id")))
    vecs = FX.article_embeddings(spark, sf)
    key = lambda df: sorted((r.user_id, r.n_liked, [round(x, 9) for x in r.profile_embedding]) for r in df.collect())
    assert key(P.user_profiles(viral, vecs, 64, split_hot=True)) == key(P.user_profiles(viral, vecs, 64))
