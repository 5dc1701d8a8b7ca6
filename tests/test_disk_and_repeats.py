"""Artifacts are made once, and intermediate tables and shuffles go when they are read no more."""
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedspark.operators import silhouette as S
from feedspark.operators.encoder import HashedBagOfWords
from feedspark.operators.tuning import Projection
from feedspark.plans import registry as R
from feedspark.session import CLEANUP, cut_all, cut_lineage, shared_dir


@pytest.fixture
def own_rows(spark, tmp_path):
    d = str(tmp_path / "sf")
    docs = [(i, f"word{i % 7} common text {i}\nsecond line", ("en", "de")[i % 2], "s", 30) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    events = spark.range(18).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), (F.col("id") % 4).alias("user_id"),
                                    F.lit("view").alias("event_type"), F.lit(50.0).alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(f"{d}/events.parquet")
    vectors = [(i, [float(i % 3 == j) + (j == i % 5) * 0.1 for j in range(64)], i % 3) for i in range(30)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_artifacts_encode_and_prepare_once(spark, own_rows, tmp_path, monkeypatch):
    encoded, prepared = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            encoded.add(b.num_rows)
            yield b

    vectors, processed = R.article_vectors, R.processed
    monkeypatch.setattr(R, "article_vectors", lambda *a: (lambda v: v.mapInArrow(counted, v.schema))(vectors(*a)))
    monkeypatch.setattr(R, "processed", lambda *a: prepared.append(1) or processed(*a))
    root = R.write_offline_artifacts(spark, own_rows, str(tmp_path / "out"))
    assert encoded.value == 60 and len(prepared) == 1
    base, final = (spark.read.parquet(f"{root}/{n}") for n in ("base_embeddings", "article_embeddings"))
    assert base.count() == 60 and base.exceptAll(final).count() == 0 and final.exceptAll(vectors(spark, own_rows)).count() == 0


def test_cluster_metrics_keeps_no_texts(spark, own_rows, monkeypatch):
    folder, left = f"{shared_dir(spark)}/feedspark-tables", []
    before = set(glob.glob(f"{folder}/*"))

    def compare(variants, labels, k):
        made = set(glob.glob(f"{folder}/*")) - before
        left.extend(c for t in made for c in spark.read.parquet(t).columns)
        return spark.createDataFrame([(n, v.join(labels, "article_id").count(), k) for n, v in variants.items()], "variant string, n long, k int")

    monkeypatch.setattr(R, "tune", lambda base: Projection(np.eye(64)))
    monkeypatch.setattr(R.CE, "compare_variants", compare)
    rows = R.q_cluster_metrics(spark, own_rows).collect()
    n = R.processed(spark, own_rows).count()
    assert len(rows) == 2 and all(r["n"] == n for r in rows)
    assert sorted(left) == ["article_id", "article_id", "embedding", "label"]


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if os.path.basename(f).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    wide = [spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(3, "x") for _ in range(3)]
    before, set_before = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    tables = [cut_lineage(wide[0]), *cut_all(*wide[1:])]
    assert shuffle_files(spark) <= before and spark.conf.get(CLEANUP, None) == set_before
    assert [t.count() for t in tables] == [1000] * 3 and wide[0].count() == 1000


def test_silhouette_shuffles_no_vectors(spark):
    rng = np.random.default_rng(3)
    X, L = rng.normal(size=(300, 5)), rng.integers(0, 70, 300)  # also more clusters than are summed by a product
    df = spark.createDataFrame([(str(i), int(L[i]), X[i].tolist()) for i in range(300)], "article_id string, cluster int, embedding array<double>")
    plan = S.silhouette_points(df, "article_id", block_rows=40)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange ") == 1
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    want = []
    for i in range(300):
        own = L == L[i]
        a, b = D[i, own].sum() / max(own.sum() - 1, 1), min(D[i, L == c].mean() for c in set(L.tolist()) - {L[i]})
        want.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
    assert S.silhouette_exact(df, "article_id", block_rows=40).first()[0] == pytest.approx(np.mean(want), abs=1e-9)


def test_counts_of_a_long_text_search_no_array_for_each_bucket(spark):
    df = spark.createDataFrame([("a", " ".join(f"w{i % 97}" for i in range(3000))), ("b", None), ("c", "!")], "k string, t string")
    enc = HashedBagOfWords(64, normalize=False)
    got = {r["k"]: r["embedding"] for r in enc.encode(df, ["k"], "t").collect()}
    assert sum(got["a"]) == 3000 and got["b"] == got["c"] == [0.0] * 64
    assert "array_position" not in enc.encode(df, ["k"], "t")._jdf.queryExecution().toString()
