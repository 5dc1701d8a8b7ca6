"""Offline run (the reference's first script) as one Spark job sequence.

prepare articles -> embed -> tune -> clustering evaluation -> likes -> CF evaluation and final model ->
user profiles -> report. Every artifact is a Parquet table in this run's folder under ``out``, which becomes the
current one in one step when all are written: a failed run leaves the former set as it is.

usage: python -m feedspark.plans.offline --out DIR [--sf-dir DIR | --articles-csv PATH --preferences PATH --interactions PATH]
"""
from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import cf as CF
from ..operators import cluster_eval as CE
from ..operators import profiles as P
from ..operators import report as RP
from ..operators.encoder import Encoder, HashedBagOfWords
from ..operators.tuning import tune
from ..sources import artifacts as AR


def run_offline(spark: SparkSession, raw_articles: DataFrame, preferences: DataFrame, interactions: DataFrame, out: str,
                encoder: Encoder | None = None, final_encoder: Encoder | None = None) -> DataFrame:
    """Returns the metrics table (also written to ``out``). Without ``final_encoder`` the final vectors are the base vectors under a
    projection tuned by the contrastive loss."""
    started = time.perf_counter()
    root, out = out, AR.new_snapshot(out)
    enc = encoder or HashedBagOfWords()
    parts = []

    processed = A.prepare_articles(raw_articles)
    # counts are observed while the artifacts are written; labels are numbered from 0 without a gap
    seen = AR.write_observed(processed, out, "processed_articles", rows=F.count(F.lit(1)), last_label=F.max("category_encoded"))
    processed = spark.read.parquet(AR.artifact_path(out, "processed_articles"))  # lineage cut at the artifact
    n_processed = seen["rows"]
    if n_processed == 0:
        raise ValueError(f"none of {raw_articles.count()} input rows has an id, a category, text and a valid date")
    counted = [("data", "processed_articles", float(n_processed), "")]

    text = processed.select("article_id", "combined_text")
    AR.write_table(enc.encode(text, ["article_id"], "combined_text"), out, "base_embeddings")
    base = spark.read.parquet(AR.artifact_path(out, "base_embeddings"))
    if final_encoder:
        final = final_encoder.encode(text, ["article_id"], "combined_text")
    else:
        projection = tune(base)
        final = projection.project(base)
        parts += [spark.createDataFrame([("tuning", f"held_out_loss_{i}", float(v), "") for i, v in enumerate(projection.held_out)], "section string, metric string, value double, note string")]
    AR.write_table(final, out, "article_embeddings")
    final = spark.read.parquet(AR.artifact_path(out, "article_embeddings"))

    labels = processed.select("article_id", F.col("category_encoded").alias("label"))
    k = seen["last_label"] + 1
    if n_processed > 1:
        cm = CE.compare_variants({"final": final, "base": base}, labels, k)
        parts.append(cm.select(F.concat(F.lit("clustering_"), "variant").alias("section"), "metric", "value", "note"))

    seen = AR.write_observed(interactions, out, "interactions", rows=F.count(F.lit(1)))
    likes = spark.read.parquet(AR.artifact_path(out, "interactions"))
    AR.write_table(P.user_item_counts(likes), out, "user_items")
    counted.append(("interactions", "interactions", float(seen["rows"]), ""))

    if seen["rows"] > CF.MIN_INTERACTIONS:
        try:
            pred = CF.fit_predict(likes)
            parts.append(RP.metric_rows("cf", CF.precision_recall_at_k(pred)))
            AR.save_cf(CF.fit_full(likes), spark, out)
        except Exception as e:  # noqa: BLE001 - keep going without a CF model, like the reference
            AR.remove_cf(spark, out)
            parts.append(spark.createDataFrame([("cf", "error", None, str(e)[:200])], "section string, metric string, value double, note string"))
    else:
        AR.remove_cf(spark, out)
        parts.append(spark.createDataFrame([("cf", "skipped", None, "insufficient interactions")],
                                           "section string, metric string, value double, note string"))

    dim = enc.dim
    profiles = P.user_profiles(likes, final, dim, preferences, split_hot=True)
    seen = AR.write_observed(profiles, out, "user_profiles", rows=F.count(F.lit(1)))
    counted.append(("profiles", "users_with_profiles", float(seen["rows"]), ""))

    parts.append(spark.createDataFrame([
        *counted,
        ("run", "total_seconds", time.perf_counter() - started, ""),
        ("run", "cluster_rows", float(n_processed), ""),
        ("run", "encoder_dim", float(dim), type(enc).__name__)], "section string, metric string, value double, note string"))
    report = RP.union_all(parts)
    AR.write_table(report, out, "evaluation_report")
    RP.write_report(spark.read.parquet(AR.artifact_path(out, "evaluation_report")),
                    AR.artifact_path(out, "evaluation_report_txt"), "Offline Evaluation Report")
    AR.publish_snapshot(spark, root, out)
    AR.prune_snapshots(spark, root)
    return spark.read.parquet(AR.artifact_path(out, "evaluation_report"))


def main(argv=None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--out", required=True)
    ap.add_argument("--sf-dir")
    ap.add_argument("--articles-csv")
    ap.add_argument("--preferences", help="Parquet (user_id, preferences array<string>)")
    ap.add_argument("--interactions", help="Parquet (user_id, item_id, rating, timestamp)")
    args = ap.parse_args(argv)
    from ..session import get_spark
    from ..sources import articles_csv, fixtures
    spark = get_spark("feedspark-offline")
    if args.sf_dir:
        raw, prefs = fixtures.articles(spark, args.sf_dir), fixtures.user_preferences(spark, args.sf_dir)
        likes = fixtures.interactions(spark, args.sf_dir)
    else:
        raw, prefs = articles_csv.read_articles_csv(spark, args.articles_csv), spark.read.parquet(args.preferences)
        likes = spark.read.parquet(args.interactions)
    run_offline(spark, raw, prefs, likes, args.out).show(100, truncate=False)


if __name__ == "__main__":
    main()
