from pyspark.sql import functions as F

import __spark_entry__ as E
from feedspark.plans import registry as RG
from feedspark.sources import fixtures as FX
from feedspark.streaming import online


def inputs(spark, sf):
    _, _, _, profiles, top = RG.flagship_parts(spark, sf)
    return {"profiles": profiles, "top_categories": top, "search_results": FX.search_results(spark, sf),
            "pages": FX.pages(spark, sf)}


def test_stream_of_requests_matches_batch(spark, sf, tmp_path):
    users = [r.user_id for r in inputs(spark, sf)["profiles"].select("user_id").limit(3).collect()]
    req_dir, sink, ckpt = str(tmp_path / "req"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    reqs = spark.createDataFrame([(u,) for u in users] + [("no-such-user",)], "user_id string") \
        .withColumn("requested_at", F.lit(None).cast("timestamp_ntz"))
    reqs.write.parquet(req_dir)
    q = online.start(spark, req_dir, sink, ckpt, lambda s: inputs(s, sf), RG.encoder())
    q.awaitTermination(300)
    got = spark.read.parquet(sink).drop("batch_id")
    want = E.queries()["recommendations"](spark, sf).where(F.col("user_id").isin(users)) \
        .withColumn("content_score", F.col("content_score"))
    g = sorted((r.user_id, r.rank, r.url) for r in got.collect())
    w = sorted((r.user_id, r.rank, r.url) for r in want.collect())
    assert g == w and g
