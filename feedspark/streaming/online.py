"""Online recommendations as a stream of requests.

The reference's online phase answers one user per run. Here requests (``user_id`` rows) arrive as
files in a folder; every micro-batch recommends for the requested users (a semi-join of the batch
onto the profile table, so only those users' candidates are built) and writes the result to its own
partition ``batch_id`` of a Parquet sink. Progress goes through the checkpoint location; a batch that runs
again after a failure overwrites its partition, so rows are neither lost nor repeated.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encoder import Encoder
from ..operators.recommend import NUM_RECOMMENDATIONS, recommend

REQUEST_SCHEMA = "user_id string, requested_at timestamp_ntz"


def recommend_for(requests: DataFrame, profiles: DataFrame, top_categories: DataFrame,
                  search_results: DataFrame, pages: DataFrame, encoder: Encoder,
                  n: int = NUM_RECOMMENDATIONS) -> DataFrame:
    """Recommendations for the users named in ``requests`` (unknown users get no rows)."""
    wanted = requests.select("user_id").distinct()
    prof = profiles.join(wanted, "user_id", "left_semi")
    top = top_categories.join(wanted, "user_id", "left_semi")
    return recommend(prof, top, search_results, pages, encoder, n)


def start(spark: SparkSession, requests_dir: str, sink_dir: str, checkpoint_dir: str,
          inputs: Callable[[SparkSession], dict], encoder: Encoder, n: int = NUM_RECOMMENDATIONS,
          trigger: dict | None = None, max_files_per_trigger: int = 100):
    """Start the streaming query; ``inputs(spark)`` returns the tables recommend() needs
    (profiles, top_categories, search_results, pages), re-read per batch so fresh artifacts apply."""
    stream = (spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(requests_dir))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        t = inputs(batch.sparkSession)
        out = recommend_for(batch, t["profiles"], t["top_categories"], t["search_results"], t["pages"], encoder, n)
        out.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(**trigger) if trigger else w.trigger(availableNow=True)
    return w.start()
