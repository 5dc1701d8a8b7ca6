"""Distributed numbering and first-per-key against plain Python."""
import pytest
from pyspark.sql import functions as F

from feedspark.operators.ranking import first_per_key, global_row_number


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_numbering_with_a_payload(spark, reuse):
    n = 200_000
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(n, numPartitions=16).select(
            F.col("id"), F.xxhash64("id").alias("h"), F.repeat(F.col("id").cast("string"), 20).alias("payload"))
        out = global_row_number(df, [F.col("h"), F.col("id")], "rn", total_col="total")
        row = out.agg(F.count("*"), F.countDistinct("rn"), F.min("rn"), F.max("rn"), F.min("total"), F.max("total")).first()
        assert tuple(row) == (n, n, 1, n, n, n)
        got = [r[0] for r in out.orderBy("rn").limit(1000).select("h").collect()]
        assert got == [r[0] for r in df.orderBy("h").limit(1000).select("h").collect()]
        sizes = out.groupBy(F.floor((F.col("rn") - 1) / 8)).count().where("count <> 8").count()
        assert sizes == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_first_per_key_keeps_whole_rows_by_a_hash_aggregate(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), ("b", 6, "z")], "k string, o int, v string")
    out = first_per_key(df, ["k"], ["o"])
    assert sorted(map(tuple, out.select("k", "o", "v").collect())) == [("a", 1, "y"), ("b", 5, None)]
    wide = out._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in wide and "collect_list" not in wide
