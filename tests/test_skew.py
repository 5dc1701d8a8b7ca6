"""Joins with hot keys: the plain join's rows, and no task far above the others."""
import pytest
from pyspark.sql import functions as F

from feedspark.operators import skew


def tables(spark):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "viral").when(F.col("id") % 97 == 0, None).otherwise(F.concat(F.lit("i"), F.col("id") % 2000)).alias("item_id"), "id")
    right = spark.range(2500).select(F.concat(F.lit("i"), F.col("id")).alias("item_id"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([("viral", -1), (None, -2)], "item_id string, v long"))
    return left, right


def rows(df):
    return sorted(map(str, map(tuple, df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("how", skew.KINDS)
def test_equals_the_plain_join(spark, how):
    left, right = tables(spark)
    assert skew.hot_keys(left, "item_id") == ["viral"]
    assert rows(skew.split_join(left, right, "item_id", how)) == rows(left.join(right, "item_id", how))


def test_no_task_gets_the_hot_key(spark):
    left, right = tables(spark)
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        plain, split = sizes(left.join(right, "item_id")), sizes(skew.split_join(left, right, "item_id"))
        assert plain[-1] > 4 * plain[len(plain) // 2] and split[-1] <= 2 * split[len(split) // 2]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_many_right_rows_of_a_hot_key_and_empty_sides(spark):
    left, right = tables(spark)
    wide = spark.range(50).select(F.lit("viral").alias("item_id"), F.col("id").alias("v"))
    small = left.limit(300)
    assert rows(skew.split_join(small, wide, "item_id", most_rows=10)) == rows(small.join(wide, "item_id"))
    assert skew.split_join(left.limit(0), right, "item_id").count() == 0
    assert skew.split_join(left, right.limit(0), "item_id", "left").count() == 30_000
    with pytest.raises(ValueError):
        skew.split_join(left, right, "item_id", "full")
