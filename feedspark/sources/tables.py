"""Driver tables (one Parquet file or folder per table)."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, deal: bool = False) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it.

    ``deal`` is for text-heavy test tables: one file of one row group is read by a single task whatever the
    split size, so the rows of a table that is a single file are dealt over the cores. Tables that
    are folders of files, as large ones are, are never shuffled for it.
    """
    path = table_path(sf_dir, name)
    df = spark.read.parquet(path)
    if deal:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isFile():
            return df.repartition(spark.sparkContext.defaultParallelism)
    return df
