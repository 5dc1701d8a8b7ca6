"""Corpus pipeline: quality classifier, language ID, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Between
stages the result is written as Parquet and read again, so that a lost executor repeats one stage's tasks at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedspark.llm import language, near_dup, packing, quality
from feedspark.llm.common import read
from feedspark.session import cut_lineage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted quality 1; learned from labels outside the held-out quarter."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels"), ~quality.held_out()))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or far from every centroid go."""
    return language.keep_identified(docs, language.train(docs, ~language.held_out()))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on shingles of five words."""
    return near_dup.keep_one(docs, k=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_dup_stage), ("packing", packing_stage)]

#: A network and centroids are fitted on the way, which SQL can't express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
