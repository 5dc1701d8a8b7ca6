"""Searches over several blocks of candidates and queries: merged results against all pairs, and one preparation for each block."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from feedspark.llm import ann, top_k, vector_blocks


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector_blocks, "CANDIDATE_ROWS", 60)
    monkeypatch.setattr(vector_blocks, "QUERY_ROWS", 7)


def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(500)]
    rows += [(600 + i, rows[3][1]) for i in range(30)] + [rows[9], rows[10], (700, [1.0, -2.0]), (740, None), (760, [0.0] * 16)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def best(rows, score, k, step):
    out = {}
    vectors = {}
    for i, v in rows:
        if v is not None:
            vectors[i] = np.pad(np.array(v, np.float64), (0, 16 - len(v)))
    for q in vectors:
        if q % step == 0:
            found = sorted((-score(vectors[q], x), i) for i, x in vectors.items() if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_top_k_of_several_blocks(spark, small_blocks):
    rows, df = table(spark)
    whole = lambda x: np.floor(256 * x)
    want = best(rows, lambda a, b: int(whole(a) @ whole(b)), 5, 10)
    got = {}
    for r in sorted(top_k.top_k(df, F.col("vec_id") % 10 == 0, 5).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want


def test_recall_of_neighbours_over_several_blocks(spark, small_blocks):
    rows, df = table(spark)
    rows = [(i, v) for i, v in rows if v is None or any(v)]
    want = best(rows, lambda a, b: float(a @ b), 20, 10)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, 20).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(i in got[q] for q, w in want.items() for i, _ in w)
    assert hits >= 0.9 * 20 * len(want)


def test_blocks_are_prepared_once(spark, small_blocks):
    rows, df = table(spark)
    made = spark.sparkContext.accumulator(0)

    def prepare(ids, x):
        made.add(1)
        return lambda q_ids, q: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    assert vector_blocks.search(df, F.col("vec_id") % 10 == 0, 3, prepare, "double").collect() == []
    assert made.value <= -(-len(rows) // 60) + 2  # of 57 query blocks each
