"""Whitening against numpy's dense eigenvectors, with exact whole-number sums."""
import math

import numpy as np
import pytest

from feedspark.llm import whitening

from .conftest import odd_embeddings


def plain(rows, k=16):
    whole = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in whole), default=0)
    x = {n: [math.floor(64 * float(np.float32(c))) + 1000000 for c in v] + [1000000] * (dim - len(v)) for n, (_, v) in enumerate(whole)}
    fit = sorted({tuple(v) for v in x.values()})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, total)] for v in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = min(k, int((values > 1e-12 * values[0]).sum())) if n > 1 else 0
    return {"n": n, "values": values[:some], "explained": values[:some] / values.sum(),
            "rows": [(whole[j][0], sum((n * c - s) ** 2 for c, s in zip(v, total)), np.array([(n * c - s) / n for c, s in zip(v, total)]) @ vectors[:, :some] / np.sqrt(values[:some])) for j, v in x.items()]}


def compare(got, want, checked=None):
    some = len(want["values"])
    assert len(got) == some * len(want["rows"])
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    signs = np.zeros(some)
    for key, deviation, white in want["rows"]:
        at = by[key, deviation]
        mine = np.array([at[c][0]["whitened"] for c in range(1, some + 1)])
        for c in range(some):
            if not signs[c] and abs(white[c]) > 1e-6:
                signs[c] = np.sign(white[c] * mine[c])
        use = range(some) if checked is None else checked
        assert all(abs(mine[c] * signs[c] - white[c]) < 1e-6 for c in use if signs[c])
    assert all(r["n"] == want["n"] and r["identity_error"] <= 1e-4 for r in got)
    assert all(abs(r["explained"] / want["explained"][r["component"] - 1] - 1) < 1e-9 for r in got)


def test_sf_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    compare(whitening.op12(spark, sf).collect(), plain([(r["vec_id"], r["embedding"]) for r in rows.collect()]))


def test_odd_table(spark, odd_dir):
    got = whitening.op12(spark, odd_dir).collect()
    compare(got, plain([(r["vec_id"], r["embedding"]) for r in odd_embeddings()]))
    assert sum(r["vec_id"] is None for r in got) == 8


@pytest.mark.parametrize("fan_in,block", [(64, 4096), (2, 16)])
def test_many_blocks_and_a_tree_of_sums(spark, monkeypatch, fan_in, block):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    data = (rng.standard_normal((400, 70)) * np.linspace(3, 0.5, 70)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    got = whitening.whiten(df, 5)
    compare(got.collect(), plain(rows, 5))


def test_equal_and_flat_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame([(1, []), (2, None)])).collect() == []
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    got = whitening.whiten(frame(line)).collect()
    assert len(got) == 9 and all(r["component"] == 1 for r in got)
    compare(got, plain(line))
    huge = whitening.whiten(frame([(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 7.0])])).collect()
    assert any(r["deviation"] is None for r in huge) or all(r["deviation"] >= 0 for r in huge)


def test_an_iteration_that_needs_many_rounds(spark):
    """Wanted and unwanted eigenvalues lie close together."""
    rng = np.random.default_rng(4)
    data = np.linalg.qr(rng.standard_normal((300, 90)))[0] * 17.32 * np.sqrt(np.linspace(1.3, 1.0, 90)) * 20
    rows = [(i, v.tolist()) for i, v in enumerate(data.astype(np.float32))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 8)
    compare(got.collect(), plain(rows, 8))
    assert got.agg({"residual": "max"}).first()[0] < 1e-10 * got.agg({"eigenvalue": "max"}).first()[0]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_a_flat_spectrum_far_from_zero(seed):
    """Many vectors without a direction of their own: some columns are certified rounds before the others."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    values = np.sort(rng.uniform(61.0, 66.5, 64))[::-1]
    covariance = (basis * values) @ basis.T

    class Dense:
        n, dim = 1, 64

        def product(self, q):
            return covariance @ q

    got = whitening.leading(Dense(), 16)
    assert (got.residuals <= whitening.TOLERANCE * got.values[0]).all() and np.allclose(got.values, values[:16], rtol=1e-12)
    assert got.passes < 400
