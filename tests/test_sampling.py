"""Hash-order sampling against brute force: sort every row by (hash, key) and take the first n."""
import pytest
from pyspark.sql import functions as F

from feedspark.functions.hashing import hash32
from feedspark.operators import sampling as S
from feedspark.sources import fixtures as FX


def _brute(df, n, seed, key):
    rows = df.select(key, hash32(seed, F.col(key)).alias("h")).collect()
    return sorted(r[key] for r in sorted(rows, key=lambda r: (r.h, r[key]))[:n])


@pytest.mark.parametrize("n", [0, 1, 37, 500, 1099, 1100, 5000])
def test_sample_rows_matches_brute_force(spark, sf, n):
    arts = FX.articles(spark, sf).select("row_ord", "article_id")
    got = sorted(r.row_ord for r in S.sample_rows(arts, n, 42, ["row_ord"]).collect())
    assert got == _brute(arts, n, 42, "row_ord")


def test_sample_rows_coarse_histogram(spark, sf, monkeypatch):
    # few buckets: the n-th row falls inside a crowded bucket, which is then cut by its own top-k
    monkeypatch.setattr(S, "HISTOGRAM_BITS", 2)
    arts = FX.articles(spark, sf).select("row_ord")
    for n in (1, 60, 150):
        got = sorted(r.row_ord for r in S.sample_rows(arts, n, 7, ["row_ord"]).collect())
        assert got == _brute(arts, n, 7, "row_ord")
