import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from feedspark.functions.vectors import cosine
from feedspark.operators import profiles as P
from feedspark.operators.encoder import HashedBagOfWords


def test_profile_mean_normalised_and_duplicates(spark):
    inter = spark.createDataFrame([("u", "a", None), ("u", "b", None), ("v", "a", None), ("v", "a", None),
                                   ("v", "b", None), ("w", "zzz", None)],
                                  "user_id string, item_id string, timestamp timestamp_ntz")
    emb = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 4.0])], "article_id string, embedding array<double>")
    got = {r.user_id: r.profile_embedding for r in P.user_profiles(inter, emb, 2).collect()}
    assert got["u"] == pytest.approx([0.6, 0.8])
    assert got["v"] == pytest.approx([6 / (36 + 16) ** 0.5, 4 / (36 + 16) ** 0.5])  # mean [2, 4/3]
    assert "w" not in got
    pe = {r.user_id: (r.profile_embedding, r.is_zero) for r in P.profile_embedding(inter, emb, 2).collect()}
    assert pe["w"] == ([0.0, 0.0], True)


def test_cosine_zero_vector_scores_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine("a", "b")).collect()]
    assert got == pytest.approx([0.0, 1.0])


def test_hashed_encoder_unit_norm_and_empty_text(spark):
    df = spark.createDataFrame([("1", "Hello world, hello!"), ("2", "!!! ..."), ("3", None)], "k string, t string")
    out = {r.k: r.embedding for r in HashedBagOfWords(16).encode(df, ["k"], "t").collect()}
    assert sum(x * x for x in out["1"]) == pytest.approx(1.0)
    assert max(out["1"]) == pytest.approx(2 / 5 ** 0.5)  # 'hello' twice, 'world' once
    assert out["2"] == [0.0] * 16 and out["3"] == [0.0] * 16


def test_hashed_encoder_equals_a_plain_count_inside_each_row(spark):
    rows = [("a", "Ä-b b,b 1\u00b2 x_y\nb"), ("a", "b"), ("long", " ".join(f"w{i % 977}" for i in range(30_000))), ("none", None), ("empty", "")]
    df = spark.createDataFrame(rows, "k string, t string").repartition(3)
    for dim in (1, 7, 64, 300):
        want = []
        for k, t in rows:
            v = [0.0] * dim
            for word in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()):
                if word:
                    v[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim] += 1.0
            want.append((k, v))
        enc = HashedBagOfWords(dim, normalize=False).encode(df, ["k"], "t")
        assert sorted((r.k, r.embedding) for r in enc.collect()) == sorted(want)
        assert "Exchange" not in HashedBagOfWords(dim).encode(spark.range(3).select(F.col("id").alias("k"), F.lit("a b").alias("t")), ["k"], "t")._jdf.queryExecution().toString()


def _load_char_model():
    import numpy as np

    def model(texts):
        out = np.zeros((len(texts), 4))
        for i, t in enumerate(texts):
            for ch in t:
                out[i, ord(ch) % 4] += 1.0
        return out
    return model


def test_pandas_model_encoder_matches_local_model(spark):
    import numpy as np
    from feedspark.operators.encoder import PandasModelEncoder
    texts = [("a", "hello world"), ("b", ""), ("c", "spark arrow batches")]
    df = spark.createDataFrame(texts, "k string, t string").repartition(2)
    got = {r.k: r.embedding for r in PandasModelEncoder(_load_char_model, dim=4).encode(df, ["k"], "t").collect()}
    local = _load_char_model()
    for k, t in texts:
        v = local([t])[0]
        n = np.linalg.norm(v)
        want = v / n if n > 0 else v
        assert got[k] == pytest.approx(list(want))
