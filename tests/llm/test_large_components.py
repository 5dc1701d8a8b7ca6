"""Scores of components beyond 2**19 are exact as long as they fit a long."""
import math

import numpy as np

from feedspark.llm import top_k


def exact(w, v):
    s = sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(w, v))
    if abs(s) >= 1 << 63:
        c = [[max(-(1 << 27), min(1 << 27, math.floor(256 * a))) for a in z] for z in (w, v)]
        s = sum(a * b for a, b in zip(*c))
    return s


def test_components_beyond_the_old_limit():
    q = np.array([[1.0, 2.0, 0.0]])
    x = np.array([[600000.0, 1.0, 0.0], [700000.0, 1.0, 0.0], [700000.5, 1.0, 1e300]])
    _, ids, scores = top_k.maxscore(3)(np.array([1, 2, 3]), x)(np.array([9]), q)
    assert ids.tolist() == [3, 2, 1] and scores.tolist() == [exact(q[0], v) for v in x[::-1]]


def test_scores_about_the_limits_of_a_long():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 6)) * 10.0 ** rng.integers(-1, 9, (60, 6))
    m[0], m[1], m[2], m[3] = [1e300] * 6, [1e12, -1e12, 1, 0, 0, 0], [1e12, 1e12, 0, 0, 0, 0], [-1e300, 0, 0, 0, 0, 1]
    ids = np.arange(60)
    at, found, scores = top_k.maxscore(59)(ids, m)(ids, m)
    assert len(scores) == 60 * 59
    assert scores.tolist() == [exact(m[i], m[j]) for i, j in zip(at, found)]
    for i in ids:
        assert (np.diff(scores[at == i]) <= 0).all()
