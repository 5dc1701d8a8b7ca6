"""Operator 2: exact top-k search by MaxScore.

A vector component becomes the whole number floor(256 * x); dimensions are the terms, and each block
(shard) of candidates holds a posting list for every term. A term's score bound in a shard is the most
that the query's weight and any posting can give. Terms are taken by falling bound; those at the end whose
bounds together stay below the k-th score found so far are non-essential: no row can get into the
result by them alone. Essential postings are traversed and added up; the others are only probed, a few
terms at a time, for rows whose sum and remaining bounds are still competitive. Shards are merged.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows
with a null id; missing components of a shorter vector count as 0; a score that does not fit a
long is taken from components clipped to +-2**19 (and is the long nearest to that); a block in which scores may
come near the end of a long is scored whole; rows with the query's own id are not its candidates; an id that
occurs in several rows is listed once, with its highest score; empty tables give no rows.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .vector_blocks import best, search

SCALE, LIMIT = 256, 1 << 19
#: Rows scored at once to get a first threshold; terms probed between two tests.
FIRST_ROWS, PROBE_TERMS = 128, 8


def quantised(m: np.ndarray) -> np.ndarray:
    """Whole-number components, kept finite when scaled."""
    return np.floor(np.clip(m, -2.0**1015, 2.0**1015) * SCALE)


def large_scores(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of the rows of ``x`` where sums may be beyond a long: exact where they fit, else of clipped components."""
    x, w = x[:, w != 0], w[w != 0]
    with np.errstate(all="ignore"):
        size, about = np.abs(x) @ np.abs(w), x @ w
        fits = size < 2.0**62
        beyond = np.abs(about) - size * 2.0**-50 * (len(w) + 1) > 2.0**63
    most = LIMIT * SCALE
    cut_w, cut_x = np.clip(w, -most, most).astype(np.int64), np.clip(x, -most, most).astype(np.int64)
    beyond &= len(w) < 512  # clipped sums fit a long then
    out = np.zeros(len(x), np.int64)
    with np.errstate(all="ignore"):  # a component too large for a long meets zeros only
        out[fits] = x[fits].astype(np.int64) @ w.astype(np.int64)
    out[beyond] = cut_x[beyond] @ cut_w
    for r in np.flatnonzero(~fits & ~beyond):
        s = sum(int(a) * int(b) for a, b in zip(w, x[r]))
        if abs(s) >= 1 << 63:
            s = sum(int(a) * int(b) for a, b in zip(cut_w, cut_x[r]))
        out[r] = max(1 - (1 << 63), min((1 << 63) - 1, s))
    return out


def maxscore(k: int):
    """Preparation of a shard: its posting lists and their bounds are made once, whatever the number of query blocks."""

    def prepare(ids, x):
        x = quantised(x if x.shape[1] else np.zeros((len(x), 1)))
        low, high = x.min(axis=0), x.max(axis=0)
        lists = {}

        def asked(q_ids, q):
            q = quantised(q if q.shape[1] else np.zeros((len(q), 1)))
            terms = np.flatnonzero(q.any(axis=0) & ((low != 0) | (high != 0)))  # others add nothing to any score
            if not len(terms):
                terms = np.arange(1)
                return scored(q_ids, 0 * q[:, :1], ids, 0 * x[:, :1], 0 * low[:1], 0 * high[:1], np.zeros((1, len(ids)), np.float32), 0.0)
            whole = len(terms) == x.shape[1]
            with np.errstate(over="ignore"):
                most = float((np.abs(q).max(axis=0)[terms] * np.maximum(-low, high)[terms]).sum())
            kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # sums are exact in it
            if kind not in lists:
                with np.errstate(invalid="ignore", over="ignore"):
                    lists[kind] = np.ascontiguousarray(x.T.astype(kind))
            if whole:
                return scored(q_ids, q, ids, x, low, high, lists[kind], most)
            return scored(q_ids, q[:, terms], ids, x[:, terms], low[terms], high[terms], lists[kind][terms], most)

        return asked

    def scored(q_ids, q, ids, x, low, high, postings, most):
        kind = postings.dtype.type
        with np.errstate(invalid="ignore"):
            weights = q.astype(kind)
        at, found, scores = [], [], []
        for i in range(len(q_ids)):
            if most >= 2**62:
                rows = np.flatnonzero(ids != q_ids[i])
                sums = large_scores(q[i], x[rows])
                top = best(sums, ids[rows], k)
                at.append(np.full(len(top), i))
                found.append(ids[rows[top]])
                scores.append(sums[top])
                continue
            w = weights[i]
            bound = np.maximum(w * low.astype(kind), w * high.astype(kind))
            terms = np.argsort(-bound, kind="stable")
            rest = np.append(np.cumsum(bound[terms][::-1])[::-1], kind(0))  # bounds of the terms from here on
            other = ids != q_ids[i]
            first = np.flatnonzero(other[:FIRST_ROWS + 1])
            first = first[np.unique(ids[first], return_index=True)[1]]
            s = w @ postings[:, first]
            threshold = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else None
            # rest[e:] below the threshold: terms from e on are non-essential
            e = len(terms) if threshold is None else int(np.argmax(rest < threshold)) if (rest < threshold).any() else len(terms)
            sums = w[terms[:e]] @ postings[terms[:e]] if e else np.zeros(len(ids), kind)
            rows = np.flatnonzero(other & (sums + rest[e] >= threshold)) if threshold is not None else np.flatnonzero(other)
            sums = sums[rows]
            while e < len(terms):
                some = terms[e:e + PROBE_TERMS]
                sums = sums + w[some] @ postings[np.ix_(some, rows)]
                e += len(some)
                keep = sums + rest[e] >= threshold
                rows, sums = rows[keep], sums[keep]
            top = best(sums, ids[rows], k)
            at.append(np.full(len(top), i))
            found.append(ids[rows[top]])
            scores.append(sums[top].astype(np.int64))
        return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

    return prepare


def top_k(rows: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score long): each query's k highest inner products of whole-number components."""
    return search(rows, is_query, k, maxscore(k), "long", id_col, vector_col)


def op2(spark, sf_dir: str) -> DataFrame:
    return top_k(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
