"""Operator 4: approximate nearest neighbours by randomly rotated one-bit codes.

Every candidate block keeps, for each vector's difference from the block's mean, the signs of its
coordinates after a random rotation into CODE_BITS dimensions (packed bits), the difference's length and
the inner product of the difference's direction with its code. A query's inner product is estimated from
the packed bits and those two numbers, with an error bound of BOUND standard widths. Rows whose upper
bound reaches the k-th highest lower bound are reranked by the inner product of the original vectors in
double precision, added up in the order of the components. Every row is indexed; nothing is trained.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do
rows with a null id; missing components of a shorter vector count as 0; rows with the query's own id are
not its candidates; an id in several rows is listed once, with its highest score; empty tables give no rows.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .vector_blocks import best, search

CODE_BITS = 256
#: Width of the error bound: BOUND / sqrt(code bits - 1) of the part of the query that the code does not see.
BOUND = 3.0
SEED = 20240607


def rotation(dim: int) -> np.ndarray:
    """dim rows of a random orthogonal matrix: rotates a vector padded by zeros to the code's length."""
    bits = code_bits(dim)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def code_bits(dim: int) -> int:
    return max(CODE_BITS, -(-dim // 64) * 64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, packed bits, lengths, inner products of direction and code) of a block."""
    mean = x.mean(axis=0)
    y = (x - mean) @ rotation(x.shape[1])
    length = np.linalg.norm(y, axis=1)
    fit = np.divide(np.abs(y).sum(axis=1), length * np.sqrt(y.shape[1]), out=np.ones(len(y)), where=length > 0)
    return mean, np.packbits(y > 0, axis=1), length, fit


def estimate(q: np.ndarray, turn: np.ndarray, mean, bits, length, fit) -> tuple[np.ndarray, np.ndarray]:
    """Estimates (queries by rows) and half-widths of their bounds; ``turn`` is the rotation."""
    turned = (q @ turn).astype(np.float32)
    n = turned.shape[1]
    signs = np.unpackbits(bits, axis=1, count=n).astype(np.float32) * 2 - 1
    by_code = turned @ signs.T / np.sqrt(n)
    est = (q @ mean)[:, None] + by_code * (length / fit)
    lost = np.sqrt(np.maximum(0, 1 - fit * fit)) / fit
    return est, np.linalg.norm(q, axis=1)[:, None] * (length * lost * BOUND / np.sqrt(n - 1)) + 1e-5


def one_bit(k: int):
    """Preparation of a block: its codes are made once, whatever the number of query blocks."""

    def prepare(ids, x):
        if not x.shape[1]:
            return lambda q_ids, q: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        code, turn = encode(x), rotation(x.shape[1])
        repeats = int(np.unique(ids, return_counts=True)[1].max())
        return lambda q_ids, q: asked(q_ids, q, ids, x, code, turn, repeats)

    def asked(q_ids, q, ids, x, code, turn, repeats):
        at, found, scores = [], [], []
        for lo in range(0, len(q_ids), 64):
            est, half = estimate(q[lo:lo + 64], turn, *code)
            for i in range(lo, min(lo + 64, len(q_ids))):
                mid, width = est[i - lo], half[i - lo]
                other = ids != q_ids[i]
                lower, upper = (mid - width)[other], (mid + width)[other]
                depth = k * repeats  # an id counts once
                floor = np.partition(lower, len(lower) - depth)[len(lower) - depth] if len(lower) > depth else -np.inf
                rows = np.flatnonzero(other)[upper >= floor]
                near = x[rows] @ q[i]
                if len(rows) > depth:  # rounding of this sum must not decide
                    edge = np.partition(near, len(near) - depth)[len(near) - depth]
                    rows = rows[near >= edge - 1e-9 * max(1.0, np.abs(near).max())]
                exact = np.zeros(len(rows))
                for d in range(x.shape[1]):
                    exact += x[rows, d] * q[i, d]
                top = best(exact, ids[rows], k)
                at.append(np.full(len(top), i))
                found.append(ids[rows[top]])
                scores.append(exact[top])
        return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

    return prepare


def nearest(rows: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score double): each query's k nearest found by inner product."""
    return search(rows, is_query, k, one_bit(k), "double", id_col, vector_col, drop_zero=True)


def op4(spark, sf_dir: str) -> DataFrame:
    return nearest(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
