"""Operator 12: embedding whitening by Chebyshev-filtered subspace iteration.

An entry c becomes the whole number floor(64 * c) + 1000000. The fit list (each distinct vector once) is written as
packed blocks. The covariance is never formed: a pass over the blocks gives Xᵀ(XQ)/n for the centred rows X and a
thin matrix Q, added up from one partial product of each task. A round puts the not yet certified columns through a
Chebyshev polynomial of the covariance, one pass for each degree, whose interval covers the unwanted end of the spectrum
(from a bound of a short Lanczos run to the block's smallest Ritz value) and so damps it; then QR and
Rayleigh-Ritz. Leading columns whose residual is within TOLERANCE of the largest eigenvalue are certified: they
stay and are projected out of the others. The rounds end when all wanted columns are certified; without progress
they end with an error.

Rows are centred in whole numbers, (n * x - S) / n, before anything is multiplied.

Defined results: rows whose vector is null or holds null or non-finite entries are left out; missing entries
of a shorter vector count as 0; entries beyond +-2**40 count as that; a row with a null id is returned under it; repeated rows are
each returned and count once in the fit list. Components without variance (eigenvalue below RANK_FLOOR of the largest) do not
exist, so that few or equal vectors give fewer components, or no rows. A deviation that does not fit a long is null.
Other columns are not read; the empty table gives no rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_tables
from . import common
from .common import slices

SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**40
COMPONENTS, BLOCK_ROWS = 16, 4096
#: Columns of the iterated block for each wanted component; highest degree; Lanczos steps; rounds without end mean failure.
GUARD, DEGREE, LANCZOS, ROUNDS = 2, 16, 10, 60
TOLERANCE, RANK_FLOOR = 2e-13, 1e-12
#: Most by which one filter may raise the first column over the damped ones: more would drown the small ones in rounding.
RAISE = 1e10
SEED = 16180
#: Partial products that one task or the driver adds up.
FAN_IN = 64


def whole_numbers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the rows that take part, their vectors x as whole numbers)."""
    flat = column.flatten()
    if not column.null_count and not flat.null_count and (np.diff(column.offsets.to_numpy()) == dim).all():
        at, m = np.arange(len(column)), flat.to_numpy().reshape(-1, dim).astype(np.float64)
    else:
        rows = [(i, v) for i, v in enumerate(column.to_pylist()) if v is not None and None not in v]
        at, m = np.array([i for i, _ in rows], np.int64), np.zeros((len(rows), dim))
        for k, (_, v) in enumerate(rows):
            m[k, :len(v)] = v
    good = np.isfinite(m).all(axis=1)
    return at[good], np.floor(SCALE * np.clip(m[good], -LIMIT, LIMIT)).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n, taken in whole numbers as long as they fit."""
    if n * float(np.abs(x).max(initial=1)) < 2**61:
        return (n * x - total.astype(np.int64)) / n
    return (x - np.array([int(s) // n for s in total], np.int64)) - np.array([(int(s) % n) / n for s in total])


@dataclass
class FitList:
    """The distinct vectors, packed: blocks (rows int, data binary), and their number, sums, and dimension."""
    blocks: DataFrame
    count: int
    n: int
    dim: int
    total: np.ndarray  # of Python integers

    def add_up(self, function, size: int) -> np.ndarray:
        """Sum of ``function(centred rows)`` (``size`` doubles) over all blocks, in an order that does not change."""
        n, total, dim = self.n, self.total, self.dim

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = None
            for batch in batches:
                for data in batch.column("data"):
                    got = function(centred(np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dim), n, total))
                    acc = got if acc is None else acc + got
            if acc is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([acc.astype("<f8").tobytes()])], names=["task", "data"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc, task = None, None
            for batch in batches:
                for t, data in zip(batch.column("task").to_pylist(), batch.column("data")):
                    one = np.frombuffer(data.as_buffer(), "<f8")
                    acc, task = (one.copy(), t) if acc is None else (acc + one, task)
            if acc is not None:
                yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([acc.tobytes()])], names=["task", "data"])

        parts, left = self.blocks.mapInArrow(part, "task long, data binary"), self.count
        while left > FAN_IN:  # a tree: no task and not the driver adds more than about FAN_IN partial products
            left = -(-left // FAN_IN)
            parts = parts.repartitionByRange(left, "task").sortWithinPartitions("task").mapInArrow(merge, "task long, data binary")
        rows = sorted((r["task"], bytes(r["data"])) for r in parts.collect())
        return sum((np.frombuffer(d, "<f8") for _, d in rows), np.zeros(size))

    def product(self, q: np.ndarray) -> np.ndarray:
        """V Q: one pass."""
        return self.add_up(lambda x: (x.T @ (x @ q)).ravel(), q.size).reshape(q.shape) / self.n


def fit_list(rows: DataFrame, vector_col: str) -> FitList | None:
    """None if no vector takes part."""
    dim = rows.agg(F.max(F.size(vector_col)).alias("d")).first()["d"] or 0
    if dim <= 0:
        return None

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK_ROWS):
            x = np.unique(whole_numbers(batch.column(0), dim)[1], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<i8").tobytes() for r in x], pa.binary())], names=["x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK_ROWS):
            data = b"".join(batch.column(0).to_pylist())
            x = np.frombuffer(data, "<i8").reshape(-1, dim)
            # sums of BLOCK_ROWS numbers below 2**47 fit a long
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([data]), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["rows", "data", "sums"])

    # a vector that many rows share is one row of each map task before the exchange
    distinct = rows.select(vector_col).where(F.col(vector_col).isNotNull()).mapInArrow(whole, "x binary").distinct()
    blocks = cut_lineage(distinct.mapInArrow(pack, "rows long, data binary, sums array<long>"))
    sums = blocks.select("rows", F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.sum("rows").alias("n"), F.count(F.lit(1)).alias("c"))
    found = sorted((r["pos"], int(r["s"]), r["n"], r["c"]) for r in sums.collect())  # a row of each dimension
    if not found:
        return None
    return FitList(blocks.select("data"), found[0][3], found[0][2], dim, np.array([s for _, s, _, _ in found], object))


def lanczos_floor(fit: FitList, steps: int, start: np.ndarray) -> float:
    """A value that the spectrum hardly goes below: the smallest Ritz value of a short Lanczos run less its remainder."""
    basis = [start / np.linalg.norm(start)]
    alpha, beta = [], []
    for _ in range(min(steps, fit.dim)):
        w = fit.product(basis[-1][:, None])[:, 0]
        alpha.append(float(basis[-1] @ w))
        for _ in range(2):
            w = w - np.stack(basis).T @ (np.stack(basis) @ w)
        rest = float(np.linalg.norm(w))
        if rest <= 1e-12 * max(alpha):
            beta.append(0.0)
            break
        beta.append(rest)
        basis.append(w / rest)
    low = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))[0]
    return max(0.0, float(low) - beta[-1])


def chebyshev(apply, x0: np.ndarray, x1: np.ndarray, low: float, high: float, top: float, degree: int, apart) -> np.ndarray:
    """Columns ``x0`` under the Chebyshev polynomial of the interval [low, high], scaled to 1 at ``top``; ``x1`` is apply(x0).

    ``apart`` takes the certified columns out of every iterate. Out of what ``apply`` gives alone they would go on as columns of
    eigenvalue 0, which a spectrum far from 0 leaves far outside the interval, and rounding along them would grow most of all."""
    mid, half = (low + high) / 2, (high - low) / 2
    first = scale = half / (mid - top)
    before, now = x0, apart((x1 - mid * x0) * (first / half))
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, apart(2 * (following / half) * (apply(now) - mid * now) - scale * following * before)
        scale = following
    return now


@dataclass
class Components:
    values: np.ndarray    # eigenvalues, falling
    vectors: np.ndarray   # columns
    residuals: np.ndarray
    passes: int


def leading(fit: FitList, k: int, seed: int = SEED) -> Components:
    """The k leading eigenvectors of the covariance (fewer where it has fewer dimensions), each certified by its residual."""
    k, width = min(k, fit.dim), min(fit.dim, GUARD * k)
    rng = np.random.default_rng(seed)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return fit.product(q)

    q = np.linalg.qr(rng.standard_normal((fit.dim, width)))[0]
    vq = times(q)
    low = 0.0 if width == fit.dim else lanczos_floor(fit, LANCZOS, rng.standard_normal(fit.dim))
    best, still = math.inf, 0
    for _ in range(ROUNDS):
        # Rayleigh-Ritz
        h = q.T @ vq
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        residual = np.linalg.norm(vq - q * theta, axis=0)
        good = residual <= TOLERANCE * theta[0]
        done = int(np.argmin(good)) if not good.all() else width
        if done >= k or theta[0] <= 0:
            return Components(theta[:k], q[:, :k], residual[:k], passes)
        worst = residual[:k].max()
        best, still = (worst, 0) if worst < 0.5 * best else (best, still + 1)
        if still > 4 + ROUNDS // 10:
            if worst <= 100 * TOLERANCE * theta[0]:  # rounding of the sums allows no more
                return Components(theta[:k], q[:, :k], residual[:k], passes)
            break
        kept, open_ = q[:, :done], q[:, done:]
        apart = lambda m, kept=kept: m - kept @ (kept.T @ m)
        high = max(theta[-1], low + 1e-9 * theta[0])
        reach = (theta[done] - (low + high) / 2) / ((high - low) / 2)
        degree = int(np.clip(math.log(RAISE) / math.acosh(max(reach, 1 + 1e-9)), 2, DEGREE))
        y = chebyshev(times, open_, vq[:, done:], low, high, theta[done], degree, apart)
        for _ in range(2):
            y = np.linalg.qr(apart(y))[0]
        q = np.concatenate([kept, y], axis=1)
        vq = np.concatenate([vq[:, :done], times(y)], axis=1)
    raise RuntimeError(f"the subspace iteration stands at a residual of {best:.3g}")


def whiten(rows: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error, eigenvalue, residual) of every row that takes part."""
    rows = rows.select(F.col(id_col).cast("long").alias(id_col), vector_col)
    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, residual double"
    none = rows.sparkSession.createDataFrame([], schema)
    fit = fit_list(rows, vector_col)
    if fit is None:
        return none
    dim, n, total = fit.dim, fit.n, fit.total
    trace = float(fit.add_up(lambda x: (x * x).sum(axis=0), dim).sum()) / n
    found = leading(fit, k) if trace > 0 else None
    some = int((found.values > RANK_FLOOR * found.values[0]).sum()) if found else 0
    if not some:
        drop_tables(fit.blocks)
        return none
    values, vectors, residuals = found.values[:some], found.vectors[:, :some], found.residuals[:some]
    onto = vectors / np.sqrt(values)
    mean = fit.add_up(lambda x: (x @ onto).sum(axis=0), some) / n
    square = fit.add_up(lambda x: ((x @ onto - mean).T @ (x @ onto - mean)).ravel(), some * some).reshape(some, some) / n
    error = float(np.abs(square - np.eye(some)).max())
    drop_tables(fit.blocks)
    explained = values / trace

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * float(np.abs(x).max(initial=0)) + max(abs(float(s)) for s in total)
        if most < 2**62 and most * most * dim < 2**63:
            d = n * x - total.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        far = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, total)) for row in x]
        return [d if d < 1 << 63 else None for d in far]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, x = whole_numbers(batch.column(1), dim)
            y = centred(x, n, total) @ onto
            each = np.repeat(np.arange(len(at)), some)
            all_of = lambda v: pa.array(np.tile(v, len(at)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), n)),
                 pa.array(deviations(x), pa.int64()).take(pa.array(each)), pa.array(y.ravel()), all_of(explained), pa.array(np.full(len(each), error)), all_of(values), all_of(residuals)],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue", "residual"])

    return rows.mapInArrow(run, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    return whiten(common.read(spark, sf_dir, "embeddings")).drop("eigenvalue", "residual")
