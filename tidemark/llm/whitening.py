"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, so that equal vectors, counts and sums are exact. The
leading eigenvectors of the covariance V are found without forming V: a block of
columns Q is multiplied by V in a pass over the rows, each task giving the sum of
(x - mean)((x - mean)' Q) over its own. A Chebyshev polynomial of V, evaluated by its
three-term recurrence, one pass a step, damps the unwanted part of the spectrum;
then QR and Rayleigh-Ritz. A short Lanczos run gives the lower end of the
spectrum, the block's smallest Ritz value the upper end of what is damped. It
ends when residuals are below ``RESIDUAL`` and so again after a round with guard
columns drawn anew, so that no larger eigenvalue was missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shield
from tidemark.llm.vectors import complete, matrix, of_common_length
from tidemark.session import persist_table, ship_package

SCALE = 256
COMPONENTS, GUARD = 4, 20
DEGREE, LANCZOS_STEPS, MAX_ROUNDS = 12, 6, 100
# The largest eigenvalue must not grow so much more in a filter than the last wanted one that rounding hides the latter.
LEAD = np.log(1e7)
# Residuals are certified against the largest eigenvalue; smaller eigenvalues than NOTHING times it count as zero.
RESIDUAL, NOTHING = 1e-12, 1e-12
_LOW = (1 << 32) - 1
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """What is known of the distinct vectors: count, exact sums, eigenpairs, trace of V, and the check of the result."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x``, floor(scale * entry), of the rows with a complete vector of the commonest length.

    Entries beyond the range of a long stay at its ends.
    """
    plain = shield(df, (vec_id, vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    whole = F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return of_common_length(plain.filter(complete("v")).select("vec_id", whole.alias("x")), "x")


def summed(rows: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray], size: int, kind: type = np.float64) -> np.ndarray:
    """Sum of ``of_batch(x)``, ``size`` numbers, over the batches of ``rows``: per task first, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(matrix(batch.column("x"), np.int64)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    sql = "double" if kind is np.float64 else "bigint"
    parts = rows.select("x").mapInArrow(run, f"i bigint, v {sql}").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)") if sql == "bigint" else F.col("v")).alias("v"))
    found = {r.i: r.v for r in parts.collect()}
    return np.array([found.get(i, 0) for i in range(size)], object if sql == "bigint" else np.float64)


def _totals(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Exact count and sums; halves of the numbers are summed apart, so that no long overflows."""
    def both(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & _LOW).sum(axis=0)])

    found = [int(v) for v in summed(rows, both, 1 + 2 * d, np.int64)]
    return found[0], [(found[1 + i] << 32) + found[1 + d + i] for i in range(d)]


def covariance_times(rows: DataFrame, n: int, mean: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Q -> V Q, each a pass over ``rows``."""

    def apply(q: np.ndarray) -> np.ndarray:
        def of_batch(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return summed(rows, of_batch, q.size).reshape(q.shape) / n

    return apply


def lower_end(times: Callable[[np.ndarray], np.ndarray], d: int, steps: int, rng: np.random.Generator) -> float:
    """A number no eigenvalue lies below by much: smallest Ritz value of a Lanczos run less its last coupling."""
    basis = np.zeros((d, 0))
    v = rng.standard_normal((d, 1))
    v /= np.linalg.norm(v)
    diagonal, beside = [], []
    for _ in range(steps):
        basis = np.hstack([basis, v])
        w = times(v)
        diagonal.append(float((v * w).sum()))
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-10 * max(map(abs, diagonal)):
            break
        v = w / beside[-1]
    t = np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beside[-1])


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of V applied to ``q``: small on [low, high], scaled to one near ``top``."""
    middle, half = (low + high) / 2, (high - low) / 2
    sigma = first = half / (top - middle)
    before, now = q, (times(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - middle * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, components: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``components`` largest eigenvalues and unit eigenvectors."""
    rng = np.random.default_rng(seed)
    width = min(d, components + GUARD)
    low = lower_end(times, d, LANCZOS_STEPS, rng) if width < d else 0.0
    block, renewed = rng.standard_normal((d, width)), False
    for turn in range(MAX_ROUNDS):
        q, _ = np.linalg.qr(block)
        image = times(q)
        inner = q.T @ image
        values, turned = np.linalg.eigh((inner + inner.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        q, image = q @ turned, image @ turned
        top = max(float(values[0]), 0.0)
        misses = np.linalg.norm(image - q * values, axis=0)[:components].max()
        if width == d or top == 0.0:
            return values[:components], q[:, :components]
        if misses <= RESIDUAL * top:
            if renewed:
                return values[:components], q[:, :components]
            q[:, components:], renewed = rng.standard_normal((d, width - components)), True
            q, _ = np.linalg.qr(q)
        high = float(values[-1])
        if high - low <= 1e-6 * top:
            block = image
            continue
        grown = np.arccosh(np.maximum((values[[0, components - 1]] - (low + high) / 2) / ((high - low) / 2), 1.0))
        degree = int(np.clip(LEAD / max(grown[0] - grown[1], 1e-9), 2, DEGREE))
        block = filtered(times, q, low, high, top, degree)
    raise ArithmeticError(f"residual {misses / top:.1e} of the largest eigenvalue after {turn + 1} rounds")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Eigenpairs of the covariance of the distinct ``x`` of ``rows``; None without rows."""
    distinct = persist_table(rows.select("x").distinct(), "distinct-vectors")
    head = distinct.first()
    if head is None:
        return None
    d = len(head.x)
    n, sums = _totals(distinct, d)
    mean = np.array([s / n for s in sums])
    values, axes = leading(covariance_times(distinct, n, mean), d, min(components, d))
    held = values > NOTHING * max(float(values[0]), 0.0)
    scale = np.where(held, 1 / np.sqrt(np.where(held, values, 1.0)), 0.0)

    def check(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        white = centred @ (axes * scale)
        return np.concatenate([[(centred * centred).sum()], white.sum(axis=0), (white.T @ white).reshape(-1)])

    k = len(values)
    found = summed(distinct, check, 1 + k + k * k) / n
    off = found[1 + k :].reshape(k, k) - np.outer(found[1 : 1 + k], found[1 : 1 + k]) - np.eye(k)
    error = float(np.abs(off[np.ix_(held, held)]).max()) if held.any() else None
    return Fit(n, sums, np.where(held, values, 0.0), axes, float(found[0]), error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2; None beyond a long."""
    reach = n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(abs(s) for s in sums)
    if x.shape[1] * reach * reach < 1 << 63:
        away = x * np.int64(n) - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = x.astype(object) * n - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1)]


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable row, a row per component.

    Rows whose vector is null, empty, not of the commonest length or holds a null, NaN or
    infinite entry take no part. ``n``, ``explained`` and ``identity_error`` belong
    to the distinct vectors, so repeated rows count once in the fit and each get
    their result; a null id stays null. A component without variance (few or
    equal vectors) has a null ``whitened`` and takes no part in ``identity_error``,
    which is null if there is no other; ``explained`` is null where nothing
    varies. ``deviation`` is null beyond a long. Fewer dimensions than
    ``components`` give fewer rows. Extra columns are not looked at; no rows give
    no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = whole_numbers(df, vec_id, vector)
    known = fit(rows, components)
    if known is None:
        return spark.createDataFrame([], RESULT)
    n, sums, mean, k = known.n, known.sums, known.mean, len(known.values)
    scale = [1 / np.sqrt(v) if v > 0 else None for v in known.values]
    explained = [float(v / known.trace) if known.trace > 0 else None for v in known.values]
    axes, error = known.axes, known.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = matrix(batch.column("x"), np.int64), batch.num_rows
            along = (x - mean) @ axes
            away = pa.array(_deviations(x, n, sums), pa.int64())
            for j in range(k):
                white = pa.nulls(m, pa.float64()) if scale[j] is None else pa.array(along[:, j] * scale[j])
                same = [pa.array([v] * m, t) for v, t in ((j + 1, pa.int32()), (n, pa.int64()), (explained[j], pa.float64()), (error, pa.float64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), same[0], same[1], away, white, same[2], same[3]],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, RESULT)
