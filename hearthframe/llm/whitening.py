"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become whole numbers x, so sums and squared deviations are exact. The covariance V is never formed: a block
Q of a few more columns than components asked for is multiplied by distributed passes over the centred rows, V Q =
X'(X Q) / n. A Chebyshev recurrence of such passes damps the spectrum below the block's smallest Ritz value, QR makes
the block orthonormal again and Rayleigh-Ritz gives the next values, until the residual of every wanted pair
certifies it. Driver and tasks hold matrices of dimension x block, never rows; a pass shuffles one such matrix a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

SHIFT = 1_000_000
SCALE = 64
#: Residuals of certified pairs, as a share of the largest eigenvalue.
CERTAIN = 1e-13
#: Accepted where rounding keeps a pass from reaching CERTAIN.
ACCEPTED = 1e-11
#: How much more a filter may raise the first direction than the block's last, without rounding the others away.
SPREAD = 1e6


@dataclass
class Whitening:
    """n vectors with sums S, unit components as columns, their eigenvalues, trace(V), and the distributed passes made."""
    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x): rows whose vector is neither null nor empty nor holds a null or non-finite entry; x = floor(64 c) + 1000000."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return rows.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).select("vec_id", x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def summed(x: DataFrame, part: Callable[[np.ndarray], np.ndarray], columns: int) -> np.ndarray:
    """Sum over all rows of `part` of their matrices: each task adds up its own, their entries add up by place."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(matrix(batch.column(0)))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["row", "v"])

    parts = x.select("x").mapInArrow(add, "row int, v array<double>").select("row", F.posexplode("v").alias("place", "v"))
    got = parts.groupBy("row", "place").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((got["row"].max() + 1 if len(got) else 0, columns))
    out[got["row"], got["place"]] = got["v"]
    return out


def exact_sums(x: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and per-dimension sums as whole numbers: tasks add in long, the rest in decimals."""
    def add(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(0))
                n += len(m)
                total = m.sum(axis=0) if total is None else total + m.sum(axis=0)
        if total is not None:
            rows = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), pa.array(np.full(rows, n)), pa.array(total)], ["row", "n", "s"])

    got = x.select("x").mapInArrow(add, "row int, n long, s long").groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not got:
        return 0, np.zeros(0, object)
    if len({r["n"] for r in got}) > 1:
        raise ValueError("the vectors differ in length, so they have no common covariance")
    sums = np.empty(len(got), object)
    for r in got:
        sums[r["row"]] = int(r["s"])
    return int(got[0]["n"]), sums


def centred(m: np.ndarray, n: int, quotient: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n, from the whole numbers n x - S = n (x - S // n) - S % n."""
    return (m - quotient) - rest / n


def filtered(q: np.ndarray, vq: np.ndarray, times: Callable[[np.ndarray], np.ndarray], degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The block under the Chebyshev polynomial that stays within 1 on [low, high], scaled to be about 1 at `top`. `vq` is V q."""
    half, mid = (high - low) / 2, (high + low) / 2
    sigma = half / (top - mid)
    tau, last = 2 / sigma, q
    now = (vq - mid * q) * (sigma / half)
    for _ in range(degree - 1):
        step = 1 / (tau - sigma)
        now, last = (times(now) - mid * now) * (2 * step / half) - sigma * step * last, now
        sigma = step
    return now


def fit(x: DataFrame, k: int = 32, guard: int = 16, most_degree: int = 24, most_rounds: int = 200, seed: int = 7) -> Whitening:
    """The k largest components of the vectors of `x`, or as many as have a positive eigenvalue.

    Equal eigenvalues give some orthonormal basis of their space. Raises ArithmeticError if the residuals do not get small.
    """
    n, sums = exact_sums(x)
    d = len(sums)
    quotient, rest = np.array([s // max(n, 1) for s in sums], np.int64), np.array([s % max(n, 1) for s in sums], float)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(m):
            c = centred(m, n, quotient, rest)
            return c.T @ (c @ q)
        return summed(x, part, q.shape[1]) / n

    if n == 0:
        return Whitening(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    trace = float(summed(x, lambda m: (centred(m, n, quotient, rest) ** 2).sum(axis=0)[:, None], 1).sum()) / n
    if trace == 0:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    block = min(d, k + guard)
    k = min(k, d)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    best, stuck = np.inf, 0
    for _ in range(most_rounds):
        vq = times(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        size = np.linalg.norm(vq - q * values, axis=0) / values[0]
        worst = float(size[:k].max())
        stuck = stuck + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if worst <= CERTAIN or worst <= ACCEPTED and stuck >= 2:
            kept = int((values[:k] > 1e-12 * values[0]).sum())
            return Whitening(n, sums, q[:, :kept], values[:kept], trace, passes)
        if block == d:
            q = np.linalg.qr(q)[0]
            continue
        low, high = 0.0, max(float(values[-1]), 1e-9 * values[0])
        reach = np.arccosh((2 * values[0] - high - low) / (high - low)) if values[0] > high * (1 + 1e-9) else 1e-3
        # The nearer the block is to invariant, the less of the first direction is left in the other columns to be raised.
        spread = np.log(SPREAD / max(float(size.max()), 1e-8))
        degree = int(np.clip(spread / max(reach, 1e-3), 2, most_degree))
        q = np.linalg.qr(filtered(q, vq, times, degree, low, high, float(values[0])))[0]
    raise ArithmeticError(f"residuals stay at {best:.2g} of the largest eigenvalue after {passes} passes")


def whiten(rows: DataFrame, k: int = 32, **fitting) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each remaining row and component.

    Rows without a usable vector are left out; repeated rows and ids are vectors each, a null vec_id stays null, and
    other columns are not read. Vectors of different lengths raise ValueError. Components without variance are left out,
    so one vector, or equal ones, give no rows. `deviation` is exact; it is null beyond the range of long.
    """
    x = materialise(whole_vectors(rows), "whole-vectors")
    model = fit(x, k, **fitting)
    n, found = model.n, len(model.values)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not found:
        return rows.sparkSession.createDataFrame([], schema)
    quotient, rest = np.array([s // n for s in model.sums], np.int64), np.array([s % n for s in model.sums], np.int64)
    onto, explained = model.components / np.sqrt(model.values), model.values / model.trace

    def project(m):
        return centred(m, n, quotient, rest.astype(float)) @ onto

    def squares(m):
        w = project(m)
        return np.vstack([w.T @ w, w.sum(axis=0)])
    both = summed(x, squares, found) / n
    error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(found)).max())

    def deviations(m):
        gap = m - quotient
        # The largest possible sum decides whether long is wide enough.
        bound = (int(np.abs(gap).max(initial=0)) + 1) * n
        if bound * bound * m.shape[1] < 2 ** 63:
            whole = gap * n - rest
            return pa.array((whole * whole).sum(axis=1))
        whole = gap.astype(object) * n - rest.astype(object)
        return pa.array([s if s < 2 ** 63 else None for s in map(int, (whole * whole).sum(axis=1))], pa.int64())

    def give(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                m = matrix(part.column(1))
                size = len(m) * found
                each = pa.array(np.repeat(np.arange(len(m)), found))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(m))), pa.array(np.full(size, n)),
                    deviations(m).take(each), pa.array(project(m).ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(size, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return x.select(F.col("vec_id").cast("long"), "x").mapInArrow(give, schema)
