"""Symmetric positive definite matrices per group: covariance, logarithm, exponential."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covariance(rows: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Ridged sample covariance, symmetric to the last bit."""
    c = np.atleast_2d(np.cov(rows, rowvar=False, ddof=1))
    return (c + c.T) / 2 + ridge * np.eye(len(c))


def log_spd(m: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Matrix logarithm with eigenvalues held above ``floor``."""
    w, v = np.linalg.eigh(m)
    return (v * np.log(np.maximum(w, floor))) @ v.T


def exp_sym(m: np.ndarray) -> np.ndarray:
    """Matrix exponential of a symmetric matrix."""
    w, v = np.linalg.eigh(m)
    return (v * np.exp(w)) @ v.T


def vectorise(m: np.ndarray) -> np.ndarray:
    """Upper triangle by rows, off-diagonal entries times sqrt 2."""
    i, j = np.triu_indices(len(m))
    return np.where(i == j, 1.0, np.sqrt(2.0)) * m[i, j]


def scaled_logs(covariances: np.ndarray, spreads: np.ndarray, ridge: float) -> np.ndarray:
    """Log vectors of many matrices, given as upper triangles by rows, after their channels are divided by ``spreads`` (a row each)."""
    n = spreads.shape[1]
    i, j = np.triu_indices(n)
    m = np.empty((len(covariances), n, n))
    m[:, i, j] = m[:, j, i] = covariances / (spreads[:, i] * spreads[:, j])
    w, v = np.linalg.eigh(m + ridge * np.eye(n))
    logs = (v * np.log(np.maximum(w, 1e-10))[:, None, :]) @ v.transpose(0, 2, 1)
    return np.where(i == j, 1.0, np.sqrt(2.0)) * logs[:, i, j]


def merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and squared deviations of several groups of rows together."""
    n, mean, squares = parts[0]
    for m, other, more in parts[1:]:
        way = other - mean
        squares = squares + more + np.outer(way, way) * (n * m / (n + m))
        mean, n = mean + way * (m / (n + m)), n + m
    return n, mean, squares


def covariances(table: DataFrame, ridge: float, result, schema: str) -> DataFrame:
    """``result`` (key, n, covariance or None) as a row of ``schema`` for each key of (key, v).

    Each task hands on one row a key: count, mean and squared deviations; so no task ever
    holds a key's rows, however many.
    """
    def partial(batches):
        held: dict = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            v = np.array(batch.column(1).to_pylist(), float)
            for key in np.unique(keys):
                x = v[keys == key]
                mean = x.mean(axis=0)
                part = (len(x), mean, (x - mean).T @ (x - mean))
                held[int(key)] = merged([held[int(key)], part]) if int(key) in held else part
        rows = [(k, n, mean.tolist(), squares.ravel().tolist()) for k, (n, mean, squares) in held.items()]
        if rows:
            k, n, mean, squares = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(mean, pa.list_(pa.float64())), pa.array(squares, pa.list_(pa.float64()))], names=["key", "n", "mean", "squares"])

    def whole(group: pa.Table) -> pa.Table:
        parts = [(n, np.array(m), np.array(q).reshape(len(m), -1)) for n, m, q in zip(*(group[c].to_pylist() for c in ("n", "mean", "squares")), strict=True)]
        n, _, squares = merged(parts)
        c = squares / (n - 1) if n > 1 else None
        return result(group["key"][0].as_py(), n, None if c is None else (c + c.T) / 2 + ridge * np.eye(len(c)))

    parts = table.select(F.col("key").cast("int").alias("key"), "v").mapInArrow(partial, "key int, n long, mean array<double>, squares array<double>")
    return parts.groupBy("key").applyInArrow(whole, schema)


def covariance_logs(table: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """(key, n, log_vector) of rows (key, v); fewer than two rows give a null vector."""
    def row(key, n, c) -> pa.Table:
        out = None if c is None else vectorise(log_spd(c)).tolist()
        return pa.table({"key": pa.array([key], pa.int32()), "n": pa.array([n], pa.int64()), "log_vector": pa.array([out], pa.list_(pa.float64()))})

    return covariances(table, ridge, row, "key int, n long, log_vector array<double>")


def unvectorise(v: np.ndarray) -> np.ndarray:
    """The symmetric matrix whose ``vectorise`` is v; its length must be triangular."""
    n = int((np.sqrt(8 * len(v) + 1) - 1) / 2)
    if n * (n + 1) // 2 != len(v):
        raise ValueError(f"{len(v)} entries are no upper triangle")
    i, j = np.triu_indices(n)
    m = np.zeros((n, n))
    m[i, j] = m[j, i] = np.where(i == j, 1.0, np.sqrt(0.5)) * v
    return m


def condition_number(m: np.ndarray) -> float:
    """Largest over smallest eigenvalue; infinite unless the smallest is positive."""
    w = np.linalg.eigvalsh(m)
    return float(w[-1] / w[0]) if w[0] > 0 else float("inf")


def nearest_spd(m: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Nearest symmetric matrix whose eigenvalues are ``floor`` or more."""
    w, v = np.linalg.eigh((m + m.T) / 2)
    return (v * np.maximum(w, floor)) @ v.T


def matrix_checks(table: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """(key, n, reason, least, condition) of rows (key, v): why a key's covariance is not positive definite, its least eigenvalue and condition number."""
    from strideline.operators.clusters import spd_reason

    def row(key, n, c) -> pa.Table:
        m = np.full((1, 1), np.nan) if c is None else c
        reason = spd_reason(m)
        least, cond = (float(np.linalg.eigvalsh(m)[0]), condition_number(m)) if reason != "non_finite" else (None, None)
        return pa.table({"key": pa.array([key], pa.int32()), "n": pa.array([n], pa.int64()), "reason": pa.array([reason]), "least": pa.array([least], pa.float64()), "condition": pa.array([cond], pa.float64())})

    return covariances(table, ridge, row, "key int, n long, reason string, least double, condition double")


def fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a b + c rounded once (Dekker's exact product); rounded twice where a part of it overflows."""
    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    with np.errstate(all="ignore"):
        (a1, a2), (b1, b2), p = halves(a), halves(b), a * b
        rest = ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2
        s = p + c
        found = s + (((p - (s - (s - p))) + (c - (s - p))) + rest)
    return np.where(np.isfinite(found), found, s)


def moments_2x2(x: np.ndarray, k: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sample variance of x, covariance and variance of k of the runs of x and k that start at ``begin``, a row each; NaN for runs of one.

    A run's moments are updated value by value, all runs of a table together, and its last value is added to
    those of the rest.  Every run has its own order, so the last bit depends on the run alone.
    """
    out = np.zeros((len(size), 3))
    mean = np.zeros((len(size), 2))
    order = np.argsort(-size, kind="stable")
    long = np.sort(size)
    with np.errstate(all="ignore"):
        for n in range(1, int(size.max(initial=1))):
            on = order[: len(size) - np.searchsorted(long, n, side="right")]
            at = begin[on] + n - 1
            dx, dk = x[at] - mean[on, 0], k[at] - mean[on, 1]
            mean[on, 0] += dx / n
            mean[on, 1] += dk / n
            ex, ek = x[at] - mean[on, 0], k[at] - mean[on, 1]
            out[on] = np.stack([out[on, 0] + ex * dx, fused(dk, ex, out[on, 1]), out[on, 2] + ek * dk], axis=1)
        n, at = size - 1.0, begin + size - 1
        dx, dk = x[at] - mean[:, 0], k[at] - mean[:, 1]
        out += np.stack([dx * dx * n / size, dk * dx * n / size, dk * dk * n / size], axis=1)
        return out / np.where(n > 0, n, np.nan)[:, None]


def c_log(values: np.ndarray) -> np.ndarray:
    """Logarithms of positive numbers by the C library; numpy's own has another last bit now and then where the machine has wide vectors."""
    return np.fromiter(map(math.log, values.tolist()), np.float64, len(values))


def c_squares(values: np.ndarray) -> np.ndarray:
    """Squares by the C library's power, as in the SQL; the last bit is that of a product but for one in some thousand."""
    with np.errstate(over="ignore"):
        return np.float_power(values, np.full(len(values), 2.0))


def log_vectors_2x2(a: np.ndarray, b: np.ndarray, c: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """``columns.vectorise_2x2`` of ``columns.matrix_log_2x2``, a row each, with the C library's logarithm."""
    with np.errstate(all="ignore"):
        mid, half = (a + c) / 2, np.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)
        high, low = c_log(np.maximum(mid + half, floor)), c_log(np.maximum(mid - half, floor))
        mean, slope = (high + low) / 2, np.where(half > 0, (high - low) / (2 * half), 0.0)
        return np.stack([mean + slope * (a - c) / 2, slope * b * np.sqrt(2), mean - slope * (a - c) / 2], axis=1)
