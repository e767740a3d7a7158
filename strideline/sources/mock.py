"""Seeded synthetic walking sessions, made on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def mock_sessions(spark: SparkSession, sessions: int, seconds: float = 60.0, rate: float = 100.0, period: float = 1.2, drift_after: float | None = None) -> DataFrame:
    """(session, seq, t, x, gyro): a noisy cosine belt and a gyro with a spike per cycle; with ``drift_after`` the cycle grows smoothly by half."""
    def make(batches):
        for batch in batches:
            for session in batch.column(0).to_pylist():
                rng = np.random.default_rng(session)
                n = int(seconds * rate)
                t = np.arange(n) / rate
                blend = np.zeros(n)
                if drift_after is not None:
                    u = np.clip((t - drift_after) / 10, 0, 1)
                    blend = u * u * (3 - 2 * u)
                phase = np.cumsum(2 * np.pi / (period * (1 + 0.5 * blend)) / rate)
                x = -130 - 60 * np.cos(phase) + rng.normal(0, 0.5, n)
                gyro = 60 * np.exp(-(((phase % (2 * np.pi)) - np.pi) ** 2) / 0.05) + rng.normal(0, 1, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, session)), pa.array(np.arange(n)), pa.array(t), pa.array(x), pa.array(gyro)], names=["session", "seq", "t", "x", "gyro"])
    return spark.range(sessions).mapInArrow(make, "session long, seq long, t double, x double, gyro double")


def mock_walks(spark: SparkSession, sessions: int, seconds: float = 14.0, rate: float = 100.0, step: float = 0.6) -> DataFrame:
    """(session, seq, t, gx, gy, gz, ax, ay, az, x): two feet that strike in turn, the left one with a short belt; each session's unit is mounted at another angle."""
    names = ["session", "seq", "t", "gx", "gy", "gz", "ax", "ay", "az", "x"]

    def make(batches):
        for batch in batches:
            for session in batch.column(0).to_pylist():
                n = int(seconds * rate)
                t = np.arange(n) / rate
                at = np.arange(step + 0.1, seconds, step)
                left = np.arange(len(at)) % 2 == 0
                bump = lambda width: np.exp(-(((t[:, None] - at) / width) ** 2))
                turn = bump(0.07) @ np.where(left, 5.0, -5.0)
                gyro = np.stack([turn, 0.2 * np.sin(2 * t), np.zeros(n)], axis=1)
                accel = np.stack([np.zeros(n), np.zeros(n), 1 + 0.55 * bump(0.025).sum(1)], axis=1)
                turned = np.linalg.qr(np.random.default_rng(session).normal(size=(3, 3)))[0]
                belt = -110 + bump(0.09) @ np.where(left, -70.0, 10.0)
                columns = [np.full(n, session), np.arange(n), t, *(gyro @ turned.T).T, *(accel @ turned.T).T, belt]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)
    return spark.range(sessions).mapInArrow(make, "session long, seq long, t double, " + ", ".join(f"{c} double" for c in names[3:]))
