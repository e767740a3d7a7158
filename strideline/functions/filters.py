"""Zero-phase low-pass filtering of whole sessions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def low_pass(x: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    """Second-order Butterworth filter run forth and back, so nothing is shifted; x as it is where it is too short or the cut-off not below half the rate.

    The ends are continued by their mirror image through the end point, and each run starts
    from the filter's rest state at its first value.
    """
    x = np.asarray(x, float)
    pad = 9
    if len(x) < pad or not 0.0 < cutoff < rate / 2:
        return x
    pad = min(pad, len(x) - 1)
    warped = math.tan(math.pi * cutoff / rate)
    scale = 1 + math.sqrt(2) * warped + warped * warped
    gain, near, far = warped * warped / scale, 2 * (warped * warped - 1) / scale, (1 - math.sqrt(2) * warped + warped * warped) / scale

    def run(values: np.ndarray) -> np.ndarray:
        y1 = y2 = x1 = x2 = float(values[0])
        out = []
        for v in values.tolist():
            y = gain * (v + 2 * x1 + x2) - near * y1 - far * y2
            out.append(y)
            x1, x2, y1, y2 = v, x1, y, y1
        return np.array(out)

    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return run(run(long)[::-1])[::-1][pad : pad + len(x)]


def low_passed(samples: DataFrame, cutoff: float, rate: float) -> DataFrame:
    """(session, seq, smooth) of samples (session, seq, t, x); a session is one task's work."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("t", "ascending"), ("seq", "ascending")])
        return pa.table({"session": group["session"], "seq": group["seq"], "smooth": pa.array(low_pass(group["x"].to_numpy(), cutoff, rate))})

    return samples.select("session", "seq", "t", "x").groupBy("session").applyInArrow(run, "session long, seq long, smooth double")
