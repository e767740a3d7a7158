"""The loop of a session, one sample at a time, so that a stream can go on where its last batch ended.

``StrideCloser`` closes strides; ``LiveLoop`` chains a detector, the closer, the session's
baseline model, its scores and the gain policy, and follows the session's state.  Both are
machines: in batch they give the rows of the batch operators.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.functions.matrices import log_spd, vectorise
from strideline.operators.clusters import kmeans, select_k
from strideline.operators.folds import SESSION_STATES, Machine
from strideline.operators.models import LEAST_SPREAD, RIDGE, TARGET_MODES
from strideline.operators.policy import AssistPolicy
from strideline.operators.segments import reject_reason
from strideline.sources.sinks import Config

#: Weights of the terms of the deficit, and the swing deficit that counts as 1.
SWING_WEIGHT, EXCURSION_WEIGHT, SWING_SCALE = 0.5, 0.5, 0.1


class StrideCloser(Machine):
    """The stride that a strike closes, on the strike's row; what ``segments.cut`` and ``segments.metrics`` give for it.

    A value that is not finite is counted and else left out (streams cannot tell NaN from null).
    A sample that comes before one already seen is ``late``: it changes nothing and is marked.
    Time and memory are constant in a stride's length.
    """

    inputs = ("x", "k", "strike", "swing", "seq")
    schema = (
        "late int, stride_id int, n_samples int, n_swing int, n_stance int, n_not_finite int, t_start double, t_end double, swing_time double, stance_time double, "
        "excursion double, mean_x double, rms_x double, peak_k double"
    )
    width = 14

    def start(self) -> dict:
        return {"next": 0, "t": None, "seq": None, "open": None, "closed": None}

    def step(self, s: dict, t: float, x: float | None, k: float | None, strike: bool, swing: bool, seq: int) -> tuple:
        if s["t"] is not None and (t, seq) <= (s["t"], s["seq"]):
            return (1, *[None] * (self.width - 1))
        s["t"], s["seq"] = t, seq
        x, k = (None if v is None else float(v) for v in (x, k))
        out = (0, *[None] * (self.width - 1))
        s["closed"] = None
        if s["open"] is not None:
            self._add(s["open"], t, x, k, bool(swing))
            if strike:
                out = (0, s["next"], *self._result(s["open"]))
                s["next"] += 1
                s["closed"] = s["open"]
        if strike:
            s["open"] = {"n": 0, "swings": 0, "bad": 0, "first": t, "last": t, "swing": False, "in_swing": 0.0, "in_stance": 0.0, "seen": 0, "low": None, "high": None, "mean": 0.0, "m2": 0.0, "k": None, "k_seen": 0, "k_mean": 0.0, "k_m2": 0.0, "pairs": 0, "pair_x": 0.0, "pair_k": 0.0, "pair_m2": 0.0}
            self._add(s["open"], t, x, k, bool(swing))
        return out

    @staticmethod
    def _add(o: dict, t: float, x: float | None, k: float | None, swing: bool) -> None:
        if o["n"]:
            o["in_swing" if o["swing"] else "in_stance"] += t - o["last"]
        o["n"] += 1
        o["swings"] += swing
        o["last"], o["swing"] = t, swing
        if x is None or not math.isfinite(x):
            o["bad"] += 1
        else:
            o["seen"] += 1
            o["low"] = x if o["low"] is None else min(x, o["low"])
            o["high"] = x if o["high"] is None else max(x, o["high"])
            step = x - o["mean"]
            o["mean"] += step / o["seen"]
            o["m2"] += step * (x - o["mean"])
        if k is not None and math.isfinite(k):
            o["k"] = abs(k) if o["k"] is None or abs(k) > o["k"] else o["k"]
            o["k_seen"] += 1
            step = k - o["k_mean"]
            o["k_mean"] += step / o["k_seen"]
            o["k_m2"] += step * (k - o["k_mean"])
            if x is not None and math.isfinite(x):
                o["pairs"] += 1
                step = x - o["pair_x"]
                o["pair_x"] += step / o["pairs"]
                o["pair_k"] += (k - o["pair_k"]) / o["pairs"]
                o["pair_m2"] += step * (k - o["pair_k"])

    @staticmethod
    def _result(o: dict) -> tuple:
        some = o["seen"] > 0
        return (
            o["n"], o["swings"], o["n"] - o["swings"], o["bad"], o["first"], o["last"], o["in_swing"], o["in_stance"], o["high"] - o["low"] if some else None,
            o["mean"] if some else None, math.sqrt(o["m2"] / o["seen"]) if some else None, o["k"],
        )


def baseline_model(x: np.ndarray) -> dict:
    """Centre, state centres and spreads of a baseline's log vectors."""
    k, _ = select_k(x)
    centres = kmeans(x, k)[1] if k > 1 else x.mean(axis=0)[None, :]
    near = np.linalg.norm(x[:, None] - centres[None], axis=2).min(axis=1)
    own = np.linalg.norm(x - x.mean(axis=0), axis=1)
    return {"centre": x.mean(axis=0).tolist(), "centres": centres.tolist(), "near_mean": float(near.mean()), "near_sd": float(near.std()), "scale": float(own.mean() + 2 * own.std())}


def _shortfall(value: float, lower: float, upper: float, scale: float) -> float | None:
    """How far a value is below an interval, in spans, 0 to 1; None where it was not measured."""
    if value is None or not math.isfinite(value):
        return None
    miss, span = max(lower - value, 0.0), scale if scale > 0 else (upper - lower) / 2
    return 0.0 if miss <= 0 else min(miss / span, 1.0) if span > 0 else 1.0


class LiveLoop(Machine):
    """Detector, strides, baseline model, scores, gain and state of a session, each sample in turn.

    The first valid strides give the session's frozen scaling, its states and intervals, as
    in ``batch.replay``; each valid stride after them is scored and moves the gain.  With a
    ``detector`` (a machine that gives events) strikes and swing are its; without one they
    are inputs.  ``healthy`` is a reference's log vector, ``target`` what distances are measured from.
    The session's state goes its allowed ways: calibration from the first sample, the baseline
    from the first strike, the model when it is full, then ready, walking or outlying.
    Kept of a session: an open stride, sums of the baseline's strides, the model.
    """

    schema = (
        "late int, stride_id int, t_end double, reject_reason string, nth int, state int, d_state double, d double, bound double, scale double, ood int, "
        "e_swing double, e_exc double, e_b double, e_r double, raw double, gain double, engaged int, updated int, session_state string"
    )

    def __init__(self, config: Config | None = None, detector: Machine | None = None, validity: tuple = (3, 0.5, 150.0), healthy: list[float] | None = None, target: str = "interpolated_target", alpha: float = 0.3):
        if target not in TARGET_MODES:
            raise ValueError(f"unknown target {target!r}; known: {', '.join(TARGET_MODES)}")
        self.config, self.detector, self.validity = config or Config(), detector, validity
        self.healthy, self.target, self.alpha = healthy, target, alpha
        self.closer, self.policy = StrideCloser(), AssistPolicy(self.config)
        self.inputs = ("x", "k", "seq") if detector else StrideCloser.inputs
        self.width = self.schema.count(",") + 1

    def start(self) -> dict:
        return {"detector": self.detector.start() if self.detector else None, "swings": False, "closer": self.closer.start(), "policy": self.policy.start(), "nth": 0, "baseline": [], "model": None, "session": "INIT", "gain": 0.0}

    def step(self, s: dict, t: float, x: float | None, k: float | None, *more) -> tuple:
        if self.detector:
            event = self.detector.step(s["detector"], t, x)[0]
            strike, s["swings"] = event == "heel_strike", event == "toe_off" if event in ("heel_strike", "toe_off") else s["swings"]
            values = (x, k, strike, s["swings"], *more)
        else:
            values = (x, k, *more)
        found = self.closer.step(s["closer"], t, *values)
        if found[0]:
            return (1, *[None] * (self.width - 2), s["session"])
        self._go(s, "CALIBRATION", "INIT")
        if s["closer"]["open"] is not None:
            self._go(s, "BASELINE_COLLECTION", "CALIBRATION")
        if s["closer"]["closed"] is None:
            return (0, *[None] * (self.width - 2), s["session"])
        return self._closed(s, found)

    def timed_out(self, s: dict) -> tuple:
        """The row of a session that has sent nothing for too long: no gain until it is back."""
        s["session"] = "SAFE_STOP"
        return (0, *[None] * (self.width - 5), 0.0, None, None, s["session"])

    @staticmethod
    def _go(s: dict, to: str, *when: str) -> None:
        if s["session"] == "SAFE_STOP":  # back again: as far as the session had come
            s["session"] = "READY" if s["model"] else "INIT"
        if s["session"] in when and to in SESSION_STATES[s["session"]]:
            s["session"] = to

    def _closed(self, s: dict, found: tuple) -> tuple:
        o, number, t_end = s["closer"]["closed"], found[1], found[7]
        stride_time, both = o["last"] - o["first"], o["in_swing"] + o["in_stance"]
        ratio = o["in_swing"] / both if both > 0 else 0.0
        shortest, longest = self.validity[1:]
        bad = {
            "too_few_samples": o["n"] < self.validity[0], "too_short": stride_time < shortest, "too_long": stride_time > longest, "non_finite": o["bad"] > 0,
            "no_swing": o["swings"] == 0, "no_stance": o["swings"] == o["n"],
        }
        reason = next((r for r, is_so in bad.items() if is_so), "")
        blank = [None] * (self.width - 5)
        if reason:
            return (0, number, t_end, reason, *blank, s["session"])
        s["nth"] += 1
        excursion = o["high"] - o["low"]
        if s["model"] is None:
            s["baseline"].append({**{c: o[c] for c in ("seen", "mean", "m2", "k_seen", "k_mean", "k_m2", "pairs", "pair_m2")}, "ratio": ratio, "excursion": excursion})
            if s["nth"] == self.config.baseline_strides:
                self._go(s, "MODEL_BUILDING", "BASELINE_COLLECTION")
                self._learn(s)
                self._go(s, "READY", "MODEL_BUILDING")
            return (0, number, t_end, reason, s["nth"], *blank[1:], s["session"])
        m = s["model"]
        v = self._vector(o, m)
        near = [float(np.linalg.norm(v - np.array(c))) for c in m["centres"]]
        state = int(np.argmin(near))
        d, bound = float(np.linalg.norm(v - np.array(m["centre"]))), m["near_mean"] + self.config.ood_sigmas * m["near_sd"]
        ood = near[state] > bound
        e_swing = _shortfall(ratio, *m["swing"], SWING_SCALE)
        e_exc = _shortfall(excursion, *m["excursion"], max(m["excursion"][0], 1e-9))
        e_b = min(max(SWING_WEIGHT * (e_swing or 0.0) + EXCURSION_WEIGHT * (e_exc or 0.0), 0.0), 1.0)
        e_r = min(max(d / m["scale"], 0.0), 1.0) if m["scale"] > 0 else 0.0
        raw = min(max(e_b * (0.5 + 0.5 * e_r), 0.0), 1.0) * self.config.most_gain
        gain, engaged, updated = self.policy.step(s["policy"], float(number), raw, ood, False)[:3]
        self._go(s, "OOD" if engaged else "WALKING", "READY", "WALKING", "OOD")
        return (0, number, t_end, reason, s["nth"], state, near[state], d, bound, m["scale"], int(ood), e_swing, e_exc, e_b, e_r, raw, gain, engaged, updated, s["session"])

    def _learn(self, s: dict) -> None:
        rows = s["baseline"]

        def spread(n: str, mean: str, m2: str) -> float:
            total = sum(r[n] for r in rows)
            middle = sum(r[n] * r[mean] for r in rows) / total if total else 0.0
            return max(math.sqrt(sum(r[m2] + r[n] * (r[mean] - middle) ** 2 for r in rows) / total) if total else 0.0, LEAST_SPREAD)

        m = {"sx": spread("seen", "mean", "m2"), "sk": spread("k_seen", "k_mean", "k_m2")}
        x = np.array([self._vector(r, m) for r in rows])
        m |= baseline_model(x)
        if self.healthy is not None:
            patient, healthy = np.array(m["centre"]), np.array(self.healthy)
            aim = {"patient_baseline": patient, "interpolated_target": (1 - self.alpha) * patient + self.alpha * healthy, "healthy_region": healthy}[self.target]
            d = np.linalg.norm(x - aim, axis=1)
            m |= {"centre": aim.tolist(), "scale": float(d.mean() + 2 * d.std())}
        m["swing"] = [float(v) for v in np.percentile([r["ratio"] for r in rows], [5, 95])]
        m["excursion"] = [float(v) for v in np.percentile([r["excursion"] for r in rows], [5, 95])]
        s["model"], s["baseline"] = m, []

    @staticmethod
    def _vector(o: dict, m: dict) -> np.ndarray:
        """Logarithm of a stride's scaled covariance of x and k, as a vector."""
        sample = lambda m2, n: m2 / (n - 1) if n > 1 else 0.0
        b = sample(o["pair_m2"], o["pairs"]) / (m["sx"] * m["sk"])
        return vectorise(log_spd(np.array([[sample(o["m2"], o["seen"]) / m["sx"] ** 2 + RIDGE, b], [b, sample(o["k_m2"], o["k_seen"]) / m["sk"] ** 2 + RIDGE]])))


def closed(steps: DataFrame, min_samples: int = 3, shortest: float = 0.5, longest: float = 150.0, keep: Column | None = None) -> DataFrame:
    """The strides among a closer's rows, and those to ``keep``, with the times and the reason that ``segments.metrics`` adds."""
    both = F.col("swing_time") + F.col("stance_time")
    share = lambda c: F.when(c > 0, F.col("swing_time") / F.nullif(c, F.lit(0.0))).otherwise(0.0)
    stride = F.col("stride_id").isNotNull()
    rows = steps.where(stride if keep is None else stride | keep).withColumn("stride_time", F.col("t_end") - F.col("t_start"))
    rows = rows.withColumn("swing_ratio", share(both)).withColumn("swing_stance_ratio", share(F.col("stance_time")))
    return rows.withColumn("reject_reason", reject_reason(min_samples, shortest, longest)).withColumn("valid", F.col("reject_reason") == "")


def day_of(hours: Column) -> Column:
    """The day of a time in hours since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(hours / 24).cast("int"))
