"""Replay over any channels, references by cadence, vetoes and strides without a vector, against a plain version."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideline.functions.matrices import log_spd, vectorise
from strideline.operators.live import baseline_model
from strideline.operators.policy import AssistPolicy
from strideline.plans import catalogue_model
from strideline.plans.batch import reference_bank, replay
from strideline.sources.sinks import Config

CONFIG = Config(baseline_strides=6, persist=1, window=1, settle=100)
CHANNELS = ("x", "k", "c", "d")
LABEL = "CASE WHEN stride_time < 13 THEN 'fast' ELSE 'slow' END"


def _walks():
    """Session 0 walks in two cadences; session 1 as well, later with less height, one stride without a channel and one with a veto."""
    rng, rows = np.random.default_rng(3), []
    for session in (0, 1):
        seq = 0
        for i in range(24):
            n, height = (10, 10.0) if i % 2 else (16, 14.0)
            height *= 0.4 if session and i >= 12 else 1.0
            for j in range(n):
                x = float(height * np.sin(np.pi * j / (n - 1)) + rng.normal() / 3)
                c = None if session and i == 14 else float(x * 0.5 + rng.normal())
                # the sample that closes stride 14 is the first of stride 15
                rows.append((session, seq, float(seq), x, int(rng.integers(0, 9)), c, float(rng.normal() * (1 + session)), j == 0, j >= n - 4, bool(session and i in (19, 20))))
                seq += 1
    return rows


SCHEMA = "session long, seq long, t double, x double, k long, c double, d double, strike boolean, swing boolean, veto boolean"


def _strides(frame):
    """(samples, time, swing ratio, excursion) of each closed stride."""
    at = np.flatnonzero(frame.strike)
    out = []
    for a, b in zip(at, at[1:]):
        part = frame.iloc[a : b + 1]
        swings = part.swing.to_numpy()[:-1].sum()
        out.append((part, float(b - a), swings / (b - a), part.x.max() - part.x.min()))
    return out


def _plain(frame, bank, target):
    strides = _strides(frame)
    usable = [s for s in strides if s[0][list(CHANNELS)].astype(float).notna().sum().min() > 1]
    base = usable[: CONFIG.baseline_strides]
    pooled = pd.concat([s[0] for s in base])[list(CHANNELS)].astype(float)
    spread = pooled.std(ddof=0).to_numpy()

    def vector(part):
        values = part[list(CHANNELS)].astype(float).to_numpy() / spread
        if (~np.isnan(values)).sum(axis=0).min() < 2:
            return None
        c = pd.DataFrame(values).cov().to_numpy()  # pairwise, as a missing value is left out of its own moments
        return vectorise(log_spd(c + 1e-6 * np.eye(len(CHANNELS))))

    v0 = np.stack([vector(s[0]) for s in base])
    model = baseline_model(v0)
    first = [i for i, s in enumerate(strides) if s is base[-1]][0] + 1
    policy = AssistPolicy(CONFIG)
    state, rows = policy.start(), []
    last = max(bank, key=lambda b: (b["lower"], b["label"]))
    for number, (part, time, ratio, excursion) in list(enumerate(strides))[first:]:
        v = vector(part)
        ref = min(bank, key=lambda b: (max(b["lower"] - time, time - b["upper"], 0), b["label"]))
        aim = lambda centre: {"healthy_region": np.array(centre), "interpolated_target": 0.7 * np.array(model["centre"]) + 0.3 * np.array(centre)}[target]
        raw = d = d_healthy = e_r = None
        ood = False
        if v is not None:
            near = np.linalg.norm(v - np.array(model["centres"]), axis=1).min()
            ood = bool(near > model["near_mean"] + CONFIG.ood_sigmas * model["near_sd"])
            d, d_healthy = np.linalg.norm(v - aim(ref["centre"])), np.linalg.norm(v - np.array(ref["centre"]))
            own = np.linalg.norm(v0 - aim(last["centre"]), axis=1)
            e_r = min(max(d_healthy - ref["threshold"], 0) / ref["scale"], 1) if target == "healthy_region" else min(d / (own.mean() + 2 * own.std()), 1)
            miss = [max(r["lower"] - x, 0) / s for r, x, s in zip(ref["ranges"], (ratio, excursion), (0.1, ref["ranges"][1]["lower"]))]
            e_b = min(0.5 * min(miss[0], 1) + 0.5 * min(miss[1], 1), 1)
            raw = e_b * (0.5 + 0.5 * e_r) * CONFIG.most_gain
        gain = policy.step(state, float(number), raw, ood, bool(part.veto.iloc[-1]))[0]
        rows.append((number, f"healthy_reference:{ref['label']}", d, d_healthy, e_r, int(ood), gain))
    return rows


@pytest.mark.parametrize("target", ["healthy_region", "interpolated_target"])
def test_replay_of_four_channels_by_cadence(spark, target):
    rows = _walks()
    samples = spark.createDataFrame(rows, SCHEMA)
    bank = reference_bank(samples.where("session = 0"), F.expr(LABEL), CONFIG, channels=CHANNELS)
    got = replay(samples.where("session = 1"), CONFIG, None, target, channels=CHANNELS, bank=bank).orderBy("stride_id").collect()
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    held = [r.asDict(recursive=True) for r in bank.collect()]
    assert {b["label"] for b in held} == {"fast", "slow"} and all(len(b["centre"]) == 10 for b in held)
    want = _plain(frame[frame.session == 1], held, target)
    assert [(r.stride_id, r.source) for r in got] == [w[:2] for w in want] and {r.source for r in got} == {"healthy_reference:fast", "healthy_reference:slow"}
    for r, w in zip(got, want, strict=True):
        ours = (r.d, r.d_healthy, r.e_r, int(r.ood), r.gain)
        assert [x is None for x in ours] == [x is None for x in w[2:]]
        assert np.allclose([x or 0.0 for x in ours], [x or 0.0 for x in w[2:]], atol=1e-8), (r, w)
    blank = next(r for r in got if r.stride_id == 14)
    before = {r.stride_id: r.gain for r in got}
    assert blank.d is None and blank.state is None and before[14] <= before[13] and max(before.values()) > 0
    assert before[19] < before[18] or before[18] == 0.0


def test_bank_takes_no_more_strides_than_asked(spark):
    samples = spark.createDataFrame(_walks(), SCHEMA).where("session = 0")
    n = lambda most: sum(r.n for r in reference_bank(samples, F.lit("all"), CONFIG, channels=CHANNELS, most_strides=most).collect())
    assert n(9) == 9 and n(None) == 23


def test_unknown_channel_is_named(spark):
    samples = spark.createDataFrame(_walks(), SCHEMA)
    with pytest.raises(KeyError, match="nowhere"):
        replay(samples, CONFIG, channels=("x", "nowhere"))


def test_channel_replay_scores_patients_only(spark):
    rows = catalogue_model.channel_replay(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 50 and all(r.session % 3 for r in rows)
    assert {r.source.split(":")[0] for r in rows} == {"healthy_reference"} and {r.inside for r in rows} >= {True, False}
    assert any(r.gain > 0 for r in rows)
