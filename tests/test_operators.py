"""Invariants of the operators that SQL does not check, and parity of streams with batch."""

import math
import shutil
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.functions import columns as C
from strideline.functions import matrices as M
from strideline.operators import clusters, folds, segments
from strideline.schema import samples
from strideline.sources import csv_samples, telemetry
from strideline.streaming import strides as streams

SMALL = "/root/testdata/sf0.001"


def spd(seed, n=5):
    return M.covariance(np.random.default_rng(seed).normal(size=(200, n)))


def test_log_and_exp_are_inverse_and_vectors_keep_lengths():
    for seed in range(5):
        a, b = spd(seed), spd(seed + 50)
        assert np.allclose(M.exp_sym(M.log_spd(a)), a)
        la, lb = M.log_spd(a), M.log_spd(b)
        assert np.linalg.norm(la - lb) == pytest.approx(np.linalg.norm(M.vectorise(la) - M.vectorise(lb)))
    assert clusters.spd_reason(spd(1)) == ""
    assert clusters.spd_reason(np.ones((2, 3))) == "not_square"
    assert clusters.spd_reason(np.array([[1, 2.0], [0, 1]])) == "not_symmetric"
    assert clusters.spd_reason(-np.eye(2)) == "not_positive_definite"
    assert clusters.spd_reason(np.full((2, 2), np.nan)) == "non_finite"


@pytest.mark.parametrize("k", [2, 3, 4])
def test_separated_blobs_are_counted(k):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(12, 15)) + 8 * rng.normal(size=15) for _ in range(k)])
    assert clusters.select_k(x)[0] == k


def test_noise_is_one_cluster():
    chosen, evidence = clusters.select_k(np.random.default_rng(1).normal(size=(40, 15)))
    assert chosen == 1 and [e[0] for e in evidence] == [2, 3, 4]


def test_event_matching_and_period():
    assert clusters.match_events([1.0, 2.0, 3.0], [1.1, 2.9, 5.0])[0] == 2
    assert clusters.match_events([], []) == (0, 0.0, 0.0, 0.0)
    assert clusters.match_events([1.0, 1.1], [1.05, 1.3, 0.7], 0.2)[0] == 2 and clusters.match_events([1.0], [0.75, 1.25])[0] == 1 and clusters.match_events([2.0, 1.0], [1.5], 0.5)[0] == 1
    t = np.arange(900) / 100
    assert clusters.cycle_by_autocorrelation(-130 - 60 * np.cos(2 * np.pi * t / 1.2), 0.01) == pytest.approx(1.2, abs=0.01)
    assert clusters.cycle_by_autocorrelation(t[:50], 0.01) is None


def test_belt_trigger_follows_the_cycle_whatever_the_offset():
    counts = []
    for offset in (-130.0, 0.0, 250.0):
        m = folds.BeltTrigger(tau=2.0, refractory=0.35)
        s = m.start()
        events = [m.step(s, i / 100, offset - 60 * math.cos(2 * math.pi * i / 120))[0] for i in range(1200)]
        counts.append(events.count("heel_strike"))
    assert counts[0] in (9, 10) and len(set(counts)) == 1
    s = (m := folds.BeltTrigger()).start()
    assert not any(m.step(s, i / 100, -120.0)[0] for i in range(700))  # standing still


def test_refractory_time_defers_or_drops():
    def run(defer):
        m = folds.LevelTrigger(10, -5, 1.0, defer)
        s = m.start()
        return [(t, e) for t, x in [(0, 20), (0.1, -9), (0.2, 20), (0.3, -9), (1.2, -9)] if (e := m.step(s, t, x)[0])]
    assert run(True)[-1] == (1.2, "heel_strike")
    assert run(False)[-1] == (0.2, "toe_off")


def test_registry():
    with pytest.raises(TypeError):
        folds.register_detector("x", dict)
    with pytest.raises(ValueError):
        folds.register_detector("level", folds.LevelTrigger)
    with pytest.raises(ValueError):
        folds.create_detector("nothing")
    assert isinstance(folds.create_detector("belt_length"), folds.BeltTrigger)


def test_cobs_and_mixed_stream(spark):
    rng = np.random.default_rng(4)
    for n in (0, 1, 253, 254, 255, 600):
        for data in (rng.integers(0, 3, n).astype(np.uint8).tobytes(), rng.integers(1, 256, n).astype(np.uint8).tobytes()):
            coded = telemetry.cobs_encode(data)
            assert 0 not in coded and telemetry.cobs_decode(coded) == data
    frame = lambda seq: b"\0" + telemetry.cobs_encode(struct.pack(telemetry.LAYOUT, 1, 1, seq, 77, *range(24))) + b"\0"
    stream = b"OK start\r\n" + frame(12) + b"state=idle rate=100 x\n" + frame(13) + b"bye\n" + b"\0\x05\x01\0"
    rows = telemetry.decode_captures(spark.createDataFrame([("a", bytearray(stream)), ("b", None)], "path string, content binary")).collect()
    assert [r.kind for r in rows][:5] == ["line", "frame", "line", "frame", "line"]
    assert [r.seq for r in rows if r.kind == "frame"] == [12, 13] and rows[1]["values"][:3] == [0, 1, 2]
    got = spark.createDataFrame([(rows[2].line,)], "line string").select(telemetry.key_value(F.col("line"), "rate")).first()[0]
    assert got == "100"


def test_csv_aliases_defaults_and_coercion(spark, tmp_path):
    (tmp_path / "r.csv").write_text("T,belt,GYRO_X\n0.0,1.0,bad\n0.5,2.0,3\n0.5,9.0,4\n")
    rows = csv_samples.read_samples(spark, f"{tmp_path}/r.csv").orderBy("seq").collect()
    assert [r.timestamp for r in rows] == [0.0, 0.5, 0.5] and [r.belt_velocity for r in rows] == [0.0, 2.0, 0.0]
    assert rows[0].gyro_x is None and rows[1].gyro_x == 3.0 and rows[0].accel_x == 0.0


def test_column_rules(spark):
    row = spark.range(1).select(
        C.interval_error(F.lit(5.0), F.lit(1.0), F.lit(3.0), F.lit(0.0), "two_sided").alias("a"), C.interval_error(F.lit(None).cast("double"), F.lit(1.0), F.lit(3.0), F.lit(0.0), "excess").alias("b"),
        C.region_deviation(F.lit(2.0), F.lit(1.0), F.lit(0.0)).alias("c"), C.force_to_current(F.lit(-1.0)).alias("d"), C.impedance_force(F.lit(float("nan")), F.lit(0.0), F.lit(0.0)).alias("e")).first()
    assert tuple(row) == (1.0, None, 1.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        C.swing_profile("square", F.lit(0.5))


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts", "event_id").toPandas()
    folder = tmp_path / "in"
    folder.mkdir()
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    for i in range(3):
        part = spark.createDataFrame(events.iloc[i * 400 : (i + 1) * 400], schema).coalesce(1)
        part.write.parquet(str(tmp_path / f"p{i}"))
        (file,) = (tmp_path / f"p{i}").glob("part-*.parquet")
        shutil.copy(file, folder / f"{i}.parquet")
    stream = streams.detect(streams.sample_stream(spark, str(folder)), folds.BeltTrigger())
    q = stream.writeStream.format("memory").queryName("detected").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.session, r.seq, r.event, round(r.baseline, 9))
    assert sorted(map(str, map(key, spark.table("detected").collect()))) == sorted(map(str, map(key, folds.run_machine(samples(spark, SMALL), folds.BeltTrigger()).collect())))
    counts = streams.windowed(streams.sample_stream(spark, str(folder), 3))
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == len(events)


def test_policy_order_and_limits():
    from strideline.operators.policy import AssistPolicy

    m = AssistPolicy()
    s = m.start()
    step = lambda x, ood=False, veto=False: m.step(s, 0.0, x, ood, veto)
    gains = [step(0.8)[0] for _ in range(15)]
    assert gains[:2] == [0.0, 0.0] and max(np.diff([0.0, *gains])) <= 0.1 + 1e-12 and gains[-1] == pytest.approx(0.8)
    assert step(0.8, veto=True)[0] == pytest.approx(0.7)  # a veto goes through the rate limit
    assert s["deficits"] == 15 and s["window"] == []  # and leaves the streaks as they are
    assert step(None)[0] == pytest.approx(0.6)  # so does a stride that cannot be represented
    rows = [step(0.8, ood=True) for _ in range(6)]
    assert [r[1] for r in rows] == [0, 0, 0, 0, 1, 1]
    assert [r[0] for r in rows[3:]] == pytest.approx([0.8, 0.7, 0.6])  # outliers act as others until their streak is long


def test_policy_holds_only_a_settled_gain():
    from strideline.operators.policy import AssistPolicy

    m = AssistPolicy()
    s = m.start()
    updated = [m.step(s, 0.0, 0.0, False, False)[2] for _ in range(20)]
    assert updated == [1] * 11 + [0, 0, 1] * 3
    gains = [m.step(s, 0.0, x, False, False)[0] for x in [0.3, 0.0, 0.0, 0.3, 0.0, 0.0, 0.3, 0.0, 0.0, 0.3, 0.0, 0.0]]
    assert gains[-1] == pytest.approx(0.3)  # a deficit on one stride of three is one: the window keeps its largest
    late = [m.step(s, 0.0, 0.1, False, False)[0] for _ in range(30)]
    assert late[-1] == pytest.approx(0.3)  # a smaller deficit is no recovery


def walk(settings=None, turned=None, strikes=None, seconds=14.0):
    from strideline.operators.imu_steps import AdaptiveSteps

    m = AdaptiveSteps(settings)
    s, out = m.start(), []
    strikes = strikes or [(0.7 + 0.6 * i, i % 2 == 0) for i in range(22)]
    turned = np.eye(3) if turned is None else turned
    for i in range(round(seconds * 100)):
        t = i / 100
        bump = lambda width: [math.exp(-(((t - at) / width) ** 2)) for at, _ in strikes]  # noqa: E731, B023
        turn = sum(5 * v if left else -5 * v for v, (_, left) in zip(bump(0.07), strikes, strict=True))
        belt = -110 + sum(-70 * v if left else 10 * v for v, (_, left) in zip(bump(0.09), strikes, strict=True))
        row = m.step(s, t, *(turned @ [turn, 0.2 * math.sin(2 * t), 0.0]), *(turned @ [0.0, 0.0, 1 + 0.55 * sum(bump(0.025))]), belt)
        if row[0]:
            out.append((round(row[2], 2), row[1], row[8]))
    return s, out


def test_adaptive_steps_find_each_foot_however_the_unit_is_mounted():
    s, found = walk()
    assert [a for a, _, _ in found] == pytest.approx([6.1 + 0.6 * i for i in range(13)])
    assert [side for _, side, _ in found] == ["right", "left"] * 6 + ["right"]
    assert [assist for _, _, assist in found] == [0, 1] * 6 + [0]
    turned = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))[0]
    other, again = walk(turned=turned)
    assert again == found and other["model"]["belt"] == pytest.approx(s["model"]["belt"])


def test_adaptive_steps_follow_the_cadence_and_ask_for_walking():
    from strideline.operators.imu_steps import AdaptiveSteps, StepSettings

    at = [*np.arange(0.7, 8.0, 0.8)]
    at += [*np.arange(at[-1] + 0.8, 22.0, 0.55)]
    s, _ = walk(strikes=[(t, i % 2 == 0) for i, t in enumerate(at)], seconds=23.0)
    assert 2 * s["step"] == pytest.approx(1.1, abs=0.006)
    assert walk(StepSettings(impact_percentile=90.0))[0]["model"]["impact"] > walk()[0]["model"]["impact"]
    assert len(walk(StepSettings(at_peak=False, gyro_gate=False))[1]) == 13
    m = AdaptiveSteps()
    s = m.start()
    assert {m.step(s, i / 100, 0, 0, 0, 0, 0, 1.0, -120.0)[1] for i in range(700)} == {"calibrating"}


def test_gate_is_used_once_until_the_belt_has_reset():
    m = folds.GateRearm(80.0, 120.0)
    s = m.start()
    assert [m.step(s, 0.0, x, hit)[0] for x, hit in [(70, True), (70, True), (110, True), (70, True), (130, False), (70, True)]] == [1, 0, 0, 0, 0, 1]


def test_two_means_need_a_gap_and_two_groups():
    x = np.array([0.0, 1.0, 9.0, 10.0])
    assert clusters.two_means_threshold(x) == pytest.approx((0.5 + 0.65 * 9, 0.5 + 0.8 * 9))
    assert clusters.two_means_threshold(x, lower=False) == pytest.approx((0.5 + 0.35 * 9, 0.5 + 0.2 * 9))
    assert clusters.two_means_threshold(np.array([1.0, 3.0])) is None and clusters.two_means_threshold(np.ones(5)) is None


def test_matrix_helpers():
    a = spd(2)
    assert np.allclose(M.unvectorise(M.vectorise(a)), a)
    with pytest.raises(ValueError):
        M.unvectorise(np.zeros(4))
    assert M.condition_number(np.diag([1.0, 4.0])) == pytest.approx(4.0) and M.condition_number(-np.eye(2)) == math.inf
    assert np.linalg.eigvalsh(M.nearest_spd(np.diag([1.0, -2.0])))[0] >= 1e-10 * 0.99


def test_silhouettes_do_not_depend_on_the_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) + np.repeat(np.arange(3), 20)[:, None] * 4
    rows = spark.createDataFrame([(i, i // 20 if i else 9, v.tolist()) for i, v in enumerate(x)], "key long, label int, v array<double>")
    got = {r.key: r.silhouette for r in clusters.silhouettes(rows, block=7).collect()}
    label = np.array([9] + [i // 20 for i in range(1, 60)])
    assert got[0] == 0.0 and np.mean(list(got.values())) == pytest.approx(clusters.silhouette(x, label))
    assert clusters.silhouettes(rows.where("key < 0")).count() == 0


def test_principal_plane_is_centred_and_ordered(spark):
    x = np.random.default_rng(6).normal(size=(50, 4)) * [9, 3, 1, 1] + 5
    out = clusters.principal_plane(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<double>")).orderBy("key").toPandas()
    w, v = np.linalg.eigh(np.cov(x, rowvar=False))
    assert np.allclose(np.abs(out["axis0"]), np.abs((x - x.mean(0)) @ v[:, -1])) and out["axis0"].var() > out["axis1"].var()


def test_captures_round_trip(spark):
    from strideline.plans import catalogue

    rows = catalogue.telemetry_decode(spark, SMALL)
    counts = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert counts == {"line": 1000, "frame": 1000}
    sums = rows.where("kind = 'frame'").agg(F.sum(F.col("values")[0])).first()[0]
    assert sums == samples(spark, SMALL).agg(F.sum("k") * 10).first()[0]


def test_logs_models_and_config(spark, tmp_path):
    from pyspark.sql.types import StructType

    from strideline.sources import sinks

    df = spark.createDataFrame([(1, float("nan"), True), (2, 0.5, False)], "id long, v double, flag boolean")
    sinks.write_log(df, f"{tmp_path}/log")
    sinks.write_log(df.drop("v"), f"{tmp_path}/old")
    both = sinks.read_logs(spark, [f"{tmp_path}/log", f"{tmp_path}/old"], StructType.fromDDL("id long, v double, flag int")).collect()
    assert sorted((r.id, r.v, r.flag) for r in both if r.v is not None) == [(2, 0.5, 0)] and len(both) == 4
    sinks.write_models(df, f"{tmp_path}/models")
    assert spark.read.json(f"{tmp_path}/models").count() == 2
    for run in ("20260101_0900", "20260102_0900"):
        (tmp_path / "runs" / run).mkdir(parents=True)
    (tmp_path / "runs" / "20260101_0900" / "step1.csv").write_text("a\n")
    assert "20260101_0900" in sinks.newest_log(spark, f"{tmp_path}/runs", "step1") and sinks.newest_log(spark, f"{tmp_path}/runs", "step9") is None
    assert sinks.Config.load('{"window": 5}').window == 5
    with pytest.raises(KeyError):
        sinks.Config.load('{"windows": 5}')


def test_mock_sessions_walk_at_their_period(spark):
    from strideline.sources.mock import mock_sessions

    rows = folds.run_machine(mock_sessions(spark, 2, 30.0), folds.BeltTrigger(tau=2.0, refractory=0.35)).where("event = 'heel_strike'").orderBy("session", "t").collect()
    times = np.array([r.t for r in rows if r.session == 0])
    assert np.median(np.diff(times)) == pytest.approx(1.2, abs=0.03) and 21 <= len(times) <= 26


def test_replay_scores_both_deficits_against_the_baseline(spark):
    import pandas as pd

    from strideline.plans.batch import reference, replay
    from strideline.sources.sinks import Config

    rng = np.random.default_rng(0)
    rows, seq, n_strides = [], 0, 14
    for i in range(n_strides + 1):
        height, swings = (10.0 + rng.uniform(-1, 1), 4) if i < 8 else (4.0, 4) if i < 11 else (10.0, 2)
        for j in range(10):
            rows.append((1, seq, float(seq), float(height * np.sin(np.pi * j / 9)), int(rng.integers(0, 9)), j == 0, j >= 10 - swings))
            seq += 1
    samples = spark.createDataFrame(rows, "session long, seq long, t double, x double, k long, strike boolean, swing boolean")
    got = replay(samples, Config(baseline_strides=8)).toPandas().sort_values("stride_id").set_index("stride_id")
    assert got.index.tolist() == list(range(8, n_strides))

    frame = pd.DataFrame(rows, columns=["session", "seq", "t", "x", "k", "strike", "swing"])
    parts = [frame[10 * i : 10 * i + 11] for i in range(n_strides)]
    base = pd.concat(parts[:8])
    logs = []
    for p in parts:
        c = np.cov(p.x / base.x.std(ddof=0), p.k / base.k.std(ddof=0)) + 1e-6 * np.eye(2)
        w, u = np.linalg.eigh(c)
        logs.append((u * np.log(w)) @ u.T)
    d = np.array([np.linalg.norm(m - np.mean(logs[:8], axis=0)) for m in logs])
    scale = d[:8].mean() + 2 * d[:8].std()
    assert np.allclose(got.e_r, np.clip(d[8:] / scale, 0, 1), atol=1e-6) and np.allclose(got.scale, scale, atol=1e-6)
    healthy = spark.createDataFrame([([0.5, 0.0, 0.25],)], "healthy array<double>")
    for target, share in (("patient_baseline", 0.0), ("interpolated_target", 0.3), ("healthy_region", 1.0)):
        aim = (1 - share) * np.mean(logs[:8], axis=0) + share * np.diag([0.5, 0.25])
        far = np.array([np.linalg.norm(m - aim) for m in logs])
        measured = replay(samples, Config(baseline_strides=8), healthy, target).select("stride_id", "d", "scale").orderBy("stride_id").toPandas()
        assert np.allclose(measured.d, far[8:], atol=1e-6) and np.allclose(measured.scale, far[:8].mean() + 2 * far[:8].std(), atol=1e-6)
    own = np.array(reference(samples, Config(baseline_strides=8)).first().healthy)
    assert np.allclose(own, np.mean(logs[:8], axis=0)[[0, 0, 1], [0, 1, 1]] * [1, np.sqrt(2), 1], atol=1e-6)
    exc = np.array([p.x.max() - p.x.min() for p in parts])
    ratio = np.array([p.swing[:-1].sum() / 10 for p in parts])
    low, low_ratio = np.quantile(exc[:8], 0.05), np.quantile(ratio[:8], 0.05)
    e_exc, e_swing = np.clip((low - exc[8:]) / low, 0, 1), np.clip((low_ratio - ratio[8:]) / 0.1, 0, 1)
    assert e_exc[0] > 0.3 and e_swing[-1] == 1
    assert np.allclose(got.e_exc, e_exc) and np.allclose(got.e_swing, e_swing) and np.allclose(got.e_b, 0.5 * e_exc + 0.5 * e_swing)


def test_steps_do_not_depend_on_how_a_session_is_cut_into_blocks():
    from strideline.operators.imu_steps import AdaptiveSteps, StepSettings

    rng = np.random.default_rng(4)
    t = np.arange(1500) / 100
    at = np.arange(0.7, 15.0, 0.6)
    left = np.arange(len(at)) % 2 == 0
    bump = lambda width, size: np.exp(-(((t[:, None] - at) / width) ** 2)) @ size
    columns = [t, bump(0.07, np.where(left, 5.0, -5.0)), 0.2 * np.sin(2 * t), 0 * t, 0 * t, 0 * t, 1 + bump(0.025, 0.55 * np.ones(len(at))), -110 + bump(0.09, np.where(left, -70.0, 10.0))]
    columns = [c.tolist() for c in columns]
    for settings in (StepSettings(), StepSettings(at_peak=False)):
        m = AdaptiveSteps(settings)
        whole = m.process(m.start(), *columns)
        state, parts, i = m.start(), [[] for _ in whole], 0
        while i < len(t):
            k = int(rng.integers(1, 97))
            for out, part in zip(parts, m.process(state, *[c[i : i + k] for c in columns]), strict=True):
                out += part
            i += k
        assert sum(e is not None for e in whole[0]) >= 12
        assert parts[:3] == whole[:3] and all(np.allclose(a[700:], b[700:]) for a, b in zip(parts[3:], whole[3:], strict=True))


def test_a_mean_starts_anew_after_a_value_that_is_not_finite():
    m = folds.Recurrence("y", lambda x: x, lambda y, x: (y + x) / 2)
    assert m.process(m.start(), [0, 1, 2, 3, 4], [2.0, 4.0, math.inf, 8.0, 10.0])[0] == [2.0, 3.0, math.inf, 8.0, 9.0]
    assert folds.smoothing(5.0, 0.01) == pytest.approx(0.01 / (1 / (10 * math.pi) + 0.01))


def test_recordings_of_many_files_keep_their_order(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("belt_mm,acc_x\n" + "".join(f"{i}.5,{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = csv_samples.read_samples(spark, str(tmp_path), max_samples=2500).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and {r.session for r in rows} == {"a", "b"}
    assert all(r.belt_length == r.seq + 0.5 and r.accel_x == r.seq and r.timestamp == r.seq / 100 for r in rows)
    assert {round(r.belt_velocity, 6) for r in rows} == {0.0, 100.0}
    assert csv_samples.read_columns(spark, f"{tmp_path}/a.csv", without=("acc_x",)).columns == ["session", "seq", "belt_mm"]
    with pytest.raises(KeyError):
        csv_samples.read_columns(spark, f"{tmp_path}/a.csv", ["nothing"])
    (tmp_path / "empty.csv").write_text("belt_mm\n")
    with pytest.raises(ValueError):
        csv_samples.read_samples(spark, f"{tmp_path}/empty.csv")


def test_recordings_of_several_layouts(spark, tmp_path):
    for name, text in {
        "one/walk": "t,belt,belt_vel\n0,100,1\n0.5,101,2\n", "two/walk": "belt_vel,t,belt\n1,0,100\n2,0.5,101\n", "two/a [b] *c": " t , belt\n0,7\n2,9\n",
        "three/walk": "belt_mm\n5\n6\n", "three/blank": "", "three/names": "belt_mm\n", "four/d%20e+f": "t,belt,belt_vel\n1,2,3\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.csv").write_text(text)
    rows = csv_samples.read_samples(spark, [f"{tmp_path}/{d}" for d in ("one", "two", "three", "four")])
    got = {(r.session, r.seq): (r.timestamp, r.belt_length, r.belt_velocity) for r in rows.collect()}
    assert got == {
        (f"{tmp_path}/one/walk", 0): (0.0, 100.0, 1.0), (f"{tmp_path}/one/walk", 1): (0.5, 101.0, 2.0), (f"{tmp_path}/two/walk", 0): (0.0, 100.0, 1.0), (f"{tmp_path}/two/walk", 1): (0.5, 101.0, 2.0),
        ("a [b] *c", 0): (0.0, 7.0, 0.0), ("a [b] *c", 1): (2.0, 9.0, 1.0), (f"{tmp_path}/three/walk", 0): (0.0, 5.0, 0.0), (f"{tmp_path}/three/walk", 1): (0.01, 6.0, 100.0), ("d%20e+f", 0): (1.0, 2.0, 3.0),
    }
    assert [len(files) for _, files in csv_samples.layouts(spark, [f"{tmp_path}/{d}" for d in ("one", "two", "three", "four")])] == [2, 1, 1, 2]
    wide = csv_samples.read_columns(spark, [f"{tmp_path}/one", f"{tmp_path}/three"]).collect()
    assert {(r.belt, r.belt_mm) for r in wide} == {(100.0, None), (101.0, None), (None, 5.0), (None, 6.0)}
    with pytest.raises(KeyError):
        csv_samples.read_columns(spark, [f"{tmp_path}/one", f"{tmp_path}/three"], ["belt"])


def test_detector_logs_of_several_versions(spark, tmp_path):
    (tmp_path / "old.csv").write_text("accel_x,accel_y,accel_z,gyro_x,gyro_y,gyro_z,step_period_s,imu_side\n3,4,0,1,2,2,0.5,left\n")
    (tmp_path / "new.csv").write_text("threshold,imu_side,gyro_z,gyro_y,gyro_x,accel_z,accel_y,accel_x,step_period_s,acc_residual,gait_cycle_s\n0.5,right,0,0,7,0,0,2,0.25,9,8\n")
    new, old = csv_samples.read_detector_logs(spark, str(tmp_path)).orderBy("session").collect()
    assert (new.threshold, new.imu_side, new.gyro_corrected, new.acc_mag, new.acc_residual, new.gait_cycle_s, new.cadence_spm) == (0.5, "right", 7.0, 2.0, 9.0, 8.0, 240.0)
    assert (old.threshold, old.imu_side, old.gyro_corrected, old.acc_mag, old.acc_residual, old.gait_cycle_s, old.cadence_spm) == (0.28, "left", 1.0, 5.0, 0.0, 1.0, 120.0)


@pytest.mark.parametrize("size", [5, 64])
def test_captures_cut_anywhere_give_the_same_events(spark, tmp_path, size):
    from strideline.streaming import strides as stream

    frame = lambda n: b"\0" + telemetry.cobs_encode(struct.pack(telemetry.LAYOUT, 1, 1, n, 100 * n, 250, *range(23))) + b"\0"
    whole = {name: b"hello\n" + b"".join(frame(i) + f"OK n={i}\n".encode() for i in range(k)) + b"\0\x05\x01\0" + b"y" * 300 + b"\nend\nopen" for name, k in (("a", 4), ("b", 2))}
    want = telemetry.decode_captures(spark.createDataFrame(list(whole.items()), "path string, content binary"))
    folder = tmp_path / "in"
    pieces = {name: [data[i : i + size] for i in range(0, len(data), size)] for name, data in whole.items()}
    for batch in range(3):  # the pieces come in three goes
        for name, parts in pieces.items():
            (folder / name).mkdir(parents=True, exist_ok=True)
            for i, part in enumerate(parts):
                if i * 3 // len(parts) == batch:
                    (folder / name / f"{i:06}.bin").write_bytes(part)
        stream.piece_stream(spark, str(folder), 1000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    rows = lambda df: sorted(map(str, df.withColumn("at", F.col("at").cast("int")).collect()))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got) == rows(want) and got.count() > 10
    (folder / "a" / "000000x.bin").write_bytes(b"too late")
    stream.piece_stream(spark, str(folder), 1000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    late = spark.read.parquet(f"{tmp_path}/out").where("kind = 'late'").collect()
    assert [(r.path, r.line) for r in late] == [("a", "000000x.bin")]


def test_detector_logs_get_what_they_lack(spark, tmp_path):
    (tmp_path / "l.csv").write_text("accel_x,accel_y,accel_z,gyro_x,gyro_y,gyro_z,step_period_s,imu_side\n3,4,0,1,2,2,0.5,left\n0,0,1,0,0,0,0,right\n")
    a, b = csv_samples.read_detector_logs(spark, f"{tmp_path}/l.csv").orderBy("seq").collect()
    assert (a.acc_mag, a.gyro_mag, a.acc_residual, a.gait_cycle_s, a.cadence_spm, a.threshold, a.imu_side) == (5.0, 3.0, 0.0, 1.0, 120.0, 0.28, "left")
    assert b.acc_residual == pytest.approx(4 * 0.98) and b.cadence_spm == 0.0 and b.gyro_corrected == 0.0


def test_text_telemetry_parts_from_other_lines(spark):
    lines = ["[TEL] t=1 belt= -12.5mm vel=3mm/s spring_torque=0.25", "[TEL] belt=4mm x vel= -1.5mm/s", "[RX] other", None]
    found, other = csv_samples.telemetry_lines(spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string"))
    assert [tuple(r) for r in found.orderBy("i").collect()] == [(0, -12.5, 3.0, 0.25), (1, 4.0, -1.5, 0.0)] and other.count() == 2


def test_stream_parser_counts_and_takes_bytes_in_pieces():
    frame = b"\0" + telemetry.cobs_encode(struct.pack(telemetry.LAYOUT, 1, 1, 7, 77, *range(24))) + b"\0"
    stream = b"OK\r\n" + frame + b"x=1\n" + b"\0\x05\x01\0" + frame[1:] + b"y" * 200 + b"\n" + b"\0" + b"\x01" * 300 + b"\0" + frame + b"\0bye"
    whole = telemetry.StreamParser()
    events = whole.feed(stream)
    assert [k for k, _ in events].count("frame") >= 2 and events[0] == ("line", b"OK") and whole.dropped >= 3
    for size in (1, 2, 7, 64):
        parser, got = telemetry.StreamParser(), []
        for i in range(0, len(stream), size):
            got += parser.feed(stream[i : i + size])
        assert (got, parser.dropped, parser.held) == (events, whole.dropped, whole.held)


def test_captures_stream_and_logs(spark, tmp_path):
    from strideline.sources.registry import SOURCES, open_source, register_source
    from strideline.streaming import strides as stream

    frame = lambda n: b"\0" + telemetry.cobs_encode(struct.pack(telemetry.LAYOUT, 1, 1, n, 100 * n, 250, *range(23))) + b"\0"
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"c{i}.bin").write_bytes(b"hello\n" + frame(i) + frame(i + 1))
    rows = open_source(spark, "captures", f"{tmp_path}/in").collect()
    assert len(rows) == 6 and {r.motor_position for r in rows} == {2.5} and {r.timestamp for r in rows} == {0.0, 1.0, 2.0, 3.0}
    stream.log_stream(stream.capture_stream(spark, f"{tmp_path}/in").drop("values"), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.option("header", True).csv(f"{tmp_path}/log").where("kind = 'frame'").count() == 6
    assert stream.run_until(stream.capture_stream(spark, f"{tmp_path}/in"), lambda b: b.where("seq = 2").count() > 0, f"{tmp_path}/cp2")
    assert not stream.run_until(stream.capture_stream(spark, f"{tmp_path}/in"), lambda b: b.where("seq = 9").count() > 0, f"{tmp_path}/cp3")
    with pytest.raises(ValueError):
        open_source(spark, "nothing")
    with pytest.raises(ValueError):
        register_source("csv", SOURCES["csv"])


def test_low_pass_keeps_slow_waves_in_place():
    from strideline.functions.filters import low_pass

    t = np.arange(1000) / 100
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 30 * t)
    got = low_pass(slow + fast, 5.0, 100.0)
    assert np.abs(got - slow)[100:-100].max() < 0.01 and np.allclose(low_pass(np.full(50, 3.0), 5.0, 100.0), 3.0)
    assert np.array_equal(low_pass(fast[:5], 5.0, 100.0), fast[:5]) and np.array_equal(low_pass(fast, 60.0, 100.0), fast)


def test_banks_round_trip_and_refuse(spark, tmp_path):
    from strideline.operators import models, segments

    refs = spark.createDataFrame([("slow", 1.5, 2.0, [1.0]), ("fast", 0.9, float("nan"), [2.0])], "label string, lower double, upper double, centre array<double>")
    models.write_bank(refs, f"{tmp_path}/bank")
    kind, rows = models.read_bank(spark, f"{tmp_path}/bank")
    assert kind == "bank" and rows.where("upper is null").count() == 1
    models.write_bank(refs.limit(1), f"{tmp_path}/one")
    assert models.read_bank(spark, f"{tmp_path}/one")[0] == "reference"
    with pytest.raises(KeyError):
        segments.to_vector(refs, ["lower", "nothing"])
    assert segments.to_vector(refs, ["lower"]).first().vector == [1.5]
    with pytest.raises(ValueError):
        models.target_of(F.lit(1), F.lit(1), "elsewhere", 0.5)
    with pytest.raises(ValueError):
        C.register_profile("sine", lambda x: x)
    got = spark.range(1).select(models.warnings_of(F.lit(10), F.lit(1), F.lit(False)).alias("w")).first().w
    assert len(got) == 3


def test_inspect_reports_strides(spark, tmp_path, capsys):
    from strideline.__main__ import inspected, main

    t = np.arange(2000) / 100
    (tmp_path / "walk.csv").write_text("t,belt\n" + "".join(f"{a},{-130 - 60 * math.cos(2 * math.pi * a / 1.2):.3f}\n" for a in t))
    found = inspected(spark, f"{tmp_path}/walk.csv").where("reject_reason = ''").collect()
    assert 11 <= len(found) <= 16 and all(abs(r.stride_time - 1.2) < 0.06 for r in found)
    main(["inspect", f"{tmp_path}/walk.csv"])
    assert "walk" in capsys.readouterr().out


def test_simulate_writes_a_stride_log(spark, tmp_path, capsys):
    from strideline.__main__ import main

    t = np.arange(6000) / 100
    belt = -130 - (60 - 25 * (t > 40)) * np.cos(2 * np.pi * t / 1.2) + np.random.default_rng(2).normal(0, 0.5, len(t))
    (tmp_path / "walk.csv").write_text("t,belt\n" + "".join(f"{a},{b:.3f}\n" for a, b in zip(t, belt)))
    (tmp_path / "run.json").write_text('{"policy": {"baseline_strides": 12}, "target": "patient_baseline"}')
    main(["simulate", f"{tmp_path}/walk.csv", f"{tmp_path}/log", "--config", f"{tmp_path}/run.json", "--set", "policy.most_step=0.05", "--set", "detection.stride_time=[0.6, 2.0]"])
    assert "walk" in capsys.readouterr().out
    log = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/log").orderBy("stride_id").toPandas()
    assert log.stride_id.min() >= 11 and 28 <= len(log) <= 40 and log.gain.between(0, 0.8).all()
    assert log.gain.diff().abs().max() <= 0.05 + 1e-9
    assert log.e_exc[log.t_end < 39].mean() < 0.1 < log.e_exc[log.t_end > 43].mean()
    main(["simulate", f"{tmp_path}/walk.csv", f"{tmp_path}/log2", "--reference", f"{tmp_path}/walk.csv", "--set", "policy.baseline_strides=12", "--set", "target=healthy_region"])
    same = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/log2").where("t_end < 39").orderBy("stride_id").toPandas()
    assert np.allclose(same.d, log.d[log.t_end < 39]) and np.allclose(same.scale, log.scale.iloc[0])  # its own reference
    with pytest.raises(SystemExit):
        main(["simulate", f"{tmp_path}/walk.csv"])


def test_settings_go_through_json_and_paths():
    from strideline.sources.settings import Settings, Target, from_json, override, to_json

    changed = override(override(override(Settings(), "policy.window", "5"), "target", "healthy_region"), "detection.stride_time", "[1, 2]")
    assert (changed.policy.window, changed.target, changed.detection.stride_time) == (5, Target.HEALTHY, (1.0, 2.0))
    assert from_json(Settings, to_json(changed)) == changed and from_json(Settings, "{}") == Settings()
    assert override(Settings(), "policy.ood_policy", "safe_minimum").policy.ood_policy == "safe_minimum"
    for path in ("policy.windows", "nothing", "policy.window.deep"):
        with pytest.raises(KeyError):
            override(Settings(), path, "1")
    with pytest.raises(KeyError, match="policy.windows"):
        from_json(Settings, '{"policy": {"windows": 5}}')
    for path, text in (("target", "elsewhere"), ("policy.window", "many"), ("policy.window", "true"), ("detection.stride_time", "[1]"), ("policy.ood_policy", "cap"), ("policy", "5")):
        with pytest.raises(ValueError):
            override(Settings(), path, text)


def test_models_go_through_json(spark):
    from strideline.operators import models

    rows = spark.createDataFrame([(1, 2, [1.0, 2.0], [[0.5], [1.5]], 0.25), (2, 1, [3.0, 4.0], None, float("nan"))], "session long, k int, centre array<double>, centres array<array<double>>, scale double")
    back = models.model_of_json(models.model_json(rows), "k int, centre array<double>, centres array<array<double>>, scale double")
    assert [tuple(r) for r in back.orderBy("session").collect()] == [(1, 2, [1.0, 2.0], [[0.5], [1.5]], 0.25), (2, 1, [3.0, 4.0], None, None)]
    scaling = spark.createDataFrame([(1, ["x"], [1.0], [2.0], ""), (2, ["x"], None, None, "non_finite")], "session long, channels array<string>, mean array<double>, spread array<double>, reason string")
    values = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 1.0)], "session long, x double, y double")
    assert [r.x for r in models.scale(values, scaling, ["x"]).orderBy("session").collect()] == [2.0, None]
    assert [r.x for r in models.scale(values, scaling, ["x", "y"]).orderBy("session").collect()] == [None, None]
    with pytest.raises(KeyError):
        models.scale(values, scaling, ["z"])


def test_covariance_in_parts_equals_the_whole(spark):
    rng = np.random.default_rng(9)
    x, key = rng.normal(100, 5, (3000, 4)), rng.integers(0, 3, 3000)
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(key, x)] + [(7, [1.0] * 4)], "key int, v array<double>").repartition(5)
    got = {r.key: r for r in M.covariance_logs(rows).collect()}
    assert got[7].n == 1 and got[7].log_vector is None
    for k in range(3):
        assert np.allclose(got[k].log_vector, M.vectorise(M.log_spd(M.covariance(x[key == k]))), atol=1e-9)
    checks = {r.key: r for r in M.matrix_checks(rows).collect()}
    assert checks[0].reason == "" and checks[7].reason == "non_finite" and checks[7].least is None
    assert np.isclose(checks[1].least, np.linalg.eigvalsh(M.covariance(x[key == 1]))[0])


def test_reference_of_each_stride(spark):
    from strideline.operators import references

    bank = spark.createDataFrame(
        [("slow", 4.0, 6.0, [0.0, 0.0, 9.0], 1.0, 2.0, [(0.1, 0.2)]), ("fast", 1.0, 2.0, [3.0, 0.0, 0.0], 0.5, 1.0, [(0.5, 0.6)])],
        "label string, lower double, upper double, centre array<double>, threshold double, scale double, ranges array<struct<lower: double, upper: double>>")
    strides = spark.createDataFrame([(1, 0, 1.5, 0.3, [3.0, 0.0, 1.0]), (1, 1, 3.5, 0.3, [0.0, 0.0, 9.0]), (1, 2, None, 0.15, [3.0, 0.0, 0.0]), (2, 0, 1.5, 0.3, [3.0, 0.0, 1.0]), (1, 3, 1.5, None, [3.0, 0.0, 0.0])], "session long, stride_id int, stride_time double, m double, v array<double>")
    patients = spark.createDataFrame([(1, [1.0, 0.0, 0.0], [(0.0, 1.0)]), (2, [1.0, 0.0, 0.0], [(0.4, 1.0)])], "session long, centre array<double>, ranges array<struct<lower: double, upper: double>>")
    chosen = references.choose_reference(strides, bank).withColumn("reference", F.when(F.col("session") == 1, F.col("reference")))
    rows = {(r.session, r.stride_id): r for r in references.score_by_reference(chosen, patients, [("m", "deficit", 0.4, 1.0)], ["m"], "healthy_region").collect()}
    assert [rows[1, i].source for i in range(3)] == ["healthy_reference:fast", "healthy_reference:slow", "healthy_reference:slow"] and rows[2, 0].source == "patient_baseline"
    # the centre, the region and the interval all come of the stride's own reference
    assert (rows[1, 0].d_healthy, rows[1, 0].inside, rows[1, 0].deviation, round(rows[1, 0].e_m, 6)) == (1.0, False, 0.5, 0.5)
    assert (rows[1, 1].d_healthy, rows[1, 1].inside, rows[1, 1].deviation, rows[1, 1].e_m) == (0.0, True, 0.0, 0.0)
    assert rows[1, 2].deviation == 1.0 and rows[1, 2].d_target == rows[1, 2].d_healthy
    assert (rows[2, 0].d_healthy, rows[2, 0].inside, rows[2, 0].deviation, round(rows[2, 0].e_m, 6)) == (None, None, 0.0, 0.25) and rows[2, 0].d_target == rows[2, 0].d_patient
    assert rows[1, 3].e_m is None and rows[1, 3].deficit == 0.0


def _plain_states(rows, model, sigmas, least, hold):
    """The states of one session's (stride_id, v), stepped through one by one."""
    last, out = None, {}
    for stride_id, v in sorted(rows):
        if v is None or model is None:
            out[stride_id] = -1
            continue
        d = [math.dist(v, c) for c in model["centres"]]
        order = sorted(range(len(d)), key=lambda i: (d[i], i))
        trust = 1.0 if len(d) == 1 else min(max(1 - d[order[0]] / (d[order[1]] + 1e-6), 0.0), 1.0)
        if d[order[0]] > model["near_mean"] + sigmas * model["near_sd"]:
            last = out[stride_id] = -2
        elif trust >= least:
            last = out[stride_id] = order[0]
        else:
            out[stride_id] = last if hold and last is not None and last >= 0 else -1
    return out


def _states_table(spark):
    """Three sessions: two groups of strides with doubtful ones and outliers between, one without a baseline, one of a single state."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        kind = i % 2
        v = rng.normal([5.0 * kind, 0.0, 0.0], 0.3).tolist()
        if i >= 30 and i % 7 == 0:
            v = [2.5 + 0.02 * (i % 3), 0.3, 0.0]  # half way
        if i in (40, 51):
            v = [40.0, 0.0, 0.0]
        rows.append((1, i, None if i in (3, 45) else v, "non_finite" if i in (3, 45) else ""))
    rows += [(2, 0, [1.0, 1.0, 1.0], ""), (2, 1, None, None)]
    rows += [(3, i, rng.normal(0, 1, 3).tolist(), "") for i in range(35)]
    return rows, spark.createDataFrame(rows, "session long, stride_id long, v array<double>, reason string").repartition(4)


@pytest.mark.parametrize("hold", [True, False])
def test_states_equal_a_plain_walk(spark, hold):
    from strideline.operators import states

    rows, table = _states_table(spark)
    model = states.state_models(table, 30)
    by_session = {r.session: r.asDict() for r in model.collect()}
    assert (by_session[1]["k"], by_session[1]["n"], by_session[2]["reason"], by_session[3]["k"]) == (2, 30, "too_few_strides", 1)
    assert by_session[2]["centres"] is None and by_session[2]["centre"] is None
    # wide bound, so that strides half way are doubtful and no outliers
    got = states.assign_states(table, model, sigmas=12.0, least_confidence=0.3, hold=hold).collect()
    for s in (1, 2, 3):
        want = _plain_states([(i, v) for k, i, v, _ in rows if k == s], by_session[s] if by_session[s]["centres"] else None, 12.0, 0.3, hold)
        assert {r.stride_id: r.state for r in got if r.session == s} == want
    first = {r.stride_id: r for r in got if r.session == 1}
    assert first[40].gait_state == "OOD" and first[40].ood and not first[45].valid and first[45].message == "non_finite" and first[45].gait_state == "UNKNOWN" and first[45].nearest is None
    assert first[35].confidence < 0.3 and first[35].gait_state == (first[34].gait_state if hold else "UNKNOWN")
    assert {r.message for r in got if r.session == 2} == {"no_baseline", "no_vector"}
    assert all(r.confidence == 1.0 and r.runner_up is None for r in got if r.session == 3)


def test_doubt_after_an_outlier_is_unknown(spark):
    from strideline.operators import states

    model = spark.createDataFrame([(1, [[0.0], [4.0]], 0.1, 0.1)], "session long, centres array<array<double>>, near_mean double, near_sd double")
    values = [2.0, 0.1, 2.0, 50.0, 2.0, None, 3.9, 2.0]
    rows = spark.createDataFrame([(1, i, None if v is None else [v], "") for i, v in enumerate(values)], "session long, stride_id long, v array<double>, reason string")
    names = lambda **o: [r.gait_state for r in states.assign_states(rows, model, **o).orderBy("stride_id").collect()]
    assert names(bound=10.0) == ["UNKNOWN", "S0", "S0", "OOD", "UNKNOWN", "UNKNOWN", "S1", "S1"]
    assert names() == ["OOD", "S0", "OOD", "OOD", "OOD", "UNKNOWN", "S1", "OOD"]


def test_analysis_against_a_reference_and_without(spark):
    from strideline.operators import states

    _, table = _states_table(spark)
    model = states.state_models(table, 30)
    healthy = spark.createDataFrame([([1.0, 0.0, 0.0], 2.0, 4.0)], "healthy array<double>, healthy_threshold double, healthy_scale double")
    centre = {r.session: r for r in model.collect()}
    for r in states.analyse(table, model, healthy, "healthy_region").collect():
        if not r.valid:
            assert (r.d_patient, r.d_healthy, r.d_target, r.inside, r.deviation) == (None,) * 5
            continue
        d = math.dist(r.v, [1.0, 0.0, 0.0])
        assert np.allclose([r.d_healthy, r.d_target, r.d_patient], [d, d, math.dist(r.v, centre[r.session].centre)])
        assert r.inside == (d <= 2.0) and np.isclose(r.deviation, min(max(d - 2.0, 0) / 4.0, 1))
    for r in states.analyse(table, model).where("valid").collect():
        m = centre[r.session]
        assert r.inside is None and r.d_healthy is None and r.d_target == r.d_patient and np.isclose(r.deviation, min(max(r.d_patient - m.threshold, 0) / m.scale, 1))


def test_torque_of_one_side_waits_for_its_own_cycle(spark):
    # (t, strike, side, cycle, may start a pulse)
    walk = [(0.0, True, "right", None, 0), (0.5, True, "left", None, 1), (0.9, True, "left", None, 0), (1.2, True, "left", float("nan"), 0), (1.28, True, "left", None, 1), (1.9, True, "right", 1.0, 0), (2.0, False, "left", 1.0, 0), (2.1, True, "left", 1.0, 1), (2.5, True, "left", 0.5, 1), (2.9, True, None, 0.5, 0), (3.0, True, "left", 0.0, 0)]
    machine = folds.SideTorque("left", 1.2)
    state, got = machine.start(), []
    for t, strike, side, cycle, _ in walk:
        got.append(machine.step(state, t, strike, side, cycle)[0])
    assert got == [w[4] for w in walk]
    # sessions and blocks are apart: the machine's state alone goes on
    rows = spark.createDataFrame([(s, i, t, 0.0, strike, side, cycle) for s in (1, 2) for i, (t, strike, side, cycle, _) in enumerate(walk)], "session long, seq long, t double, x double, strike boolean, side string, cycle double")
    found = folds.run_machine(rows.repartition(3), machine).orderBy("session", "seq").collect()
    assert [r.fired for r in found] == [w[4] for w in walk] * 2


def _link(rows, **options):
    """(state, active, waiting, asked, last_seq, lapse) after each (t, sent, line, frame)."""
    machine = folds.LinkStates(**options)
    state = machine.start()
    return [machine.step(state, *row) for row in rows], machine, state


def test_link_goes_through_a_session():
    rows, _, _ = _link([
        (0.0, True, "CTL START", None), (0.1, False, "OK session_started", None), (0.2, True, "CTL SENSOR_START", None), (0.3, False, "OK sensor_streaming", None),
        (0.4, False, None, 7), (0.5, False, "OK control_started", None), (0.6, False, None, 8), (0.7, True, "CTL STOP", None), (0.75, False, "OK session_stopped", None)])
    assert [r[0] for r in rows] == ["AWAITING_START_ACK", "CONFIG_WAIT", "CONFIG_WAIT", "SENSOR_STREAMING", "SENSOR_STREAMING", "STREAMING", "STREAMING", "AWAITING_STOP_ACK", "IDLE"]
    assert [r[1] for r in rows] == [0, 0, 0, 0, 0, 1, 1, 1, 0] and [r[2] for r in rows] == ["start"] + [None] * 6 + ["stop", None]
    assert rows[-1][4] == 8 and {r[5] for r in rows} == {""}


def test_link_settles_what_fell_due():
    # an unanswered start is a fault at its time, not before it
    rows, _, _ = _link([(0.0, True, "CTL START", None), (0.99, False, None, None), (1.0, False, None, None)])
    assert [(r[0], r[5]) for r in rows] == [("AWAITING_START_ACK", ""), ("AWAITING_START_ACK", ""), ("FAULT", "start_unanswered")]
    # a stop without an answer has worked unless frames still came when it fell due
    for last, want in ((0.9, ("STREAMING", 1)), (0.7, ("IDLE", 0))):
        rows, _, _ = _link([(-0.1, False, "OK control_started", None), (0.0, True, "CTL STOP", None), (last, False, None, 3), (1.01, False, None, None)])
        assert rows[-1][:2] == want and rows[-1][5] == "stop_unanswered"
    # STALE once, and frames do not end it; a reply does
    rows, machine, state = _link([(0.0, False, "OK control_rearmed", None), (0.1, False, None, 1), (0.375, False, None, 2), (0.4, False, None, 3), (0.5, False, "OK state=CONTROL_ACTIVE last_seq=9 value=1.5", None)])
    assert [(r[0], r[5]) for r in rows] == [("STREAMING", ""), ("STREAMING", ""), ("STALE", "stale"), ("STALE", ""), ("STREAMING", "")]
    assert rows[-1][3:5] == (1.5, 9)
    assert machine.timed_out(state)[0] == "STALE"


def test_link_on_odd_lines(spark):
    walk = [(0.0, False, "ERR no session", None), (0.1, False, "OK state=CONTROL_STALE last_seq=x value=", None), (0.2, False, "ERR busy", None), (0.3, False, "", None), (0.4, False, None, None), (0.5, True, "", None), (0.6, False, "OK", None), (0.7, None, "OK state=READY value=2", None)]
    rows, _, _ = _link(walk)
    assert [(r[0], r[1]) for r in rows] == [("FAULT", 0)] + [("STALE", 1)] * 6 + [("IDLE", 0)]
    assert rows[1][3:5] == (0.0, 0) and rows[-1][3] == 2.0
    table = spark.createDataFrame([(s, i, t, 0.0, sent, line, frame) for s in (1, 2) for i, (t, sent, line, frame) in enumerate(walk)], "session long, seq long, t double, x double, sent boolean, line string, frame long")
    found = folds.run_machine(table.repartition(3), folds.LinkStates()).orderBy("session", "seq").collect()
    assert [tuple(r)[4:] for r in found] == rows * 2
    assert folds.run_machine(table.limit(0), folds.LinkStates()).count() == 0


def test_feature_matrix_looks_each_point_up_once(spark):
    rows = [(s, i, float(i), None if (s, i) == (1, 3) else (i * 7 % 5) + 0.25 * s) for s in range(3) for i in range((1, 9, 250)[s])]
    df = spark.createDataFrame(rows, "session long, seq long, t double, x double").withColumn("stride_id", F.lit(0))
    got = segments.feature_matrix(df, ["x"], 20)
    # an array built within a point's lambda made the cost of a stride the square of its length
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    lists = df.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("t", F.coalesce("x", F.lit(-1.0)).alias("x")))).alias("r")).select("session", F.transform("r", lambda r: F.nullif(r["x"], F.lit(-1.0))).alias("v"))
    want = lists.where(F.size("v") >= 2).select("session", C.resample(F.col("v"), 20).alias("x"))
    assert {r.session: r.x for r in got.collect()} == {r.session: r.x for r in want.collect()}


def test_decoding_holds_a_bounded_number_of_events():
    import pyarrow as pa
    import pyarrow.compute as pc

    frame = lambda n: b"OK n\n\0" + telemetry.cobs_encode(struct.pack(telemetry.LAYOUT, 1, 1, n & 0xFFFF, n, *[0] * 24)) + b"\0"
    contents = [b"".join(map(frame, range(n))) for n in (30_000, 0, 900, 900, 7_000)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(list("abcdef")), pa.array(contents, pa.binary())], names=["path", "content"])
    found = list(telemetry.decoded(iter([batch])))
    assert max(b.num_rows for b in found) < telemetry.EVENTS + telemetry.PIECE // 16
    rows = pa.Table.from_batches(found)
    for path, content in zip("abcdef", contents, strict=True):
        own = rows.filter(pc.equal(rows["path"], path))
        assert own["at"].to_pylist() == list(range(len(own))) and own["kind"].to_pylist() == [k for k, _ in telemetry.split_stream(content or b"")]
        assert [n for n in own["time10ms"].to_pylist() if n is not None] == list(range((content or b"").count(b"OK n\n")))


def test_silhouette_sums_of_blocks_equal_plain_distances():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 6)) + 50, rng.normal(size=(40, 6)) + 50
    y[:5] = x[:5]
    y[5] = x[5] + 1e-9
    labels = np.sort(rng.integers(0, 4, 40))
    key, label, other, d = clusters._label_sums((np.arange(300), np.zeros(300, int), x), (np.arange(40), labels, y))
    plain = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    want = np.stack([plain[:, labels == n].sum(1) for n in range(4)], 1)
    assert np.allclose(d.reshape(300, 4), want, rtol=1e-12, atol=0) and len(key) == len(label) == len(other) == 1200


def test_kmeans_of_each_runs_all_tables_at_once():
    """A session's model asks for 70 Lloyd runs a number of clusters; one by one, each of them drew and looped in Python."""
    rng = np.random.default_rng(2)
    tables = rng.normal(size=(5, 12, 3)) + 6 * rng.integers(0, 3, (5, 12, 1))
    labels, centres = clusters.kmeans_of_each(tables, 3)
    for x, label, centre in zip(tables, labels, centres, strict=True):
        alone = clusters.kmeans(x, 3)
        assert np.array_equal(label, alone[0]) and np.array_equal(centre, alone[1])
        assert np.array_equal(((x[:, None] - centre) ** 2).sum(-1).argmin(1), label)
        assert np.allclose(centre, [x[label == j].mean(0) for j in range(3)])
    same = clusters.kmeans(np.ones((4, 2)), 2)
    assert np.array_equal(same[1], np.ones((2, 2)))
