"""The live loop: strides, model, scores, gain and state sample by sample, in batch and in streams."""

import dataclasses
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.operators import folds
from strideline.operators.live import LiveLoop
from strideline.plans.batch import reference, replay
from strideline.schema import of_events, samples
from strideline.sources.sinks import Config
from strideline.streaming import strides as stream

TABLE = "/root/testdata/sf0.01"
CONFIG = Config(baseline_strides=6, ood_streak=2, persist=2)
NAMES = ["session", "stride_id", "t_end", "state", "d_state", "d", "bound", "scale", "e_swing", "e_exc", "e_b", "e_r", "gain"]


def rows(df):
    return sorted((*(int(v) if i in (0, 1, 3) else round(v, 6) for i, v in enumerate(r)),) for r in df.select(*NAMES).collect())


@pytest.fixture(scope="module")
def replayed(spark):
    return replay(samples(spark, TABLE), CONFIG).cache()


def same(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 200
    assert np.allclose(np.array(got, float), np.array(want, float), rtol=1e-5, atol=1e-5)


def test_loop_equals_replay(spark, replayed):
    steps = folds.run_machine(samples(spark, TABLE), LiveLoop(CONFIG))
    scored = steps.where("raw is not null")
    same(rows(scored), rows(replayed))
    flags = lambda df: sorted(map(tuple, df.select("session", "stride_id", F.col("ood").cast("int").alias("ood"), "engaged", "updated").collect()))
    assert flags(scored) == flags(replayed)
    # a session's states go the allowed ways and end in walking or outlying once it is scored
    states = {(r.session_state, r.raw is None) for r in steps.where("stride_id is not null").collect()}
    assert {s for s, unscored in states if not unscored} <= {"WALKING", "OOD"} and {s for s, unscored in states if unscored} <= {"BASELINE_COLLECTION", "READY", "WALKING", "OOD"}
    seen = steps.groupBy("session").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("t", "seq", "session_state")))["session_state"]).alias("states")).collect()
    order = ["CALIBRATION", "BASELINE_COLLECTION", "READY", "WALKING"]
    for r in seen:
        ways = [s for s in r.states if s != "OOD"]
        assert ways == [s for s in order if s in ways]


def test_loop_with_a_reference_equals_replay(spark):
    config = dataclasses.replace(CONFIG, baseline_strides=8)
    healthy = reference(samples(spark, "/root/testdata/sf0.001"), dataclasses.replace(config, baseline_strides=3))
    want = replay(samples(spark, TABLE), config, healthy, "interpolated_target", 0.3)
    loop = LiveLoop(config, healthy=list(healthy.first()[0]), target="interpolated_target", alpha=0.3)
    a, b = rows(folds.run_machine(samples(spark, TABLE), loop).where("raw is not null")), rows(want)
    assert len(a) == len(b) > 50 and np.allclose(np.array(a, float), np.array(b, float), rtol=1e-5, atol=1e-5)
    with pytest.raises(ValueError):
        LiveLoop(target="nowhere")


def test_live_stream_equals_replay(spark, replayed, tmp_path):
    events = spark.read.parquet(f"{TABLE}/events.parquet")
    cuts = ["2024-01-01", "2024-01-07", "2024-01-19", "2024-03-01"]
    for a, b in zip(cuts, cuts[1:]):
        events.where((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        given = of_events(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
        query = stream.live(given, LiveLoop(CONFIG)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(300)
    same(rows(spark.read.parquet(f"{tmp_path}/out").where("raw is not null")), rows(replayed))


def test_command_follows_what_is_there(spark, tmp_path):
    from strideline.__main__ import followed
    from strideline.sources.settings import Settings

    head = "timestamp,belt_length,belt_velocity,motor_position,motor_velocity,motor_current,accel_x,accel_y,accel_z,gyro_x,gyro_y,gyro_z"
    settings = dataclasses.replace(Settings(), policy=Config(baseline_strides=3))
    for n in range(2):
        (tmp_path / "in" / "walk").mkdir(parents=True, exist_ok=True)
        lines = [f"{i / 50},{100 + 30 * np.sin(i / 8):.4f},{3 * np.cos(i / 8):.4f}" + ",0" * 9 for i in range(n * 400, n * 400 + 400)]
        (tmp_path / "in" / "walk" / f"{n}.csv").write_text("\n".join([head, *lines]) + "\n")
        followed(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", settings, 5.0, None).awaitTermination(100)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("stride_id").collect()
    assert [r.stride_id for r in got] == list(range(len(got))) and len(got) >= 12
    assert [r.session_state for r in got[:4]] == ["BASELINE_COLLECTION", "BASELINE_COLLECTION", "READY", "WALKING"]


def test_silent_sessions_are_stopped_once(spark, tmp_path):
    """Two recordings by the belt detector fall silent, go on and fall silent again."""
    def piece(name, n, first, count):
        (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
        lines = [f"{i / 50},{100 + 30 * np.sin(i / 8):.4f},{3 * np.cos(i / 8):.4f}" + ",0" * 9 for i in range(first, first + count)]
        head = "timestamp,belt_length,belt_velocity,motor_position,motor_velocity,motor_current,accel_x,accel_y,accel_z,gyro_x,gyro_y,gyro_z"
        (tmp_path / "in" / name / f"{n}.csv").write_text("\n".join([head, *lines]) + "\n")

    loop = LiveLoop(Config(baseline_strides=3), detector=folds.BeltTrigger(tau=2.0, refractory=0.35), validity=(15, 0.5, 2.5))

    kept = f"session long, seq long, t double, x double, {LiveLoop.schema}"

    def until(condition, enough):
        """The output once it has ``enough`` rows of a condition, or after a minute."""
        for _ in range(120):
            time.sleep(0.5)
            out = spark.read.schema(kept).parquet(f"{tmp_path}/out") if (tmp_path / "out" / "_spark_metadata").exists() else None
            if out is not None and out.where(condition).count() >= enough:
                break
        return out

    piece("one", 0, 0, 500)
    piece("two", 0, 0, 500)
    given = stream.recording_stream(spark, f"{tmp_path}/in", 100)
    query = stream.live(given, loop, stale=4.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        stopped = until("session_state = 'SAFE_STOP'", 2).where("session_state = 'SAFE_STOP'").collect()
        assert [(r.gain, r.stride_id) for r in stopped] == [(0.0, None)] * 2 and len({r.session for r in stopped}) == 2
        piece("one", 1, 500, 300)
        piece("two", 1, 500, 300)
        until("session_state = 'SAFE_STOP'", 4)
    finally:
        query.stop()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.where("session_state = 'SAFE_STOP'").count() == 4  # each fell silent again
    strides = {r.session: r["n"] for r in out.where("stride_id is not null").groupBy("session").agg(F.count("*").alias("n")).collect()}
    assert len(strides) == 2 and len(set(strides.values())) == 1 and min(strides.values()) >= 12
    assert out.where("raw is not null").count() > 10 and out.where("late = 1").count() == 0
