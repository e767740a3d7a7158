"""Recordings in CSV and text: column aliases, coercion, defaults and derived channels.

A file is a session.  Rows are numbered by the file's blocks and their order in a block, so a
file that is read in several splits keeps its order, and each file is put in order by itself.

Files of different loggers may be read together: files with the same header line are one
layout, each layout is one scan under its own column names, and the parts are united by
channel.  The driver holds the list of files, as Spark's file index does, and a plan has
as many scans as there are layouts.  A session is named by its file; files that share a name
are named by their whole path.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.functions.columns import magnitude
from strideline.operators.folds import Recurrence, run_machine
from strideline.schema import CHANNELS

#: Names of the channels in recordings, tried in order, exact ones first.
ALIASES = {
    "timestamp": ("host_time_s", "time_s", "device_time_s", "timestamp", "t"),
    "belt_length": ("belt_length", "belt_mm", "belt"),
    "belt_velocity": ("belt_velocity", "belt_vel"),
    "motor_position": ("motor_pos", "motor_position"),
    "motor_velocity": ("motor_vel", "motor_velocity"),
    "motor_current": ("motor_iq_meas", "motor_current", "iq_meas", "motor_iq_set"),
    "accel_x": ("accel_x", "acc_x", "ax"),
    "accel_y": ("accel_y", "acc_y", "ay"),
    "accel_z": ("accel_z", "acc_z", "az"),
    "gyro_x": ("gyro_x", "gx"),
    "gyro_y": ("gyro_y", "gy"),
    "gyro_z": ("gyro_z", "gz"),
}
#: What a log of a detector has where it lacks a column.
DEFAULTS = {
    "acc_impact_peak": 0.0, "acc_peak_rise_s": 0.0, "acc_peak_confirm_delay_s": 0.0, "acc_impact_time_s": -1.0, "acc_peak_candidate": 0.0, "threshold": 0.28, "gyro_threshold": 0.0, "gyro_side_score": 0.0,
    "dynamic_refractory_s": 0.45, "step_period_s": 0.6, "gait_speed_ratio": 1.0, "assist_pulse_s": 0.18, "belt_threshold": 0.0, "belt_ready": 1.0, "torque_cmd_nm": 0.0,
}
TEXT_COLUMNS = ("heel_strike", "imu_heel_strike", "imu_side")
#: How a line of text telemetry begins, and the unit after each of its values.
TELEMETRY_MARK, TELEMETRY_UNITS = "[TEL]", {"belt": "mm", "velocity": "mm/s", "spring_torque": ""}
TELEMETRY_KEYS = {"belt": "belt", "velocity": "vel", "spring_torque": "spring_torque"}


def resolve_columns(columns: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Which column of a file each channel is read from; channels without one are left out."""
    out, lower = {}, {c.strip().lower(): c for c in columns}
    for channel in CHANNELS:
        names = [overrides[channel]] if overrides and channel in overrides else [channel, *ALIASES.get(channel, ())]
        found = next((n for n in names if n in columns), None) or next((lower[n.lower()] for n in names if n.lower() in lower), None)
        if found:
            out[channel] = found
    return out


_FILE, _BLOCK, _ROW = "_path", "_block", "_row"


def layouts(spark: SparkSession, path: str | list[str]) -> list[tuple[str, list[str]]]:
    """(header line, its files) of each layout among recordings, in the order of the headers; empty files have none."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias(_ROW))
    first = lines.where((F.col(_BLOCK) == 0) & (F.col("line") != "")).groupBy(_FILE).agg(F.min_by("line", _ROW).alias("line"))
    found = first.groupBy("line").agg(F.array_sort(F.collect_list(_FILE)).alias("files")).orderBy("line").collect()
    return [(r["line"], r["files"]) for r in found]


def _readable(file: str) -> str:
    """A file's path as a reader takes it: not encoded, and without the meaning that patterns give to some characters."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(file))


def _parts(spark: SparkSession, path: str | list[str]) -> list[DataFrame]:
    """A table for each layout: the files' columns as text, with session, and seq from 0 in the file's order."""
    found = layouts(spark, path)
    if not found:
        raise ValueError(f"no data in {path}")
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.csv)?$", 1)
    counts = Counter(re.sub(r"\.csv$", "", unquote(f).rsplit("/", 1)[-1]) for _, files in found for f in files)
    shared = sorted(name for name, n in counts.items() if n > 1)
    file = F.url_decode(F.replace(F.col(_FILE), F.lit("+"), F.lit("%2B")))  # paths come encoded
    named = stem(file)
    if shared:
        whole = F.regexp_replace(F.regexp_replace(file, r"^[a-z0-9]+:/+", "/"), r"\.csv$", "")
        named = F.when(F.array_contains(F.array(*map(F.lit, shared)), named), whole).otherwise(named)
    out = []
    for _, files in found:
        raw = spark.read.csv([_readable(f) for f in files], header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        place = raw.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias(_ROW))
        seq = F.row_number().over(Window.partitionBy(_FILE).orderBy(_BLOCK, _ROW)) - 1
        out.append(place.withColumn("seq", seq.cast("long")).withColumn("session", named).drop(_FILE, _BLOCK, _ROW))
    return out


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _number(name: str) -> Column:
    return F.expr(f"try_cast(`{name}` AS double)")


def _channels(rows: DataFrame, rate: float, overrides: dict[str, str] | None, max_samples: int | None) -> DataFrame:
    """The channels of the recordings of one layout."""
    found = resolve_columns([c for c in rows.columns if c not in ("session", "seq")], overrides)
    out = rows.select("session", "seq", *[_number(found[c]).alias(c) if c in found else F.lit(0.0).alias(c) for c in CHANNELS])
    if max_samples is not None:
        out = out.where(F.col("seq") < max_samples)
    if "timestamp" not in found:
        out = out.withColumn("timestamp", F.col("seq") / rate)
    if "belt_velocity" not in found:
        w = Window.partitionBy("session").orderBy("seq")
        out = out.withColumn("belt_velocity", derivative(F.col("belt_length"), F.col("timestamp"), w))
    return out


def read_samples(spark: SparkSession, path: str | list[str], rate: float = 100.0, overrides: dict[str, str] | None = None, max_samples: int | None = None) -> DataFrame:
    """The channels of recordings as doubles with ``session`` and ``seq``; cells that are no number are null, channels that a file lacks 0.0.

    In a file without a time that is the row's number over ``rate``, in one without a velocity that is
    the backward difference of the length.  ``max_samples`` keeps the first rows of each recording.
    """
    out = _united([_channels(rows, rate, overrides, max_samples) for rows in _parts(spark, path)])
    if out.isEmpty():
        raise ValueError(f"no data in {path}")
    return out


def read_columns(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` of recordings, all that any file has by default, as doubles, but for those ``without``.

    A KeyError for a named column that a file lacks; by default a column is null where its file lacks it.
    """
    out = []
    for rows in _parts(spark, path):
        names = columns or [c for c in rows.columns if c not in ("session", "seq")]
        missing = [c for c in names if c not in rows.columns]
        if missing:
            raise KeyError(f"no columns {', '.join(missing)} in {path}")
        out.append(rows.select("session", "seq", *[_number(c).alias(c) for c in names if c not in (*without, "session", "seq")]))
    return _united(out)


def read_detector_logs(spark: SparkSession, path: str | list[str], alpha: float = 0.02) -> DataFrame:
    """Logs of a detector with all columns of the newest: constants, lengths of vectors, the impact and what follows from the step.

    Logs of several versions may be read together; each gets what its own version lacks.
    """
    return _united([_completed(rows, alpha) for rows in _parts(spark, path)])


def _completed(rows: DataFrame, alpha: float) -> DataFrame:
    """The logs of one version with what it lacks."""
    rows = rows.withColumns({c: _number(c) for c in rows.columns if c not in ("session", "seq", *TEXT_COLUMNS)})

    def lacking(name: str, value: Column) -> None:
        nonlocal rows
        if name not in rows.columns:
            rows = rows.withColumn(name, value)

    for name, axes in (("acc_mag", "accel"), ("gyro_mag", "gyro")):
        lacking(name, magnitude(*[F.col(f"{axes}_{a}") for a in "xyz"]))
    for name, value in DEFAULTS.items():
        lacking(name, F.lit(value))
    lacking("gyro_corrected", F.col("gyro_x"))
    lacking("gait_cycle_s", 2.0 * F.col("step_period_s"))
    lacking("cadence_spm", F.when(F.col("step_period_s") > 0, 60.0 / F.nullif(F.col("step_period_s"), F.lit(0.0))).otherwise(0.0))
    if "acc_residual" not in rows.columns:
        base = Recurrence("base", lambda x: x, lambda y, x: y + alpha * (x - y), ("x",))
        keys = rows.select(F.xxhash64("session").alias("session"), "seq", F.col("seq").cast("double").alias("t"), F.col("acc_mag").alias("x"))
        found = run_machine(keys, base).select(F.col("session").alias("_id"), F.col("seq").alias("_seq"), F.abs(F.col("x") - F.col("base")).alias("acc_residual"))
        rows = rows.join(found, (F.xxhash64("session") == F.col("_id")) & (F.col("seq") == F.col("_seq"))).drop("_id", "_seq")
    return rows


def telemetry_value(line: str | Column, name: str) -> Column:
    """The number of one value of a line of text telemetry: its key, ``=``, the number and its unit; null if the line has no such value."""
    number = r"= *([-+]?[0-9]+(?:[.][0-9]*)?)"
    unit = re.escape(TELEMETRY_UNITS[name])
    return F.nullif(F.regexp_extract(line, rf"\b{TELEMETRY_KEYS[name]}{number}{unit}(?![0-9.])", 1), F.lit("")).cast("double")


def telemetry_lines(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines of text telemetry, which have the mark, a belt length and a velocity, as (belt, velocity, spring_torque), 0.0 where there is none; and the other lines as they are."""
    fits = F.coalesce(F.contains(F.col(line), F.lit(TELEMETRY_MARK)), F.lit(False)) & telemetry_value(line, "belt").isNotNull() & telemetry_value(line, "velocity").isNotNull()
    kept = [F.col(c) for c in lines.columns if c != line]
    out = lines.where(fits).select(*kept, telemetry_value(line, "belt").alias("belt"), telemetry_value(line, "velocity").alias("velocity"), F.coalesce(telemetry_value(line, "spring_torque"), F.lit(0.0)).alias("spring_torque"))
    return out, lines.where(~fits)


def derivative(x: Column, t: Column, w) -> Column:
    """Backward difference; 0 for the first row and where time stands still."""
    dt = t - F.lag(t).over(w)
    return F.coalesce(F.when(dt > 0, (x - F.lag(x).over(w)) / F.nullif(dt, F.lit(0.0))), F.lit(0.0))
