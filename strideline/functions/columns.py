"""Column expressions: validity, scoring, control laws and matrix algebra on arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def clip(c: Column, low: float, high: float) -> Column:
    """c held inside [low, high]."""
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def magnitude(*axes: Column) -> Column:
    """Length of a vector of columns."""
    return F.sqrt(sum((a * a for a in axes[1:]), axes[0] * axes[0]))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Name of the first check that holds; empty if none does."""
    out = F.lit("")
    for condition, reason in reversed(checks):
        out = F.when(condition, reason).otherwise(out)
    return out


def encoder_reason(belt: Column, velocity: Column, position: Column, current: Column) -> Column:
    """Why an encoder sample is not plausible."""
    return first_reason(
        (~(finite(belt) & finite(velocity) & finite(position) & finite(current)), "non_finite"),
        (F.abs(belt) > 400, "belt_range"), (F.abs(velocity) > 2000, "velocity_range"), (F.abs(position) > 1e6, "position_range"), (F.abs(current) > 10, "current_range"),
    )


def imu_reason(accel: list[Column], gyro: list[Column]) -> Column:
    """Why an inertial sample is not plausible."""
    return first_reason(
        (~_all([finite(c) for c in accel + gyro]), "non_finite"), (_most(accel) > 16, "accel_range"), (_most(gyro) > 2000, "gyro_range"),
    )


def sensor_reason(imu: Column, encoder: Column) -> Column:
    """The inertial unit's reason, the encoder's if it has none; values that are not finite come first."""
    return first_reason(((imu == "non_finite") | (encoder == "non_finite"), "non_finite"), (imu != "", imu), (encoder != "", encoder))


def safety_faults(channels: dict, gap: Column, emergency: Column, invalid_spd: Column, belt: tuple[float, float] = (-400.0, 400.0), velocity: float = 2000.0, position: float = 1e6, current: float = 10.0, accel: float = 16.0, gyro: float = 2000.0, stale: float = 0.25) -> Column:
    """The codes of a sample's faults, in this order: stop, data, ranges, age, matrix.

    ``channels``: belt, velocity, position and current, and the lists accel and gyro.
    A value that is not finite is the one fault of the sample's data.
    """
    one = {c: channels[c] for c in ("belt", "velocity", "position", "current")}
    fine = _all([finite(c) for c in [*one.values(), *channels["accel"], *channels["gyro"]]])
    checks = [
        (emergency, "EMERGENCY_STOP"), (~fine, "NAN_DATA"),
        (fine & ((one["belt"] < belt[0]) | (one["belt"] > belt[1]) | (F.abs(one["velocity"]) > velocity)), "ENCODER_ERROR"),
        (fine & (F.abs(one["position"]) > position), "MOTOR_POSITION_LIMIT"), (fine & (F.abs(one["current"]) > current), "MOTOR_CURRENT_LIMIT"),
        (fine & ((_most(channels["accel"]) > accel) | (_most(channels["gyro"]) > gyro)), "IMU_ERROR"),
        (gap > stale, "STALE_DATA"), (invalid_spd, "INVALID_SPD"),
    ]
    return F.filter(F.array(*[F.when(condition, code) for condition, code in checks]), lambda c: c.isNotNull())


def limited_current(current: Column, limit: float) -> Column:
    """Current held to a limit of both signs; 0 where it is not finite."""
    return F.when(finite(current), clip(current, -abs(limit), abs(limit))).otherwise(0.0)


def max_force(limit: Column, most: float = 13.0) -> Column:
    """Force whose current is just a limit; 0 for no limit. The inverse of ``force_to_current``."""
    return F.when(limit > 0, 0.87 * F.least(limit, F.lit(most)) - 0.04).otherwise(0.0)


def assist_force_limit(force: Column, gain: Column, reserve: float = 0.8) -> Column:
    """Largest assist force whose peak at a gain leaves a reserve of the force that can pass."""
    return F.when(gain > 0, F.greatest(force - reserve, F.lit(0.0)) / F.nullif(gain, F.lit(0.0))).otherwise(0.0)


def _most(columns: list[Column]) -> Column:
    sizes = [F.abs(c) for c in columns]
    return F.greatest(*sizes) if len(sizes) > 1 else sizes[0]


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def region_deviation(d: Column, threshold: Column, scale: Column) -> Column:
    """Distance beyond a region's threshold in its scale, 0 to 1; any excess is 1 where the scale is 0."""
    excess = F.greatest(d - threshold, F.lit(0.0))
    return F.when(scale > 0, clip(excess / F.nullif(scale, F.lit(0.0)), 0.0, 1.0)).otherwise(F.when(excess > 0, 1.0).otherwise(0.0))


def interval_error(value: Column, lower: Column, upper: Column, scale: Column, direction: str) -> Column:
    """How far a value is outside an interval, in spans, 0 to 1; null where it was not measured."""
    deficit, excess = F.greatest(lower - value, F.lit(0.0)), F.greatest(value - upper, F.lit(0.0))
    miss = {"deficit": deficit, "excess": excess, "two_sided": F.greatest(deficit, excess)}[direction]
    span = F.when(scale > 0, scale).otherwise((upper - lower) / 2)
    error = F.when(miss <= 0, 0.0).when(span > 0, clip(miss / F.nullif(span, F.lit(0.0)), 0.0, 1.0)).otherwise(1.0)
    return F.when(finite(value), error)


def weighted_deficit(terms: list[tuple[float, Column]]) -> Column:
    """Weighted sum of the errors that were measured, 0 to 1."""
    return clip(sum((F.lit(w) * F.coalesce(e, F.lit(0.0)) for w, e in terms[1:]), F.lit(terms[0][0]) * F.coalesce(terms[0][1], F.lit(0.0))), 0.0, 1.0)


def assist_score(deficit: Column, deviation: Column) -> Column:
    """Deficit, halved where the stride lies in the reference region."""
    return clip(deficit * (0.5 + 0.5 * deviation), 0.0, 1.0)


def decision_state(ood: Column, deficit: Column, deviation: Column) -> Column:
    """Which of the two signals, deficit and deviation, speaks."""
    return F.when(ood, "OOD").when((deficit > 0) & (deviation > 0), "COMBINED").when(deficit > 0, "BIOMECH_ONLY").when(deviation > 0, "MANIFOLD_ONLY").otherwise("IN_RANGE")


def legacy_score(manifold: Column, swing: Column, excursion: Column) -> Column:
    """The older weighted score of three errors."""
    parts = [(0.5, manifold), (0.3, swing), (0.2, excursion)]
    return clip(sum((F.lit(w) * clip(c, 0.0, 1.0) for w, c in parts[1:]), F.lit(0.5) * clip(manifold, 0.0, 1.0)), 0.0, 1.0)


#: Shapes of the assist by name, each of a share of the swing from 0 to 1; ``register_profile`` adds to them.
PROFILES: dict[str, Callable[[Column], Column]] = {
    "sine": lambda x: F.sin(F.lit(math.pi) * x),
    "raised_cosine": lambda x: (1 - F.cos(F.lit(2 * math.pi) * x)) / 2,
    "trapezoid": lambda x: F.least(x / 0.25, F.lit(1.0), (1 - x) / 0.25),
}


def register_profile(name: str, shape: Callable[[Column], Column]) -> None:
    """Make a shape known by name; a name is given once."""
    if name in PROFILES:
        raise ValueError(f"profile {name!r} is registered already")
    PROFILES[name] = shape


def swing_profile(kind: str, u: Column) -> Column:
    """Shape of the assist over swing progress."""
    if kind not in PROFILES:
        raise ValueError(f"unknown profile {kind!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[kind](clip(u, 0.0, 1.0))


def impedance_force(dx: Column, dv: Column, fraction: Column, stiffness: float = 0.005, damping: float = 0.005, assist: float = 0.0) -> Column:
    """Spring, damper and assist term; 0 where it is not finite."""
    f = stiffness * dx + damping * dv + assist * clip(fraction, 0.0, 1.0)
    return F.when(finite(f), f).otherwise(0.0)


def force_to_current(force: Column, most: float = 13.0) -> Column:
    """Affine force map; no current for no or negative force."""
    return F.when(force <= 0, 0.0).otherwise(clip((force + 0.04) / 0.87, 0.0, most))


def torque_pulse(elapsed: Column, rise: float, hold: float, fall: float, peak: float) -> Column:
    """Trapezoid of rise, plateau and fall by the time since its start."""
    return (
        F.when((elapsed < 0) | (elapsed > rise + hold + fall), 0.0).when(elapsed < rise, peak * elapsed / rise)
        .when(elapsed <= rise + hold, peak).otherwise(peak * (rise + hold + fall - elapsed) / fall)
    )


def pulse_width(step: Column, reference: float, low: float, high: float) -> Column:
    """Pulse length in proportion to the cadence; the reference where the step is unknown."""
    return F.when(step <= 0, reference).otherwise(clip(reference * 2 * step / 1.2, low, high))


def distance(a: Column, b: Column) -> Column:
    """Euclidean (Frobenius) distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def fused(a: Column, b: Column, c: Column) -> Column:
    """``matrices.fused`` of columns: a b + c rounded once, twice where a part of it overflows."""
    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high
    (a1, a2), (b1, b2), p = halves(a), halves(b), a * b
    rest, s = ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2, p + c
    found = s + (((p - (s - (s - p))) + (c - (s - p))) + rest)
    return F.when(finite(found), found).otherwise(s)


def quantile(values: Column, share: float) -> Column:
    """Quantile of a sorted array by linear interpolation, with one rounding of the sum: the quantile of equal values is that value."""
    place = (F.size(values) - 1) * F.lit(share)
    low = F.floor(place).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    return between(F.get(values, low), F.get(values, high), place - low)


def between(low: Column, high: Column, part: Column) -> Column:
    """The value ``part`` of the way from low to high, the sum rounded once: between equal values it is that value."""
    return fused(low, 1 - part, high * part)


def spread(values: Column) -> Column:
    """Population standard deviation of an array, its values taken in turn."""
    def more(m: Column, v: Column) -> Column:
        mean = m["mean"] + (v - m["mean"]) / (m["n"] + 1)
        return F.struct((m["n"] + 1).alias("n"), mean.alias("mean"), (m["sum"] + (v - mean) * (v - m["mean"])).alias("sum"))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "sum")])
    return F.aggregate(values, start, more, lambda m: F.sqrt(m["sum"] / F.nullif(m["n"], F.lit(0.0))))


def interpolate(a: Column, b: Column, alpha: float) -> Column:
    """(1 - alpha) a + alpha b, element by element."""
    return F.zip_with(a, b, lambda x, y: x * (1 - alpha) + y * alpha)


def matrix_log_2x2(a: Column, b: Column, c: Column, floor: float = 1e-10) -> tuple[Column, Column, Column]:
    """Entries 11, 12, 22 of the logarithm of the symmetric matrix [[a, b], [b, c]] in closed form."""
    mid, half = (a + c) / 2, F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)
    high, low = F.ln(F.greatest(mid + half, F.lit(floor))), F.ln(F.greatest(mid - half, F.lit(floor)))
    mean, slope = (high + low) / 2, F.when(half > 0, (high - low) / (2 * F.nullif(half, F.lit(0.0)))).otherwise(0.0)
    return mean + slope * (a - c) / 2, slope * b, mean - slope * (a - c) / 2


def vectorise_2x2(a: Column, b: Column, c: Column) -> Column:
    """Upper triangle with the off-diagonal entry times sqrt 2, so that lengths are kept."""
    return F.array(a, b * math.sqrt(2), c)


def resample(values: Column, n: int) -> Column:
    """n points by linear interpolation over the index, ends included; null for fewer than 2 values."""
    def at(i: Column) -> Column:
        place = i * (F.size(values) - 1).cast("double") / (n - 1)
        low = F.least(F.floor(place).cast("int"), F.size(values) - 2)
        a, b = F.get(values, low), F.get(values, low + 1)
        return a + (b - a) * (place - low)
    return F.when(F.size(values) >= 2, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))
